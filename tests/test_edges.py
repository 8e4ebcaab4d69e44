"""Nulls, empty tables, ties and split state of the operators that pass rows as streams or meet by equality."""

import pytest
from pyspark.sql import functions as F

from tesselon.functions import scalars, text
from tesselon.operators import answers, audit, contract, index, retrieval, scope, sessions
from tesselon.streaming import lanes


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_streams_of_packs_and_users_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        files = spark.createDataFrame([(i % 2 or None, f"src/f{i:02d}.ts", 10) for i in range(20)], "pack_id int, path string, size int")
        got = scope.select_files(files, 4, 35).collect()
        assert sorted((r["pack_id"] or 0, r["place"]) for r in got) == [(p, i) for p in (0, 1) for i in range(3)]
        assert scope.select_files(files.limit(0)).collect() == []
        ev = spark.createDataFrame([(u, i, 10.0 * i) for u in (1, None) for i in range(10)], "user_id int, event_id int, s double").withColumn("ts", F.timestamp_seconds("s"))
        rows = sessions.fixed_window_limit(ev.drop("s"), limit=2, seconds=30).collect()
        assert len(rows) == 20
        for u in (1, None):
            mine = sorted((r["event_id"], r["allowed"]) for r in rows if r["user_id"] == u)
            assert [a for _, a in mine] == [True, True, False] * 3 + [True]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_without_a_lane_are_a_lane(spark):
    frames = [(lane, 20.0 * i, 0.2 if 10 <= i < 150 else 0.001, 20.0, 320, 0.9) for lane in ("a", None) for i in range(400)]
    df = spark.createDataFrame(frames, "lane string, at_ms double, level double, ms double, samples int, prob double")
    got = lanes.segment_batch(df).collect()
    assert {r["lane"] for r in got} == {"a", None} and len(got) % 2 == 0


def test_names_and_symbols_meet_by_equality(spark):
    names = spark.createDataFrame([("a.ts",), ("lib/a.ts",), ("b.md",), ("/x.py",)], "name string")
    paths = spark.createDataFrame([("src/lib/a.ts",), ("lib/aa.ts",), ("b.md.bak",), ("q/b.md/z",), ("x.py",), ("d/x.py",), ("",)], "low_path string")
    got = {tuple(r) for r in retrieval.named_in_paths(names, paths).collect()}
    slow = {(n["name"], p["low_path"]) for n in names.collect() for p in paths.collect() if p["low_path"].endswith(n["name"]) or f"/{n['name']}" in p["low_path"]}
    assert got == slow and got
    assert retrieval.named_in_paths(names.limit(0), paths).collect() == []
    needles = spark.createDataFrame([("ab",), ("abc",), ("z",), ("cab",)], "needle string")
    texts = spark.createDataFrame([("xabcx",), ("cab",), ("a",), ("zz",)], "text string")
    assert {tuple(r) for r in retrieval.held_in(needles, texts).collect()} == {("ab", "xabcx"), ("abc", "xabcx"), ("ab", "cab"), ("cab", "cab")}


def test_blocks_of_queries_meet_all_rows(spark):
    q = spark.range(7).withColumnRenamed("id", "query_id")
    rows = spark.range(11)
    for block in (1000, 2):
        got = {(r["query_id"], r["id"]) for r in retrieval.against_all(q, rows, block, salts=3).collect()}
        assert got == {(a, b) for a in range(7) for b in range(11)}


def test_bonus_table_has_every_pair_of_classes_once(spark):
    b = retrieval.bonus_table(spark)
    n = 1 << (len(retrieval.QUERY_BITS) + len(retrieval.CHUNK_BITS))
    assert b.count() == n == b.select("q_class", "c_class").distinct().count()
    assert b.filter("bonus > 0 and not candidate").isEmpty()


def test_searches_of_empty_tables(spark):
    q = spark.createDataFrame([(1, "what is a queue"), (2, ""), (3, None)], "query_id int, text string")
    c = spark.createDataFrame([], "chunk_id string, path string, kind string, start_line int, text string, ord long")
    assert retrieval.retrieve(q, c).collect() == [] and retrieval.full_text_search(q, c).collect() == [] and retrieval.baseline_retrieve(q, c).collect() == []
    full = spark.createDataFrame([("x", "a/queue.ts", "code", 1, "the queue", 1)], c.schema)
    assert [r["query_id"] for r in retrieval.retrieve(q.filter("text is not null"), full).collect()] == [1]
    assert retrieval.full_text_search(q.limit(0), full).collect() == []


def test_scoped_search_refuses_nothing_and_leaks_nothing(spark):
    schema = "chunk_id string, path string, kind string, start_line int, text string, ord long, workspace_id string, space_id string, context_id string, source_id string"
    rows = [(f"c{i}", p, "code", 1, "the queue retry loop", i, w, None, None, "s") for i, (p, w) in enumerate([("a.ts", "w"), ("docs/b.md", "w"), ("c.ts", "other"), ("d.ts", None)])]
    q = spark.createDataFrame([(1, "why", "how does the queue retry")], "query_id int, text string, previous string")
    got = retrieval.scoped_retrieve(q, spark.createDataFrame(rows, schema), scope.Scope("w"), ["docs/**"]).collect()
    assert {r["path"] for r in got} == {"a.ts", "d.ts"}


def test_evidence_gates(spark):
    hits = spark.createDataFrame(
        [(1, 1, "c", "a.ts", s, 5.0, "the queue retries three times daily", h, 0, 1) for s, h in (("s1", "h"), ("s1", "old"), ("gone", "h"))],
        "query_id int, rank int, chunk_id string, path string, source_id string, score double, text string, span_hash string, start int, start_line int")
    now = spark.createDataFrame([("s1", "the queue retries three times daily\n", "h")], "source_id string, content string, content_hash string")
    q = spark.createDataFrame([(1, "how often does the queue retry")], "query_id int, text string")
    subjects = spark.createDataFrame([(1, "queue")], "query_id int, term string")
    got = {(r["source_id"], r["reject"]) for r in answers.local_claims(q, answers.with_integrity(hits, now), subjects).collect()}
    assert got == {("s1", None), ("s1", "STALE"), ("gone", "STALE_SOURCE")}
    why = spark.createDataFrame([(1, "why does the queue retry")], "query_id int, text string")
    assert {r["reject"] for r in answers.local_claims(why, hits, subjects).collect()} == {"SHAPE_MISMATCH"}


def test_contradictions_stay_in_their_group(spark):
    rows = [(i, g, "a", t, "supported") for i, (g, t) in enumerate([(1, "we keep the billing queue"), (1, "we drop the billing queue"), (2, "we drop the billing queue"), (2, None), (2, "")])]
    df = spark.createDataFrame(rows, "id int, meeting int, speaker string, text string, status string")
    got = {(r["id"], r["related_id"]) for r in audit.contradiction_pairs(df, df, "meeting").collect()}
    assert got == {(0, 1), (1, 0)}
    marked = {r["id"]: r["status"] for r in audit.mark_contradicted(df, df, "meeting").collect()}
    assert marked[0] == marked[1] == "contradicted" and marked[2] == "supported"


def test_maintenance_of_odd_rows(spark):
    e = spark.createDataFrame([(1, None, "s", "h"), (2, "other", "s", "h"), (3, "text", None, "h")], "id int, kind string, source_id string, content_hash string").withColumns({"normalized_hash": F.lit("n"), "sha": F.lit("x")})
    t = spark.createDataFrame([("s", "h"), ("s", "h")], "source_id string, content_hash string")
    d, c = t.withColumn("normalized_hash", F.lit("n")), spark.createDataFrame([("x",)], "sha string")
    assert {r["id"]: r["current"] for r in index.current_evidence(e, t, d, c).collect()} == {1: False, 2: False, 3: False}
    r = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 9, 12), (1, "c", 12, 15), (2, "a", 0, 5)], "page int, owner string, start int, end int")
    assert {(x["page"], x["owner"]) for x in index.exclusive_ranges(r, r).collect()} == {(1, "c"), (2, "a")}
    assert index.exclusive_ranges(r.limit(0), r).collect() == []
    m = spark.createDataFrame([], "tenant int, marker string")
    h = spark.createDataFrame([(1, 1, "x")], "query_id int, tenant int, text string")
    assert contract.isolation_leaks(h, m).collect() == []
    assert index.point_read(spark.createDataFrame([(None, 1), (2, 2)], "k int, v int"), k=None).first()["v"] == 1


@pytest.mark.parametrize("s", ["", "a", "retry queue", "é😀z"])
def test_mixing_hash_equals_slow_form(spark, s):
    m = 0xFFFFFFFF
    a, b = 0xDEADBEEF, 0x41C6CE57
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        u = raw[i] | raw[i + 1] << 8
        a, b = (a ^ u) * 2654435761 & m, (b ^ u) * 1597334677 & m
    a = ((a ^ a >> 16) * 2246822507 & m) ^ ((b ^ b >> 13) * 3266489909 & m)
    b = ((b ^ b >> 16) * 2246822507 & m) ^ ((a ^ a >> 13) * 3266489909 & m)
    n, out = (b & 0x1FFFFF) << 32 | a, ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    assert one(spark, scalars.mixing_hash(F.lit(s)).alias("h"))["h"] == out


def test_channels_need_something_to_win(spark):
    c = lambda *x: one(spark, retrieval.channel(*[F.lit(v) for v in x]).alias("c"))["c"]
    assert [c(0.0, 0.0, 0.0), c(0.8, 1.0, 0.0), c(0.6, 0.0, 1.0), c(0.5, 0.0, 1.0)] == ["lexical", "semantic", "lexical", "structural"]


def test_words_of_snake_and_camel_case(spark):
    got = one(spark, text.body_words(F.lit("readFile my_long_name x_ A9b")).alias("w"))["w"]
    assert got == ["read", "file", "my", "long", "name", "x", "a9b", "my_long_name"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tesselon import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
