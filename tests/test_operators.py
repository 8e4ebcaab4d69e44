"""Operators that no registered query covers, against slow forms and small cases."""

import random
import statistics

from pyspark.sql import functions as F

from tesselon.operators import chunking, index, metrics, scope, sessions, telemetry


def test_incremental_equals_rebuild(spark):
    build = lambda s: chunking.line_windows(s.withColumnRenamed("content", "c"), path="source_id", content="c").select("source_id", "content_hash", "chunk_id", "text")
    old = spark.createDataFrame([("a", "1", "x\n" * 40), ("b", "2", "y"), ("c", "3", "z")], "source_id string, content_hash string, content string")
    new = spark.createDataFrame([("a", "1", "x\n" * 40), ("b", "9", "y2"), ("d", "4", "w")], old.schema)
    versions = {"chunker_version": 1, "index_version": 1}
    ledger = old.selectExpr("source_id", "content_hash", "1 chunker_version", "1 index_version", "1 chunk_count")
    got = index.incremental_chunks(new, ledger, build(old), build, versions)
    assert index.same_rows(got, build(new))
    plan = {r["source_id"]: r["action"] for r in index.ledger_plan(new, ledger, versions).collect()}
    assert plan == {"a": "reuse", "b": "rebuild", "c": "delete", "d": "new"}
    stale = ledger.withColumn("index_version", F.lit(0))
    assert {r["action"] for r in index.ledger_plan(new, stale, versions).collect()} == {"rebuild", "delete", "new"}


def test_percentiles_equal_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(n, float(rng.randrange(50))) for n in range(1, 60) for _ in range(n)]
    got = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(*metrics.latency_triple("v", "v")).collect()
    for r in got:
        vs = sorted(v for k, v in rows if k == r["k"])
        assert [r["v_p50"], r["v_p95"], r["v_p99"]] == [vs[max(0, -(-p * len(vs) // 100) - 1)] for p in (50, 95, 99)]
    none = spark.createDataFrame([(-1.0,), (None,)], "v double").agg(*metrics.latency_triple("v", "v")).first()
    assert none[:] == (0.0, 0.0, 0.0)


def test_globs_and_exclusion(spark):
    df = spark.createDataFrame([("src/a.ts",), ("src/deep/b.ts",), ("docs/x.md",), ("a.ts",)], "path string")
    hit = lambda *p: [r[0] for r in df.select(scope.excluded(F.col("path"), list(p))).collect()]
    assert hit("src/*.ts") == [True, False, False, False] and hit("src/**") == [True, True, False, False]
    assert hit("a.ts") == [True, False, False, True] and hit("**/b.t?") == [False, True, False, False] and hit("") == [False] * 4


def test_scope_is_enforced(spark):
    rows = [("1", "w", None, None, None), ("2", "x", None, None, None), ("3", None, "s", "c1", "k"), ("4", "w", "t", None, None), ("5", "w", "s", "c9", "k")]
    df = spark.createDataFrame(rows, "chunk_id string, workspace_id string, space_id string, context_id string, source_id string")
    s = scope.Scope("w", "s", ["c1"], [])
    assert [r["chunk_id"] for r in df.filter(scope.in_scope(s)).collect()] == ["1", "3"]
    assert [r["chunk_id"] for r in df.filter(scope.in_scope(scope.Scope("w", "s", ["c1"], ["k"]))).collect()] == ["3"]
    assert scope.assert_scope(df.filter(scope.in_scope(s)), s).count() == 2
    try:
        scope.assert_scope(df, s).collect()
        raise AssertionError("a leak passed")
    except Exception as e:
        assert "out of scope" in str(e)


def test_file_selection_skips_what_does_not_fit(spark):
    files = spark.createDataFrame([("p", "src/a.ts", 60), ("p", "src/b.ts", 50), ("p", "src/c.ts", 30), ("q", "x.md", 500), ("q", "src/y.py", 90)], "pack_id string, path string, size long")
    got = {(r["pack_id"], r["path"]) for r in scope.select_files(files, 10, 100).collect()}
    assert got == {("p", "src/a.ts"), ("p", "src/c.ts"), ("q", "src/y.py")}
    assert {r["path"] for r in scope.preferred_file(files).collect()} == {"src/a.ts", "src/y.py"}
    t = spark.createDataFrame([("plain\ttext",), ("bad\x00",), ("\x01" * 20,)], "c string")
    assert [r[0] for r in t.select(scope.looks_like_text(t.c)).collect()] == [True, False, False]


def test_quality_classes(spark):
    rows = [("The worker retries three times", "the worker  retries three times"), ("It retries three times and then stops for good", "It retries three times"), ("short line", "short line and much more"),
            ("alpha beta gamma delta", "alpha beta gamma epsilon"), ("alpha beta", "gamma delta"), (None, "x")]
    df = spark.createDataFrame(rows, "b string, f string")
    assert [r[0] for r in df.select(telemetry.quality_class(df.b, df.f)).collect()] == [
        "semantically equivalent", "equivalent but narrower", "equivalent but more precise", "semantically equivalent", "conflicting", "materially incomplete"]
    base = spark.createDataFrame([("s", "q", "old", 1), ("s", "q", "same line here", 2)], "scenario string, query string, say string, ord int")
    fast = spark.createDataFrame([("s", "q", "same line here", True), ("s", "q", "x", False), (None, "z", "y", True)], "scenario string, query string, say string, bypassed boolean")
    assert {r["class"]: r["n"] for r in telemetry.compare_with_baseline(base, fast).collect()} == {"semantically equivalent": 1, "materially incomplete": 1}


def test_agreement_and_progress(spark):
    rows = [("grounded", True, "consistent"), ("synthesis", True, "partial"), ("grounded", True, "n/a"), ("localCard", True, "consistent"), ("grounded", False, "conflicting")]
    r = telemetry.agreement(spark.createDataFrame(rows, "tier string, shadow_supported boolean, agreement string")).first()
    assert (r["comparable"], r["consistent"], r["partial"], r["rate"], r["safe"]) == (2, 1, 1, 0.75, False)
    r = telemetry.progressive_report(spark.createDataFrame([(True, 10.0), (False, -5.0), (None, 99.0), (True, 30.0)], "shadow_supported boolean, save_ms double")).first()
    assert (r["samples"], r["supported"], r["save_p50"], r["avg_save_ms"]) == (3, 2, 10.0, 20.0)


def test_privacy(spark):
    rows = ['{"content":"' + "x" * 600 + '"}', '{"evidence": [1]}', '{"k":"sk-abcdefghijklmn"}', '{"prompt":"p"}', '{"content":"short"}', '{"note":"my API-key"}']
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(telemetry.breaks_privacy(df.v)).collect()] == [True, True, True, True, False, True]


def test_reports(spark):
    s = telemetry.synthetic_session(spark, 500)
    assert s.exceptAll(telemetry.synthetic_session(spark, 500)).isEmpty() and {r["tier"] for r in s.select("tier").distinct().collect()} == set(telemetry.TIERS)
    llm = sorted(r["llm_ms"] for r in s.collect())
    rec = {r["rule"]: r for r in telemetry.recommendations(s).collect()}
    assert rec["llm_ms"]["value"] == llm[-(-95 * 500 // 100) - 1] and rec["llm_ms"]["fires"] and not rec["retrieve_ms"]["fires"]
    cmp = {r["stage"]: r["ratio"] for r in telemetry.compare_runs(s, s).collect()}
    assert set(cmp.values()) == {1.0} and set(cmp) == set(telemetry.STAGES)
    d = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("a", 0.4), (None, None)], "reason string, prob double")
    got = {r["reason"]: (r["n"], r["median"]) for r in telemetry.drop_reasons(d).collect()}
    assert got == {"a": (3, statistics.median([0.1, 0.3, 0.4])), "unknown": (1, None)}
    f = telemetry.feedback_counts(spark.createDataFrame([("useful",), ("useful",)], "result string"), ["not-useful", "useful"])
    assert [(r["place"], r["n"]) for r in f.orderBy("place").collect()] == [(0, 0), (1, 2)]
    lines = spark.createDataFrame([(1, 1, "them", "first"), (1, 2, "them", " last? "), (1, 3, "you", "ok")], "meeting_id int, ord int, role string, text string")
    assert telemetry.transcript_summary(lines).first()[:] == (1, 2, 1, "last?")
    assert telemetry.usage(spark.createDataFrame([("u", 3, 10), ("u", None, 5)], "user_id string, pages long, bytes long")).first()[:] == ("u", 3, 15, 2)
    assert telemetry.index_report(spark.createDataFrame([("s", "a", 1, 2.0), ("s", "b", 2, 3.0)], "space_id string, context_id string, chunks int, ms double")).first()[:] == ("s", 3, 5.0)


def test_sessions(spark):
    rows = spark.createDataFrame([(1, 0, "them", "a"), (1, 10, "system", "s"), (1, 14, "you", "b"), (1, 40, "them", "c")], "m int, s int, role string, text string").selectExpr("*", "timestamp_seconds(s) ts")
    assert [r["context"] for r in sessions.trailing_seconds(rows, "m").orderBy("s").collect()] == ["a", "a", "a\nb", "c"]
    a = spark.createDataFrame([(0.6, 100.0, 0.0, 1.0), (0.4, 9000.0, 9.0, 1.0), (None, 1000.0, 2.5, 1.0), (None, 999.0, 9.0, 1.0), (None, 5000.0, 2.0, 1.0)], "p double, d double, e double, g double")
    assert [r[0] for r in a.select(sessions.admit(a.p, a.d, a.e, a.g)).collect()] == ["silero", None, "high-energy", None, None]


def test_table_maintenance(spark):
    t = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 7, "y")], "k int, v string, n long, status string")
    new = spark.createDataFrame([(2, "B", 0, "z"), (3, "C", 0, "z"), (3, "D", 1, "z")], t.schema)
    assert sorted((r["k"], r["v"]) for r in index.upsert(t, new, ["k"], [F.desc("n")]).collect()) == [(1, "a"), (2, "B"), (3, "D")]
    assert sorted(r["v"] for r in index.insert_missing(t, new.filter("v != 'D'"), ["k"]).collect()) == ["C", "a", "b"]
    assert [r["k"] for r in index.delete_keys(t, new, ["k"]).collect()] == [1] and [r["k"] for r in index.keep_keys(t, new, ["k"]).collect()] == [2]
    got = {r["k"]: (r["n"], r["status"]) for r in index.add_counts(t, new, ["k"], "n", F.lit("done")).collect()}
    assert got == {1: (5, "x"), 2: (7, "done")}
    s = spark.createDataFrame([("old", "ready", "new", "ready"), ("old", "ready", "bad", "failed"), ("old", "ready", "wip", "parsing")], "content_hash string, readiness string, staged_hash string, staged_readiness string")
    assert [(r["content_hash"], r["staged_hash"]) for r in index.commit_staged(s).collect()] == [("new", None), ("old", None), ("old", "wip")]
    sp = spark.createDataFrame([("s", ["a", "b", "a"], "c")], "space_id string, context_ids array<string>, primary_id string")
    assert [r["context_id"] for r in index.expand_members(sp).collect()] == ["a", "b", "c"]
    c = spark.createDataFrame([("1", "h"), ("2", "h2")], "chunk_id string, content_hash string")
    assert [r["chunk_id"] for r in index.stale_vectors(c, spark.createDataFrame([("1", "h"), ("2", "old")], c.schema)).collect()] == ["2"]
    b = spark.createDataFrame([(0, "a", "x"), (0, "a", "y"), (1, "b", "z"), (2, None, "w" * 200)], "batch int, id string, text string")
    assert {r["batch"]: r["faults"] for r in index.batch_faults(b, 100, 150).collect()} == {0: ["repeat"], 2: ["bytes", "id", "text", "repeat"]}
    assert index.fingerprint(t, ["k", "v"]).first() == index.fingerprint(t.orderBy(F.desc("k")), ["k", "v"]).first()
