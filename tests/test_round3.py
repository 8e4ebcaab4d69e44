"""What the third review found, held on small inputs."""

from pyspark.sql import functions as F

from tesselon.functions import dialogue
from tesselon.functions import text as tx


def test_pieces_lose_spaces_alone_not_the_digits_of_their_number(spark):
    said = "0 zero. 1 one 1.  222 two 2.  plain three "
    row = spark.range(1).select(tx.sentences(F.lit(said)).alias("s"), dialogue.strip_filler(F.lit("thanks for that, 1 why is it slow 1?")).alias("f"),
                                dialogue.enumeration_fits(F.lit("0\n1\n22\n33")).alias("e")).first()
    assert row["s"] == ["0 zero.", "1 one 1.", "222 two 2.", "plain three"]
    assert row["f"] == "1 why is it slow 1?" and row["e"]


def test_isolation_leaks_does_not_take_a_text_apart(spark, monkeypatch):
    from tesselon.operators import contract

    long = "é😀 word " * 20_000
    hits = spark.createDataFrame([(1, 1, long + "marker-2-x"), (1, 1, "mark 3"), (2, 2, long), (None, 3, "abmarker-1-x" + long), (4, None, "marker-1-x"), (5, 1, None)], "query_id int, tenant int, text string")
    marks = spark.createDataFrame([(1, "marker-1-x"), (2, "marker-2-x"), (3, "k 3"), (3, ""), (4, None), (2, "marker-2-y")], "tenant int, marker string")
    want = {(1, 1, 2), (1, 1, 3), (None, 3, 1)}
    few = contract.isolation_leaks(hits, marks)
    assert {tuple(r) for r in few.collect()} == want
    # with few markers no row is made of a text's runs
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(contract, "FEW_MARKERS", 0)
    assert {tuple(r) for r in contract.isolation_leaks(hits, marks).collect()} == want


def test_similar_sets_verifies_only_sets_that_can_be_similar(spark, monkeypatch):
    from tesselon.operators import joins

    met, plain = [], joins.chunked_join
    monkeypatch.setattr(joins, "chunked_join", lambda *a, **k: met.append(plain(*a, **k)) or met[0])
    # all share their rarest word and nothing else; the last two share nine of ten
    rows = [(i, [f"pair{i // 2}", *[f"w{(7 * i + j) % 40}" for j in range(9)]]) for i in range(8)]
    rows += [(8, ["pair4", *"abcdefghi"]), (9, ["pair4", *"abcdefghk"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = {(r["a"], r["b"]): r["jaccard"] for r in joins.similar_sets(df, 0.7).collect()}
    assert got == {(8, 9): 9 / 11} and {(r["id_a"], r["id_b"]) for r in met[0].collect()} == {(8, 9)}


def test_near_dedup_takes_candidates_from_simhash(spark):
    from tesselon.llm import neardup, simhash

    # fingerprints 0, 3 and 5 bits apart; keys and sketches have nothing in common
    f = 0x0123456789ABCDEF
    rows = [(1, f, [1], b"\x01" * 128), (2, f, [2], b"\x02" * 128), (3, f ^ 0b111, [3], b"\x03" * 128), (9, ~f, [4], b"\x04" * 128), (8, ~f ^ 0b11111, [5], b"\x05" * 128)]
    nodes = spark.createDataFrame(rows, "node long, fp long, keys array<long>, sketch binary")
    assert {(r["node"], r["root"]) for r in neardup.candidate_classes(nodes).collect()} == {(1, 1), (2, 1), (3, 1)}
    # the fingerprint is that of the simhash operator
    text = "The quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, 1, text)], "doc_id long, rk long, text string")
    out = docs.mapInPandas(neardup._signatures(5), "doc_id long, rk long, node long, more long, fp long, size int, keys array<long>, sketch binary").first()
    assert out["fp"] & (2**64 - 1) == simhash.fingerprint(text)


def test_items_meet_their_lines_without_a_second_shuffle(spark):
    from tesselon.operators import regions

    rows = [("d", 1, i, "word", float(i % 3), 700.0 - 5 * (i // 3), 10.0, 10.0 if i else None) for i in range(12)]
    items = spark.createDataFrame(rows, "source_id string, page_number int, item int, text string, x double, y double, width double, height double")
    out = regions.visual_lines(items, carry=["width"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["source_id", "page_number", "item", "x", "y", "height", "width", "line", "line_y", "line_height"]
    # rows of five units apart: a line of 10 reaches 4.5, the first item counts as 12 high and reaches 5.4
    assert [r["line"] for r in out.orderBy("item").collect()] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_edges_look_at_one_side_where_the_other_is_sure():
    import re

    both = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    patterns = [r"\bown(?:s|er)?\b", r"\b(auth(entication)?|soc\s*2|\d+)\b|n['’]t\b", r"^\bs?x\b", r"\b(?:a|-b)\b", r"(a|b-)\b", r"x?\b-", r"\w*\b", r"\b[a-z]+\b", r"(?:ab|c)+\b", r"\ba*\b", r"\\b", r"(?!a)\bb\b", r"a{0,2}\b", r"\b(a|b){0,1}-"]
    said = ["", "own", "owner's owns disown", "soc 2 SOC2 auth", "don't no", "x sx s-x", "a -b b- ab-cab", "é own é", "_own own_", "-", "b\\b", "12 1a", "aa-b"]
    for p in patterns + [p for _, ps in tx._SHAPE_RULES for p in ps] + [p for _, ps in dialogue._PREDICATES for p in ps if not p.startswith("shape=")]:
        plain = p if p == r"\\b" else p.replace(r"\b", both)
        for flags in (0, re.I):
            for s in [*said, "what happens when it fails", "who owns the isn't it", "why is there no api key"]:
                ends = lambda q: [m.span() for m in re.finditer(q.replace(r"\z", r"\Z"), s, flags | re.A)]  # noqa: B023, E731
                assert ends(tx.edges(p)) == ends(plain.replace("$", r"\z")), (p, s)
    # no pattern of the rules tests both sides at every character any more
    assert not any(both in tx.edges(p) for _, ps in tx._SHAPE_RULES for p in ps)


def test_predicates_look_at_the_shape_once(spark):
    from tesselon.plans.queries import QUERIES

    df = QUERIES["predicate_kinds"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wrote|touched|owns?|added|changed|maintains?") == tx._SHAPE_RULES.__str__().count("wrote|touched|owns?|added|changed|maintains?")


def test_bag_vectors_shuffle_no_text_and_sum_up_repeated_ids(spark):
    from tesselon.operators.retrieval import bag_embeddings

    rows = [(1, "Alpha beta"), (1, "alpha x"), (2, "alpha beta alpha x"), (3, None), (4, "- é"), (5, "K")]
    got = {}
    for r in bag_embeddings(spark.createDataFrame(rows, "chunk_id int, text string")).collect():
        got.setdefault(r["chunk_id"], []).append(r["vector"])
    assert len(got[1]) == 2 and got[1][0] == got[1][1] == got[2][0] and len(got[1][0]) == 384
    assert set(got[3][0]) == set(got[4][0]) == {0.0} and sum(x > 0 for x in got[5][0]) == 1
    single = bag_embeddings(spark.createDataFrame(rows[2:], "chunk_id int, text string"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_line_features_make_no_tokens(spark):
    from tesselon.operators import layout

    texts = ["a\x01b _ AB  cd\x01 \x01\x01 é 12 éé", "\tAb\n aB9 a1b2 x", "", None, "😀😀 😀 Aé"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(layout.line_features(F.col("t")).alias("f"))
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    words = lambda t: [w for w in __import__("re").split("[ \t-\r]+", t or "") if w]
    has = __import__("re").compile("[A-Za-z]{2}")
    for t, r in zip(texts, out.collect(), strict=True):
        ws, f = words(t), r["f"]
        assert f["words"] == sum(bool(has.search(w)) for w in ws)
        assert f["short"] == sum(len(w) <= 2 for w in ws) / max(1, len(ws)) and f["length"] == sum(map(len, ws)) / max(1, len(ws))
        assert f["capitalised"] == sum("A" <= w[0] <= "Z" for w in ws) / max(1, len(ws))


def test_terms_find_their_files_without_a_shuffle_of_the_words(spark):
    from tesselon.operators import answers

    files = [("a/retry", "The retrying queue"), ("b", "x" * 30_000 + "retr"), ("c", None), ("c2", "api apis"), ("d", "entry retries"), ("d", "queue")]
    files = spark.createDataFrame(files, "path string, content string")
    terms = spark.createDataFrame([("retry",), ("retries",), ("api",), ("queue",), ("retr",), ("nothing",), ("queue",)], "term string")
    out = answers.term_file_frequency(terms, files)
    assert {r["term"]: r["df"] for r in out.collect()} == {"retry": 1, "retries": 1, "api": 1, "queue": 2, "retr": 3, "nothing": 0}
    # words meet their terms where the texts are: what is joined is broadcast, and no pair of term and file is shuffled
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w#" not in plan and "path#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(term" in x)


def test_full_text_ranks_any_of_the_terms_without_lists_of_places(spark):
    from tesselon.operators import retrieval

    q = spark.createDataFrame([(1, "retry queue"), (2, "queues"), (3, "é")], "query_id int, text string")
    c = spark.createDataFrame([(1, "Retried queue queue"), (2, None), (3, "retry"), (4, "queue's"), (5, "queue Queues queue")], "chunk_id int, text string")
    out = retrieval.full_text_search(q, c)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    kept = retrieval.full_text_search(q, c, posts=retrieval.positional_postings(c))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in kept.collect()} != set()


def test_texts_are_dealt_into_pieces_of_one_size(spark):
    from tesselon.session import dealt

    df = spark.range(64).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert dealt(df, "id", ["t"], 2000).rdd.getNumPartitions() == 32
    assert dealt(df.limit(0), "id", ["t"]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_pages_are_laid_out_by_columns_and_in_one_shuffle(spark):
    from tesselon.operators import layout
    from tesselon.plans.queries import QUERIES

    item = lambda t, x, y: (t, x, y, 50.0, 10.0)
    pages = [("a", 1, 600.0, 800.0, [item("Figure 1 shows a", 40.0, 790.0), item("plain mea-", 40.0, 400.0), item("sured", 40.0, 386.0)]), ("a", 2, 600.0, 800.0, []), ("b", 1, 600.0, 800.0, None), ("b", 2, 600.0, 800.0, [item(None, 1.0, 2.0)])]
    df = spark.createDataFrame(pages, "source_id string, page_number int, width double, height double, items array<struct<str:string,x:double,y:double,width:double,height:double>>")
    whole = {(r["source_id"], r["page_number"]): r for r in layout.page_layout(df).collect()}
    assert len(whole) == 4 and whole["a", 1]["text"] == "Figure 1 shows a\nplain measured" and [tuple(b) for b in whole["a", 1]["blocks"]] == [("caption", [0]), ("paragraph", [1, 2])]
    assert whole["b", 1]["lines"] == [] and whole["a", 2]["segments"] == []
    for part in ("text", "segments", "lines", "blocks"):
        one = layout.page_layout(df, (part,))
        assert one.columns == ["source_id", "page_number", "reading_order", part] and all(r[part] == whole[r["source_id"], r["page_number"]][part] for r in one.collect())
    bad = spark.createDataFrame([("abc", [(0, 1), (2, 3)]), ("abc", [(1, 2), (0, 1)]), ("", []), ("ab", [(0, 2), (2, 2)])], "t string, s array<struct<norm_start:int,norm_end:int>>")
    assert [r[0] for r in bad.select(layout.map_faults(F.col("t"), F.col("s"))).collect()] == [[2], [1], [], [2]]
    # a query over pages deals its lines out once
    for name, n in (("page_blocks", 1), ("page_texts", 1), ("page_map_faults", 2)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == n


def test_only_postings_that_questions_ask_for_are_made(spark):
    from tesselon.operators import retrieval

    c = [(f"p{i}:1-1", f"docs/retryQueue{i}.md", "code", 1, t, i) for i, t in enumerate(["the retry queue retries", "retried retryy snake_case_word " + "z" * 3000, None, "cases case cased", "unrelated words only"])]
    c = spark.createDataFrame(c, "chunk_id string, path string, kind string, start_line int, text string, ord long")
    q = retrieval.queries_table(spark.createDataFrame([(1, "retry queues"), (2, "cases of snake_case_words")], "query_id int, text string"))
    want = {tuple(r) for r in retrieval.term_frequencies(q, retrieval.postings(c)).collect()}
    got = retrieval.asked_frequencies(q, c)
    assert {tuple(r) for r in got.collect()} == want != set()
    # texts are dealt out once, by chunk; what is counted of them is not
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(chunk_id") == 1


def test_structural_scores_are_those_of_every_query_with_every_chunk(spark):
    from tesselon.operators import retrieval

    texts = [f"what does lib/f{i}.ts do with f{i + 1} and handle f{i}.ts index" for i in range(12)] + ["docs/index.md and router.py", "nothing", "handler1 index.md index.md handle", "handle"]
    q = retrieval.queries_table(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
    paths = ["lib/f{}.ts", "f{}.md", "docs/index.md", "a/docs/index.md.bak", "index", "x/router.py", "Q/F{}.TS", "", None]
    # one symbol or file name is that of many chunks, and a chunk_id is there twice
    rows = [((i * 7) % 600 if i else 7, (paths[i % 9] or "").format(i % 15) if i % 9 < 8 else None, [f"Handler{i % 2}", "", None, "index", "handler1"][i % 5]) for i in range(600)]
    c = spark.createDataFrame(rows, "chunk_id long, path string, symbol string")

    def score(asked, path, symbol):
        low, sym = (path or "").lower(), (symbol or "").lower()
        base = low.rsplit("/", 1)[-1]
        stem = base.rsplit(".", 1)[0]
        return 12.0 * sum(low.endswith(n) or f"/{n}" in low for n in asked["named"]) + sum(4 * (t in (base, stem)) + 2 * (t in sym) for t in asked["terms"])

    for limit in (1, 8, 400):
        want = []
        for asked in q.collect():
            met = sorted((-s, i) for i, p, x in rows if (s := score(asked, p, x)) > 0)
            want += [(asked["query_id"], i, -s) for s, i in met[:limit]]
        assert sorted(tuple(r) for r in retrieval.structural_scores(q, c, limit).collect()) == sorted(want)


def test_chunks_that_score_alike_do_not_all_meet_the_queries(spark):
    from tesselon.operators import retrieval

    q = retrieval.queries_table(spark.range(12).select(F.col("id").alias("query_id"), F.concat(F.lit("what does g"), "id", F.lit(" handle")).alias("text")))
    many = spark.range(4000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("src/g"), F.col("id").cast("string")).alias("path"), F.lit("handler").alias("symbol"))
    got = retrieval.structural_scores(q, many)
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got.collect()} == {(a, b): 6.0 if a == b else 2.0 for a in range(12) for b in sorted({a, *range(8)} - ({7} if a > 7 else set()))}
    joined, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in name:
            joined.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    # every chunk meets its symbol once, and not each of the queries
    assert joined and max(joined) <= 4000
