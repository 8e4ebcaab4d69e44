from pyspark.sql import functions as F

from tesselon.operators import contract as c


def test_contracts_and_fitting_claims(spark):
    q = spark.createDataFrame([(1, "how much does a seat cost"), (2, "what are the three modes"), (3, "what does the exporter run on"), (4, "why three retries")], "query_id int, text string")
    k = c.contracts(q)
    got = {r["query_id"]: r for r in k.collect()}
    assert (got[1]["predicate"], got[1]["expectation"]) == ("cost", "quantity") and got[2]["members"] == 3 and (got[3]["verb"], got[3]["preposition"]) == ("run", "on")
    claims = [(1, "A seat costs 40 dollars"), (1, "Seats are red"), (2, "fast, slow, and idle"), (2, "fast, and slow"), (3, "The exporter runs nightly on the batch cluster"), (3, "The exporter can run on anything"),
              (3, "The cluster that runs on gas exports"), (4, "Three, because the gateway stalls"), (4, "Three retries")]
    out = c.fitting_claims(k, spark.createDataFrame(claims, "query_id int, say string"))
    assert sorted((r["query_id"], r["say"][:10]) for r in out.collect()) == [(1, "A seat cos"), (2, "fast, slow"), (3, "The export"), (4, "Three, bec")]


def test_sources_by_name_title_and_type(spark):
    q = spark.createDataFrame([(1, "what does pricing-2024.pdf say"), (2, "in the Annual Energy Report, who signs"), (3, "what do the lectures say"), (4, "nothing named")], "query_id int, text string")
    d = spark.createDataFrame([("a", "x/pricing-2024.pdf", None), ("b", "y/r7.pdf", "Annual Energy Report"), ("c", "z/cs-notes.pdf", None), ("d", "z/math-notes.pdf", None)], "source_id string, path string, title string")
    t = spark.createDataFrame([("notes", "lectures")], "word string, type_word string")
    got = {r["query_id"]: (r["by"], r["source_ids"]) for r in c.select_sources(q, d, t).collect()}
    assert got == {1: ("name", ["a"]), 2: ("title", ["b"]), 3: ("type", ["c", "d"])}


def test_judges(spark):
    p = spark.createDataFrame([(1, "how does the worker retry", "The worker will retry a failed job."), (2, "what is the weather", "The weather is fine here today."), (3, "why was redis chosen", "Redis keeps sessions.")], "id int, question string, evidence string")
    got = {r["id"]: r["decision"] for r in c.applicability(p).collect()}
    assert got == {1: "APPLICABLE", 2: "NOT_APPLICABLE", 3: "APPLICABLE"}
    q = spark.createDataFrame([(1, "worker retry"), (2, "exporter"), (3, "zebra")], "query_id int, text string")
    h = spark.createDataFrame([(1, 9.0, "the worker retries"), (2, 3.0, "unrelated words")], "query_id int, score double, text string")
    assert {r["query_id"]: r["decision"] for r in c.escalation(q, h).collect()} == {1: "ANSWER_WITH_CURRENT_PIPELINE", 2: "ESCALATE", 3: "SILENT"}


def test_prose_and_overview(spark):
    files = [("p", "src/main.py", '"""Main\n\nThis service converts uploads into pages.\n\nIt does:\n- parse files\n- build the index\n"""\nx = 1\n'), ("p", "src/none.py", "x = 1\n"), ("p", "README.md", "# Title\n\nThis project provides search over files.\n"),
             ("q", "a.ts", "/** Handles retries of the queue. */\nexport {}")]
    df = spark.createDataFrame(files, "pack_id string, path string, content string")
    got = {r["path"]: (r["description"], r["capabilities"]) for r in c.prose(df).collect()}
    assert got["src/main.py"] == ("This service converts uploads into pages.", ["parse files", "build the index"]) and "src/none.py" not in got and got["a.ts"][0] == "Handles retries of the queue."
    assert {r["pack_id"]: r["say"] for r in c.overview(df).collect()} == {"p": "This project provides search over files.", "q": "Handles retries of the queue."}


def test_small_ones(spark):
    df = spark.sql("select array('export','upload','files') t, array('upload') s")
    r = df.select(c.provenance_of(df.t, df.s, F.lit("The exporter writes"), F.lit("src/upload.py")).alias("p")).first()["p"]
    assert r.asDict() == {"content": ["export"], "path": ["upload"], "covered": ["upload"], "admissible": True}
    w = spark.createDataFrame([("it prevents loss", "prevent"), ("one level", "levels"), ("an addition", "add")], "h string, t string")
    assert [x[0] for x in w.select(c.word_form(w.h, w.t)).collect()] == [True, False, False]
    hits = spark.createDataFrame([(1, "a", "has MARK-B inside"), (2, "b", "has MARK-B inside")], "query_id int, tenant string, text string")
    marks = spark.createDataFrame([("a", "MARK-A"), ("b", "MARK-B")], "tenant string, marker string")
    assert [tuple(x) for x in c.isolation_leaks(hits, marks).collect()] == [(1, "a", "b")]
    s = spark.sql("select array(0,1,2,3,4,5) s, cast(array() as array<int>) e")
    assert s.select(c.nearest_samples(s.s, 48_000), c.nearest_samples(s.s, 16_000), c.nearest_samples(s.e, 48_000)).first()[:] == ([0, 3], [0, 1, 2, 3, 4, 5], [])
    f = spark.createDataFrame([("x", float(i * 10), 10.0) for i in range(9)], "lane string, at_ms double, ms double")
    assert sorted(x["at_ms"] for x in c.trailing_frames(f, 25.0).collect()) == [60.0, 70.0, 80.0]
    old = spark.createDataFrame([(1, None, None), (2, "set", 5)], "id int, kind string, schema_version int")
    assert [(x["id"], x["kind"], x["schema_version"]) for x in c.migrate(old, {"kind": F.lit("text")}, 5).orderBy("id").collect()] == [(1, "text", 5), (2, "set", 5)]
    v = spark.createDataFrame([("open", True, 5.0), ("open", False, 9.0)], "kind string, ok boolean, latency_ms double")
    assert c.viewer_metrics(v).first()[:] == ("open", 2, 1, 5.0, 9.0, 9.0)
