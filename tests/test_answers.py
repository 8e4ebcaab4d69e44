import pytest

from tesselon.operators import answers, audit, chunking, retrieval

FILES = [
    ("src/upload/worker.py", "The upload worker retries a failed transfer three times.\nIt never deletes the source file.\n"),
    ("src/export/job.py", "The export job writes a workbook every night.\nEach workbook holds 40 sheets.\n"),
    ("tests/test_upload.py", "The upload worker test covers retries of a transfer.\n"),
    ("docs/readme.md", "This service moves files between stores and reports on it.\n"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    chunks = chunking.line_windows(files).selectExpr("*", "cast(xxhash64(path) as bigint) as ord", "path as source_id")
    return files, chunks


def ask(spark, corpus, *texts, model=None):
    files, chunks = corpus
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    hits = retrieval.retrieve(q, chunks).join(chunks.select("chunk_id", "text", "source_id"), "chunk_id")
    return {r["query_id"]: r for r in answers.route(q, hits, files, model).collect()}


def test_routes(spark, corpus):
    got = ask(spark, corpus, "how often does the upload worker retry a transfer", "what is the weather", "zzz qqq xxx")
    assert got[0]["tier"] == "localCard" and "retries a failed transfer three times" in got[0]["say"]
    assert all(got[i]["tier"] == "silent" and got[i]["say"] is None and got[i]["reason"] for i in (1, 2))


def test_model_lines_are_verified(spark, corpus):
    from pyspark.sql import functions as F

    lie = lambda p: p.select("query_id", F.lit("Invented dolphins swim nightly [1].").alias("say"))
    truth = lambda p: p.select("query_id", F.lit("The export job writes a workbook every night [1].").alias("say"))
    for model, tier in ((lie, {"silent", "localCard"}), (truth, {"grounded", "localCard"})):
        got = ask(spark, corpus, "nightly workbook schedule", model=model)
        assert got[0]["tier"] in tier and "dolphins" not in (got[0]["say"] or "")


def test_subject_terms_and_frequency(spark, corpus):
    files, _ = corpus
    q = spark.createDataFrame([(1, "how does the export of workbook files happen to unicorn")], "query_id int, text string")
    df = {r["term"]: r["df"] for r in answers.term_file_frequency(q.select(answers.F.explode(answers.content_words(q.text)).alias("term")), files).collect()}
    slow = {t: sum(1 for p, c in FILES if t in (p + c).lower() or (len(t) >= 6 and t[: max(5, len(t) - 3)] in (p + c).lower())) for t in df}
    assert df == slow and df["unicorn"] == 0
    got = {r["term"] for r in answers.subject_terms(q, files).collect()}
    assert got == {"export", "files", "workbook"}


@pytest.mark.parametrize("q, want", [("so, um, well how does it work here", "how does it work here"), ("so what", "so what"), ("Sort the rows now please", "Sort the rows now please")])
def test_openers(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(answers.strip_openers(answers.F.col("q"))).first()[0] == want


def test_word_support_numbers_and_spans(spark):
    rows = [("The worker retries three times", "the worker retries three times, then stops"), ("The worker retries 5 times", "the worker retries 3 times"), ("It holds dragons", "it holds sheets")]
    df = spark.createDataFrame(rows, "say string, body string")
    got = df.select(audit.F.size(audit.missing_words(df.say, df.body)), audit.numbers_supported(df.say, df.body, df.body)).collect()
    assert [(a, b) for a, b in got] == [(0, True), (0, False), (1, True)]
    spans = spark.sql("""select * from values ('h', 4, 7, 'two', 2), ('x', 4, 7, 'two', 2), ('h', 4, 99, 'two', 2), ('h', 4, 7, 'bad', 2), ('h', 4, 7, 'two', 1) as t(hash, s, e, text, line)""")
    f = spans.select(audit.span_failure(spans.hash, spans.s, spans.e, spans.text, spans.line, audit.F.lit("one\ntwo\n"), audit.F.lit("h")))
    assert [r[0] for r in f.collect()] == [None, "STALE", "OUT_OF_BOUNDS", "TEXT_MISMATCH", "LINE_MISMATCH"]


def test_ordered_tokens_and_citations(spark):
    rows = [(["alpha", "beta"], "alpha then beta"), (["beta", "alpha"], "alpha then beta"), ([], "x")]
    df = spark.createDataFrame(rows, "t array<string>, c string")
    assert [r[0] for r in df.select(audit.ordered_tokens(df.t, df.c)).collect()] == [True, False, True]
    c = spark.createDataFrame([("A [2] b [1][2] c.",)], "s string")
    assert c.select(audit.citation_numbers(c.s), audit.strip_citations(c.s)).first()[:] == ([2, 1], "A b c.")


def test_bonus_paths_and_named_files_rank(spark, corpus):
    files, chunks = corpus
    q = spark.createDataFrame([(0, "what is in job.py"), (1, "unrelated words entirely")], "query_id int, text string")
    got = retrieval.retrieve(q, chunks).collect()
    top = {r["query_id"]: r["path"] for r in got if r["rank"] == 1}
    assert top[0] == "src/export/job.py" and top[1] == "docs/readme.md"


def test_provenance_and_directories(spark, corpus):
    files, _ = corpus
    commits = spark.createDataFrame([(2, "b", ["src/export/job.py"]), (1, "a", ["src/export/job.py", "x"])], "ord int, sha string, files array<string>")
    got = {r["path"]: r["sha"] for r in answers.provenance(files, commits).collect()}
    assert got["src/export/job.py"] == "a" and got["docs/readme.md"] is None
    assert [(r["dir"], r["n"]) for r in answers.top_directories(files).collect()] == [("src", 2), ("docs", 1), ("tests", 1)]
    assert answers.components_under(files, "src").first()["names"] == ["export", "upload"]
