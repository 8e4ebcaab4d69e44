import pytest
from pyspark.sql import functions as F

from tesselon.functions import spoken, verify
from tesselon.operators import audit

DOC = "The upload worker retries a failed transfer three times.\nIt never deletes the source file.\nThe exporter runs after the indexer and waits 40 seconds."


def words(line):
    return [w for w in dict.fromkeys(x.strip(".,").lower() for x in line.split()) if len(w) >= 4 and w in DOC.lower() and w not in audit.GLUE]


@pytest.mark.parametrize("line, faults", [
    ("The upload worker retries a failed transfer three times.", []),
    ("It deletes the source file.", ["negation"]),
    ("It never deletes the source file.", []),
    ("The upload worker retries a failed transfer five times.", ["numeric"]),
    ("The worker never retries a failed transfer.", ["negation", "numeric"]),
    ("The indexer runs after the exporter.", ["numeric", "phrase_order"]),
    ("The exporter waits 40 minutes.", ["numeric"]),
])
def test_faults(line, faults):
    assert verify.check(line, words(line), DOC) == faults


def test_parts():
    assert verify.split_clauses("a one; b two, c three. D four and e is five") == ["a one", "b two", "c three.", "D four", "e is five"]
    assert verify.split_blocks("// first part\n// goes on.\n# Second. Third.") == ["first part goes on.", "second.", "third."]
    assert verify.numbers("two of 3.5 and the first") == {"2", "3.5", "1"}


def test_on_tables(spark):
    rows = [("It deletes the source file.", DOC), ("It never deletes the source file.", DOC), (None, None)]
    df = spark.createDataFrame(rows, "say string, body string")
    got = df.select(verify.semantic_faults(df.say, audit.content_tokens(df.say), df.body).alias("f")).collect()
    assert [list(r["f"]) for r in got] == [["negation"], [], []]


@pytest.mark.parametrize("raw, want", [
    ("So, um, where is the upload handled?", "where is the upload handled?"), ("Where's the config — I mean the template config?", "Where's the template config?"),
    ("does the worker, sorry, does the ingest worker retry", "does the ingest worker retry"), ("what does it actually do", "what does it do"), ("the actual retry count", "the actual retry count"),
    ("are there tests around this?", "are there tests this?"), ("so", "so"), ("", ""),
])
def test_normalize(raw, want):
    assert spoken.normalize(raw) == want


@pytest.mark.parametrize("q, subject, entities, want", [
    ("what happens after that?", ["upload"], [], "what happens after upload"), ("what does this service do", [], ["upload-service"], "what does upload-service do"),
    ("what does this service do", [], ["a-service", "b-service"], None), ("why", ["retry"], ["worker"], "why worker retry"), ("where is it stored", ["token"], [], "where is token stored"),
    ("where is it stored", [], [], None), ("what does this contract say about termination", ["x"], [], "what does this contract say about termination"), ("where is the exporter", [], [], "where is the exporter"),
])
def test_resolve(q, subject, entities, want):
    assert spoken.resolve(q, subject, entities) == want


def test_spoken_columns(spark):
    df = spark.createDataFrame([("um, where is it stored", ["token"], []), (None, None, None)], "q string, s array<string>, e array<string>")
    out = df.select(spoken.resolve_spoken(spoken.normalize_spoken(df.q), df.s, df.e)).collect()
    assert [r[0] for r in out] == ["where is token stored", None]
    assert df.select(spoken.is_replay(F.lit("A line!"), F.lit("a  line"))).first()[0]
