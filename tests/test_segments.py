"""The growing index against one built at once, after random batches."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tesselon.operators import segments
from tesselon.operators.retrieval import postings


def build(files):
    # two chunks a source
    return files.select("source_id", "path", F.explode(F.split("text", r"\|")).alias("text")).withColumn("chunk_id", F.concat("path", F.lit("#"), F.xxhash64("text").cast("string")))


def rows(df):
    return Counter(tuple(r) for r in df.select("chunk_id", "term", "body", "path_tf").collect())


def test_random_batches(spark, tmp_path):
    rnd = random.Random(7)
    index = segments.PostingIndex(spark, str(tmp_path / "index"), build, fanout=2).create()
    assert index.postings() is None and index.frequencies() is None and index.merge() == []
    state, merged = {}, 0
    for n in range(4):
        ups = {f"s{rnd.randint(0, 11)}": " ".join(rnd.choice(["alpha", "betaGamma", "indexes", "of|", "x_y"]) for _ in range(rnd.randint(0, 8))) + f"|{rnd.randint(0, 2)}" for _ in range(7)}
        gone = {f"s{rnd.randint(0, 11)}" for _ in range(2)} if n else set()
        again = dict(list(state.items())[:2])  # sent as they are
        batch = {**ups, **again}
        df = spark.createDataFrame([(s, t, f"p/{s}", t) for s, t in batch.items()], "source_id string, content_hash string, path string, text string")
        counts = index.apply(df, spark.createDataFrame([(s,) for s in gone], "source_id string"))
        changed = {s for s, t in batch.items() if state.get(s) != t}
        ended = {s for s in state if s in changed or (s in gone and s not in batch)}
        assert counts == {"written": len(changed), "ended": len(ended), "kept": len(batch) - len(changed)}
        for s in gone - set(batch):
            state.pop(s, None)
        state.update(batch)
        merged += len(index.merge())
        chunks = build(spark.createDataFrame([(s, f"p/{s}", t) for s, t in state.items()], "source_id string, path string, text string"))
        want = rows(postings(chunks))
        assert rows(index.postings()) == want
        assert {r["term"]: r["df"] for r in index.frequencies().collect()} == Counter(t for _, t, _, _ in want.elements())
        assert {r["source_id"]: r["content_hash"] for r in index.sources().collect()} == state
    assert merged and len(index._version()[1]) < 4


def test_nothing_changes_and_odd_rows(spark, tmp_path):
    index = segments.PostingIndex(spark, str(tmp_path / "index"), build).create()
    schema = "source_id string, content_hash string, path string, text string"
    df = spark.createDataFrame([("a", "1", "p/a", "one"), ("a", "2", "p/a", "two"), (None, "3", "p/n", "null id"), ("b", "4", "p/b", "")], schema)
    assert index.apply(df) == {"written": 2, "ended": 0, "kept": 0}
    version = index._version()
    assert index.apply(df) == {"written": 0, "ended": 0, "kept": 2} and index._version() == version
    assert index.apply(df.limit(0), spark.createDataFrame([("zz",)], "source_id string")) == {"written": 0, "ended": 0, "kept": 0}
    assert {r["term"] for r in index.postings().collect() if r["body"]} == {"two"}
    assert index.apply(df.limit(0), spark.createDataFrame([("a",), ("b",)], "source_id string"))["ended"] == 2
    assert index.postings().count() == 0 and index.frequencies().count() == 0 and index.sources().count() == 0
