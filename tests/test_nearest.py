"""Cosine top-k with bounds against all pairs, on clustered, isotropic and repeated vectors."""

import math

import numpy as np

from tesselon.operators import nearest, retrieval


def slow(queries, vectors, limit, floor=0.3):
    out = set()
    for q, a in queries:
        row = []
        for c, b in vectors:
            if a is not None and b is not None and all(x is not None and math.isfinite(x) for x in [*a, *b]) and any(a) and any(b):
                cos = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                if cos > floor:
                    row.append((-round(cos * 10, 9), c))
        out |= {(q, c, -s) for s, c in sorted(row)[:limit]}
    return out


def met(spark, queries, vectors, limit):
    q = spark.createDataFrame([(i, v, "x") for i, v in queries], "query_id long, vector array<double>, ids string")
    v = spark.createDataFrame([(i, v, 1) for i, v in vectors], "chunk_id string, vector array<double>, r int")
    return {(r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in retrieval.semantic_scores(q, v, limit, 9).collect()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PIECE_ROWS", 37)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 100)
    rng = np.random.default_rng(2)
    x = np.r_[np.repeat(rng.normal(size=(6, 24)) * 3, 60, 0) + rng.normal(size=(360, 24)), rng.normal(size=(200, 24)), np.tile(rng.normal(size=24), (80, 1))]
    vectors = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("zero", [0.0] * 24), ("nan", [math.nan] * 24)]
    queries = [(i, x[i * 40].tolist()) for i in range(16)] + [(90, None), (91, [0.0] * 24)]
    assert met(spark, queries, vectors, 10) == slow(queries, vectors, 10)


def test_lengths_that_differ_and_nothing(spark):
    vectors = [("a", [1.0, 0.0, 5.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])]
    queries = [(1, [1.0, 0.0]), (2, [0.5, 0.5, 0.5])]
    cut = lambda a, b: (a[: min(len(a), len(b))], b[: min(len(a), len(b))])
    want = set()
    for q, a in queries:
        for c, b in vectors:
            u, w = cut(a, b)
            cos = np.dot(u, w) / (np.linalg.norm(u) * np.linalg.norm(w))
            if cos > 0.3:
                want.add((q, c, round(float(cos) * 10, 9)))
    assert met(spark, queries, vectors, 10) == want
    assert met(spark, queries[:1], [], 10) == set() and met(spark, [], vectors, 10) == set()

