import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselon.llm import mining
from tesselon.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, list int, unit int, q string, key string"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def slow(rows, k=5, m=5, low=80, high=100):
    use = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows
           if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, la, qa in {(i, l, tuple(q)) for i, l, q in use if i % 100 == 0}:
        pos = sorted((-dot(qa, q), i) for i, l, q in use if l == la and i != a)[:k]
        neg = sorted((-dot(qa, q), i) for i, l, q in use if l != la)
        for s, p in pos:
            fit = [(n, i) for n, i in neg if low * -s <= 100 * -n <= high * -s][:m]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def met(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, 1, 2, "a", "b") for i, v, l in rows], SCHEMA)
    return sorted(tuple(r[c] for c in OUT) for r in mining.hard_negatives(df, **kw).collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6))
def test_bounds_hold_and_visits_lose_nothing(seed, n, dim):
    rng = np.random.default_rng(seed)
    x, a = rng.integers(-300, 300, (n, dim)), rng.integers(-300, 300, dim)
    own = rng.integers(0, 4, n)
    centers = np.array([x[own == c].mean(0) if (own == c).any() else np.zeros(dim) for c in range(4)])
    radii = np.array([np.sqrt(((x[own == c] - centers[c]) ** 2).sum(1)).max(initial=0) for c in range(4)])
    low, high = mining.bounds(a, centers, radii)
    score = mining.products(a[None], x)[0]
    assert (score == x @ a).all() and (low[own] <= score).all() and (score <= high[own]).all()
    order = mining.visits(low, high, -1000, 5000, 2000)
    assert list(high[order]) == sorted(high[order], reverse=True)
    assert set(own[(score >= 2000) & (score <= 5000)]) <= set(order)
    assert all(high[c] >= 2000 and low[c] <= 5000 for c in order)


def test_exact_products_beyond_doubles():
    a = np.array([[2**40 + 1, 3], [2**62, 2**62]])
    x = np.array([[2**40 + 1, 5], [2**62, 2**62]])
    got = mining.products(a, x)
    assert got[1, 1] == np.iinfo(np.int64).max and got[0, 0] == np.iinfo(np.int64).max
    assert mining.products(a[:1] // 10**6, x[:1])[0, 0] == ((2**40 + 1) // 10**6) * (2**40 + 1)


def test_against_brute_force_with_clusters_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(mining, "UNIT_ROWS", 60)
    monkeypatch.setattr(mining, "SAMPLE_ROWS", 300)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=6)
    x = np.r_[np.tile(hot, (300, 1)), np.repeat(rng.normal(size=(8, 6)) * 4, 75, 0) + rng.normal(size=(600, 6)) / 5]
    rows = [(int(i) * 10, [float(c) for c in v], int(rng.integers(0, 3))) for i, v in zip(rng.permutation(900), x, strict=True)]
    assert met(spark, rows) == slow(rows)
    assert met(spark, rows, positives=2, negatives=7, low=50, high=90) == slow(rows, 2, 7, 50, 90)


def test_edges(spark):
    v = [1.0, 0.5]
    rows = [(0, v, 1), (0, v, 1), (0, [1.0], 1), (100, v, 2), (1, v, 1), (1, v, 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 3), (None, v, 1), (4, None, 1), (5, v, None),
            (6, [math.nan, 1.0], 1), (7, [math.inf, 1.0], 2), (8, [None, 1.0], 2), (9, [], 2), (200, [-1.0, 0.0], 4), (10, [0.3, 0.0], 4), (300, [0.0, 0.0], 5), (11, [2.0, 2.0, 2.0], 5)]
    assert met(spark, rows) == slow(rows)
    assert met(spark, []) == [] and met(spark, [(0, None, 1)]) == [] and met(spark, [(0, v, 1)]) == []


def test_registered_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in OUT) for r in op12_hard_negatives(spark, sf_dir).collect())
    assert got == slow(rows) and got


def test_asks_are_made_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(mining, "UNIT_ROWS", 10)
    monkeypatch.setattr(mining, "UNITS", 1000)
    monkeypatch.setattr(mining, "ASK_ROWS", 50)
    rng = np.random.default_rng(4)
    x, labels = rng.integers(-9, 9, (400, 3)), rng.integers(0, 3, 400)
    lists = mining.Lists(np.zeros((1, 3)), np.array([99.0]), np.array([400]))
    anchors = pd.DataFrame({"key": range(30), "vec_id": range(30), "label": labels[:30], "q": [r.tobytes() for r in x[:30]], "scores": [[5, 9]] * 30})
    known = np.arange(400), labels, x
    for percent, windows in ((None, 1), ((80, 100), 2)):
        out = list(mining.asks_of(lists, np.array([0]), known, 5, percent)(iter([anchors])))
        assert max(map(len, out)) <= 50
        out = pd.concat(out)
        # each anchor visits all forty units of the only list
        assert sorted(zip(out["key"], out["unit"], strict=True)) == [(a, u) for a in range(30) for u in range(40)]
        assert {len(f) for f in out["floors"]} == {len(t) for t in out["ceilings"]} == {windows}


def test_units_do_not_grow_in_number_with_the_rows():
    of = lambda n: len(mining.Lists(np.zeros((1024, 1)), np.zeros(1024), np.full(1024, n // 1024)).units(np.arange(1024)))
    assert of(100 * 1024) <= 110 and of(600 * 1024) <= 160 and of(1800 * 1024) <= 160
    assert mining.unit_rows(10**9) == mining.UNIT_MOST
