"""Joins with hot keys and the set-similarity join against all pairs."""

import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselon.operators import audit, joins


def test_chunked_join_is_a_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(i, rng.choice(["hot", "hot", "b", "left", None])) for i in range(120)], "a long, k string")
    right = spark.createDataFrame([(i, rng.choice(["hot", "b", "right", None])) for i in range(90)], "b long, k string")
    want = sorted((r["a"], r["b"]) for r in left.join(right, "k").collect())
    assert sorted((r["a"], r["b"]) for r in joins.chunked_join(left, right, ["k"], rows=7).collect()) == want
    got = joins.chunked_join(left, right, ["k"], F.col("l.a") < F.col("r.b"), rows=7).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a, b in want if a < b]
    assert joins.chunked_join(left.limit(0), right, ["k"]).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.6, 2 / 3, 0.75, 0.8, 1.0]))
def test_similar_sets_against_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words = words + [rng.choice([f"w{rng.randint(0, 30)}", "common", None])] if rng.random() < 0.6 or not words else words[1:]
        rows.append((i, words if rng.random() > 0.03 else None))
    df = spark.createDataFrame([(i, w, "x", 1) for i, w in rows], "id long, words array<string>, ws string, n int")
    sets = {i: frozenset(x for x in w or [] if x) for i, w in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r["id"]: r["class_id"] for r in joins.set_classes(df).collect()} == {i: first[s] for i, s in sets.items()}
    reps = sorted(first.values())
    share = lambda a, b: Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    want = {(a, b): float(share(a, b)) for a in reps for b in reps if a < b and float(share(a, b)) >= threshold}
    assert {(r["a"], r["b"]): r["jaccard"] for r in joins.similar_sets(df, threshold).collect()} == want


def test_opposed_lines_against_all_pairs_with_hot_keys(spark):
    from tesselon.functions import text as tx

    rng = random.Random(2)
    words = ["ship", "keep", "drop", "friday", "monday", "service", "not", "never", "12", "30k", "q1", "launch", "the", "limit"]
    rows = [(i, rng.choice(["Ann", "ann", "Bo", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), rng.choice(["supported", "open"]), rng.choice(["m1", "m2"])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, speaker string, text string, status string, meeting string")
    got = {(r["id"], r["related_id"]) for r in audit.contradiction_pairs(df, df, "meeting", rows=5).collect()}
    # every pair, by the rule itself
    f = audit._features(df, "a", "meeting").join(audit._features(df.filter("status = 'supported'"), "b", "meeting"), "g").filter("id_a != id_b")
    side = lambda s: {k: F.col(f"{k}_{s}") for k in ("kw", "neg", "qty", "time")}
    related = (F.col("speaker_a") == F.col("speaker_b")) | (F.size(F.array_intersect("kw_a", "kw_b")) >= 2) | (F.col("sched_a") & F.col("sched_b"))
    want = {(r["id_a"], r["id_b"]) for r in f.filter(related & tx.says_opposite(side("a"), side("b"))).select("id_a", "id_b").collect()}
    assert got == want and len(want) > 100


def test_similar_sets_with_hot_words_and_long_sets(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK_ROWS", 7)
    rng = random.Random(5)
    base = [[f"b{k}w{i}" for i in range(rng.randint(1, 400))] for k in range(6)]
    rows = [(f"d{i}", [w for w in base[i % 6] if rng.random() > 0.08] + ["hot"] * (i % 3 > 0)) for i in range(60)] + [(f"h{i}", ["hot", f"x{i // 2}"]) for i in range(40)]
    sets = {i: frozenset(w) for i, w in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    share = lambda a, b: Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]) or 1)
    want = {(a, b): float(share(a, b)) for a in reps for b in reps if a < b and float(share(a, b)) >= 0.7}
    got = {(r["a"], r["b"]): r["jaccard"] for r in joins.similar_sets(spark.createDataFrame(rows, "id string, words array<string>"), 0.7).collect()}
    assert got == want and len(want) > 100


def test_candidates_read_units_across_batches_and_words_travel_once():
    import numpy as np
    import pyarrow as pa

    ws = [sorted(random.Random(i // 2).sample(range(1000), 20)) for i in range(30)]
    p = joins._coarse(joins._parities(pa.array(ws, pa.list_(pa.int64()))))
    cols = {"w": [5] * 30, "i": [0] * 30, "j": [0] * 30, "c": [0] * 30, "r": range(30), "n": [20] * 30, "at": [0] * 30}
    whole = pa.RecordBatch.from_arrays([*(pa.array(list(v), pa.int64()) for v in cols.values()), p], [*cols, "p"])
    for step in (1, 4, 30):
        out = joins._candidates(0.8)(iter([whole.slice(k, step) for k in range(0, 30, step)]))
        got = {(int(a), int(b)) for o in out for a, b in zip(*(np.array(c) for c in o.columns), strict=True)}
        assert got == {(k, k + 1) for k in range(0, 30, 2)}
    # the most that two sets can differ by is never less than what their parities show
    fine = joins._differing(joins._parities(pa.array(ws[:-1], pa.list_(pa.int64()))), joins._parities(pa.array(ws[1:], pa.list_(pa.int64())))).to_pylist()
    assert all(d <= len(set(a) ^ set(b)) for d, a, b in zip(fine, ws[:-1], ws[1:], strict=True)) and fine[0] == 0 and fine[1] > 30
