"""Values at ranks by passes of counts against sorting."""

import math
import random

from tesselon.operators import metrics


def test_ranks_against_sorting(spark):
    rng = random.Random(9)
    draw = {"flat": lambda: rng.random(), "tail": lambda: 10 ** rng.uniform(-300, 300), "few": lambda: float(rng.randint(0, 3)), "one": lambda: 7.0, "inf": lambda: rng.choice([1.0, 2e308, 1e308, 3.0])}
    rows = [(k, f(), 1) for k, f in draw.items() for _ in range(200)] + [(None, 5.0, 1), (None, 1.0, 1), ("none", None, 1), ("none", -1.0, 1), ("none", math.nan, 1), ("zero", 0.0, 1), ("zero", -0.0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, n int")
    ranks = {"p50": metrics.nearest_rank(0.5), "p99": metrics.nearest_rank(0.99), "p0": metrics.nearest_rank(0.0)} | metrics.MEDIAN_RANKS
    for bins in (200,):
        got = {r["k"]: (r["n"], r["p50"], r["p99"], r["p0"], r["lower"], r["upper"]) for r in metrics.exact_ranks(df, ["k"], "v", ranks, bins=bins).collect()}
        for k in {k for k, _, _ in rows}:
            v = sorted(x for g, x, _ in rows if g == k and x is not None and not math.isnan(x) and x >= 0)
            n = len(v)
            want = (n, *(v[max(1, math.ceil(p * n)) - 1] for p in (0.5, 0.99, 0.0)), v[(n + 1) // 2 - 1], v[n // 2]) if n else (0,) + (None,) * 5
            assert got[k] == want, (k, bins)
    assert metrics.exact_ranks(df.limit(0), ["k"], "v", ranks).collect() == []


def test_diversified_against_a_slow_form_sends_rows_once(spark):
    import random

    from tesselon.operators import retrieval

    rng = random.Random(8)
    rows = [(q, f"c{q}-{i}", f"p{rng.randint(0, 9)}", rng.choice(["code", "why"]), i, rng.choice([0.3, 0.55, 0.7, 0.9, 1.0, 1.2, 2.0, 9.0 * (q % 3)]), q % 2 == 0) for q in range(12) for i in range(rng.randint(1, 60))]
    rows = [r for r in rows if r[5] > 0]
    want = []
    for q in {r[0] for r in rows}:
        own, low = [r for r in rows if r[0] == q], q % 2 == 0
        files = {}
        for r in own:
            files.setdefault(r[2], []).append(r)
        worth = {p: round(max(r[5] for r in f) + min(0.5 * max(r[5] for r in f), 0.2 * (sum(r[5] for r in f) - max(r[5] for r in f))), 6) for p, f in files.items()}
        floor = max(0.6 if low else 1.0, 0.12 * max(worth.values()))
        place = {p: k for k, p in enumerate(sorted(files, key=lambda p: (-worth[p], min(r[4] for r in files[p]))))}  # noqa: B023
        kept = []
        for p, f in files.items():
            f, n = sorted((r for r in f if r[5] >= floor), key=lambda r: (-r[5], r[4])), {"code": 0, "why": 0}
            some = [r for r in f if (n.update({r[3]: n[r[3]] + 1}) or n[r[3]] <= 2)]
            kept += [(k, place[p], r) for k, r in enumerate(some[:3])]
        first = [(t, r) for t, (_, _, r) in enumerate(sorted(kept)[:6])]
        want += [(q, k + 1, r[1]) for k, (_, r) in enumerate(sorted(first, key=lambda x: (-x[1][5], x[0])))]
    scored = spark.createDataFrame(rows, "query_id long, chunk_id string, path string, kind string, ord long, score double, low_floor boolean")
    out = retrieval.diversified(scored, 6, 6)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in out.collect()) == sorted(want)
    # what is left after the floor travels in the first rows of each query alone
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "path" not in "".join(x for x in plan.split("\n") if "Join" in x)
