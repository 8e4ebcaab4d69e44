"""Windows that depend on the one before: users in one pass and users by doubling pointers against a plain loop."""

import random

from tesselon.operators import sessions

SCHEMA = "user_id long, event_id long, ms long, t long, b string"


def slow(rows, limit, seconds):
    out, state = {}, {}
    for u, e, ms, _, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        start, n = state.get(u, (None, 0))
        if start is None or ms - start >= seconds * 1000:
            start, n = ms, 0
        state[u] = (start, n + 1)
        out[e] = (u, start, n + 1 <= limit)
    return out


def test_both_ways_against_a_loop(spark):
    rng = random.Random(5)
    rows, now = [], 1_700_000_000_000
    for i in range(700):
        now += rng.choice([0, 1, 7_000, 29_999, 30_000, 30_001, 200_000]) // rng.choice([1, 3])
        user = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((user, i, now if rng.random() > 0.02 else None, 5, "clash"))
    rows += [(9, 1000 + i, 1_700_000_000_000 + i % 3, 5, "") for i in range(100)]  # one burst
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "timestamp_millis(ms) ts")
    want = slow(rows, 2, 30)
    for hot_rows in (None, 0, 150):
        got = sessions.fixed_window_limit(df, limit=2, seconds=30, hot_rows=hot_rows).selectExpr("user_id", "event_id", "unix_millis(window_start) s", "allowed").collect()
        assert {r["event_id"]: (r["user_id"], r["s"], r["allowed"]) for r in got} == want and len(got) == len(want)
    assert sessions.fixed_window_limit(df.limit(0), hot_rows=0).collect() == []
