"""Streams with timers against their batch twins, and the twins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tesselon.operators import sessions
from tesselon.streaming import timers


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timers.timed_state(spark)
    yield
    spark.conf.set(key, before)


def run(spark, df, transform, tmp_path, name, files=3):
    """Rows of a stream over ``df`` in order of ms; a row far in the future moves the watermark past all else."""
    src, n = str(tmp_path / f"{name}-src"), df.count()
    rows = df.orderBy("ms", "seq").collect()
    for i in range(files):
        spark.createDataFrame(rows[n * i // files : n * (i + 1) // files], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "0 seconds")
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    return [tuple(r) for r in spark.table(name).collect()], progress[-1]["stateOperators"][0]["numRowsTotal"]


def answers(n=90):
    rng, now, rows = random.Random(3), 1_000_000, []
    for i in range(n):
        now += rng.choice([1_000, 5_000, 20_000, 45_000, 90_000])
        rows.append((rng.randrange(4), i, now, f"t{i}", rng.choice([None, "", "yes"]), rng.random() < 0.6))
    return rows + [(77, 999, now + 10**9, "z", None, False)]


THREADS = "meeting_id long, seq long, ms long, topic string, say string, follow_up boolean"


def slow_threads(rows, ttl=45_000):
    out, at = [], {}
    for m, seq, ms, topic, say, follow in sorted(rows, key=lambda r: (r[2], r[1])):
        t = at.get(m)
        if t and ms - t[1] >= ttl:
            out.append((m, "ended", t[2], t[0], t[1] + ttl))
            t = None
        out.append((m, "reach", seq, t and t[0], ms))
        at[m] = (topic, ms, seq) if say else t if follow else None
    return out + [(m, "ended", t[2], t[0], t[1] + ttl) for m, t in at.items() if t]


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_threads_end_by_timer(spark, tmp_path):
    rows = answers()
    df = spark.createDataFrame(rows, THREADS)
    want = key(slow_threads(rows))
    assert key(timers.thread_rows(df).collect()) == want and any("ended" in r for r in want)
    got, left = run(spark, df, timers.threads, tmp_path, "threads_timed")
    assert key(got) == want and left == 0


def test_heard_ids_end_by_timer(spark, tmp_path):
    rng, now, rows = random.Random(4), 0, []
    for i in range(120):
        now += rng.choice([1_000, 30_000, 200_000])
        rows.append((rng.randrange(5), i, now, rng.choice([None, "", "a", "b", "b"])))
    rows.append((99, 1000, now + 10**9, None))
    df = spark.createDataFrame(rows, "id long, seq long, ms long, text string")
    batch = key(timers.heard_rows(df).collect())
    out, said = [], {}
    for i, seq, ms, text in rows:
        s = said.get(i)
        if s and ms - s[1] >= 600_000:
            out.append((i, "final", s[3], s[0], s[2]))
            s = None
        kind = "empty" if not text else "appended" if s is None else "ignored" if s[0] == text else "rewritten"
        if text:
            s = (text, ms, (s[2] if s else 0) + (kind in ("appended", "rewritten")), seq)
        said[i] = s
        out.append((i, kind, seq, text or None, s[2] if s else 0))
    out += [(i, "final", s[3], s[0], s[2]) for i, s in said.items() if s]
    assert batch == key(out)
    got, left = run(spark, df, timers.heard, tmp_path, "heard_timed")
    assert key(got) == batch and left == 0


def test_gates_of_meetings_that_end(spark, tmp_path):
    rng, now, rows = random.Random(6), 0, []
    for i in range(80):
        now += rng.choice([1_000, 60_000, 1_900_000])
        rows.append((rng.randrange(3), i, i, now, rng.randrange(20), rng.choice(["them", "you"])))
    df = spark.createDataFrame(rows, "meeting_id long, id long, seq long, ms long, ordinal long, role string")
    batch = key(timers.gate_rows(df).collect())
    out, seen = [], {}
    for m, i, seq, ms, ordinal, role in rows:
        top, at = seen.get(m, (-1, ms))
        top = -1 if ms - at >= 3_600_000 else top
        out.append((m, i, seq, role == "them" and ordinal >= top))
        seen[m] = (max(top, ordinal) if role == "them" else top, ms)
    assert batch == key(out)
    assert key(run(spark, df, timers.newest_gate, tmp_path, "gates_timed")[0]) == batch


def test_rate_windows_end_by_timer(spark, tmp_path):
    rng, now, rows = random.Random(2), 0, []
    for i in range(150):
        now += rng.randrange(30)
        rows.append((i, i, rng.randrange(4), now * 1000))
    rows.append((999, 999, 99, (now + 10**6) * 1000))
    df = spark.createDataFrame(rows, "seq long, event_id long, user_id long, ms long")
    got, left = run(spark, df, lambda s: timers.rate_limits(s, 3, 120), tmp_path, "limits_timed")
    want = sessions.fixed_window_limit(df.withColumn("ts", F.timestamp_millis("ms")), 3, 120).collect()
    assert sorted((e, a) for _, e, _, a in got) == sorted((r["event_id"], r["allowed"]) for r in want) and left == 1
    assert not all(a for *_, a in got)


def test_results_of_older_epochs_are_dropped(spark, tmp_path):
    rng, rows = random.Random(8), []
    for s in range(4):
        now = 0
        for e in range(25):
            now += rng.choice([1, 20, 300])
            rows.append((s, e, now, now + rng.choice([0, 1, 10, 250, 500])))
    base = spark.createDataFrame([*rows, (9, 0, 10**6, 10**6)], "session_id long, epoch long, asked long, came long")
    req = base.select("session_id", "epoch", F.timestamp_seconds("asked").alias("ts"))
    res = base.select("session_id", "epoch", F.timestamp_seconds("came").alias("ts"), F.col("epoch").alias("payload"))
    want = sorted((s, e) for s, e, _, came in rows if not any(s2 == s and e2 > e and came - 600 < a2 <= came for s2, e2, a2, _ in rows))
    got = sorted((r["session_id"], r["epoch"]) for r in timers.fresh_results(req, res).collect())
    assert got == [*want, (9, 0)] and 0 < len(want) < len(rows)
    for name, df in (("req", req), ("res", res)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    stream = [spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in (("req", req), ("res", res))]
    q = timers.fresh_results(*stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    # the row that moved the watermark is still waiting for its own time to pass
    assert sorted((r["session_id"], r["epoch"]) for r in spark.table("fresh").collect()) == want
