import random

import pytest

from tesselon.streaming import events as ev
from tesselon.streaming import lanes


def write_in_turn(df, src, files):
    """One file after the other, so that a stream reads them in order of seq."""
    top = df.agg({"seq": "max"}).first()[0] + 1
    for i in range(files):
        df.filter(f"seq >= {top * i // files} and seq < {top * (i + 1) // files}").coalesce(1).write.mode("append").parquet(src)


def run(spark, df, transform, tmp_path, name, files=3):
    """The rows of a stream that reads ``df`` from files, one a trigger."""
    src = str(tmp_path / f"{name}-src")
    write_in_turn(df, src, files)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def frames(seed, n=400):
    rng = random.Random(seed)
    out, at, speaking = [], 0.0, False
    for _ in range(n):
        if rng.random() < 0.08:
            speaking = not speaking
        level = rng.uniform(0.05, 0.2) if speaking else rng.uniform(0.0001, 0.004)
        out.append((at, level, 30.0, 480, None))
        at += 30.0
    return out


def test_gate_opens_with_pre_roll_and_closes_after_the_hangover():
    lane, done = lanes.Lane(0.01), []
    for i in range(200):
        x = lane.push(i * 30.0, 0.2 if 40 <= i < 80 else 0.001, 30.0, 480, None)
        if x:
            done.append(x)
    (seq, start, end, n, buffered, voiced, energy, prob, forced, outcome), = done
    assert outcome == "high-energy" and not forced and voiced == 40 * 30
    # the pre-roll holds at least half a second before the first voiced frame, and at most a frame more
    assert 470 <= 40 * 30 - start <= 500 and 900 <= end - 79 * 30 < 930


def test_floor_moves_on_unvoiced_idle_frames_only():
    lane = lanes.Lane(0.01)
    lane.push(0, 0.02, 30, 480, None)
    assert lane.floor == 0 and lane.active
    lane = lanes.Lane(0.01)
    lane.push(0, 0.009, 30, 480, None)
    assert lane.floor == 0.009 and lane.gate() == pytest.approx(0.0162)


def test_short_fragments_are_held_and_joined():
    lane, done = lanes.Lane(0.01), []
    speech = {*range(20, 27), *range(62, 70)}
    for i in range(150):
        x = lane.push(i * 30.0, 0.3 if i in speech else 0.001, 30.0, 480, None)
        if x:
            done.append(x)
    assert [d[-1] for d in done] == ["held", "high-energy"] and done[1][5] == 15 * 30


def test_long_speech_is_cut_and_goes_on():
    lane = lanes.Lane(0.01)
    done = [x for i in range(600) if (x := lane.push(i * 30.0, 0.3, 30.0, 480, 0.9))]
    assert len(done) == 2 and all(d[8] and d[9] == "speech" for d in done) and lane.active


def test_lane_stream_equals_batch(spark, tmp_path):
    rows = [(lane, i, *f) for lane in "abc" for i, f in enumerate(frames(ord(lane)))]
    df = spark.createDataFrame(rows, "lane string, seq int, at_ms double, level double, ms double, samples int, prob double")
    key = lambda rs: sorted((r["lane"], r["seq"], r["start_ms"], r["end_ms"], round(r["energy"], 9), r["outcome"]) for r in rs)
    batch = key(lanes.segment_batch(df).collect())
    assert batch and key(run(spark, df, lanes.segment_stream, tmp_path, "lanes")) == batch


def test_quota_and_once_and_merge(spark, tmp_path):
    rows = [(i, i % 3, i % 5, i) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, user_id long, k long, s long").selectExpr("*", "timestamp_seconds(s * 3600) ts")
    once = run(spark, df, lambda s: ev.once_stream(s, ["user_id", "k"], "100 hours"), tmp_path, "once", 1)
    assert len(once) == 15
    src, table = str(tmp_path / "m-src"), str(tmp_path / "m")
    write_in_turn(df, src, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).select("user_id", "seq")
    q = stream.writeStream.foreachBatch(ev.merge_latest(table, ["user_id"], "seq")).option("checkpointLocation", str(tmp_path / "m-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["user_id"]: r["seq"] for r in spark.read.parquet(f"{table}/v0").collect()}
    assert got == {0: 57, 1: 58, 2: 59}
    q = ev.daily_quota_stream(spark.readStream.schema(df.schema).parquet(src), 20, "1 hour").writeStream.format("memory").queryName("quota")
    q = q.option("checkpointLocation", str(tmp_path / "q-cp")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["used"] for r in spark.table("quota").collect()) == 60
