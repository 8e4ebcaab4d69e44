"""Batch twins of the stream operators, trailing context, dedupe and limits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import micros
from tesselon.session import materialize

SPEECH_PROB, ENERGY_FACTOR, ENERGY_MS = 0.5, 2.5, 1000


def latest_text(events: DataFrame) -> DataFrame:
    """STM-05: (id, at, role, text, versions): an event's text is the last one heard, its time the first."""
    return events.filter(F.coalesce("text", F.lit("")) != "").groupBy("id").agg(
        F.min_by("at", "seq").alias("at"), F.min_by("role", "seq").alias("role"), F.max_by("text", "seq").alias("text"),
        F.count_distinct("text").alias("versions"),
    )


def heard_outcomes(events: DataFrame) -> DataFrame:
    """STM-05: every event with its outcome: empty, appended, ignored (same text again) or rewritten."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.coalesce("text", F.lit("")) == ""
    said = F.last(F.when(~blank, F.col("text")), ignorenulls=True).over(w)
    out = F.when(blank, "empty").when(said.isNull(), "appended").when(said == F.col("text"), "ignored").otherwise("rewritten")
    return events.withColumn("outcome", out)


def trailing_context(lines: DataFrame, key: str, order: str, n: int = 4, role: str | None = None) -> DataFrame:
    """WIN-02, WIN-04: the texts of the ``n`` rows before each row (of one role only, if given), oldest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    text = F.col("text") if role is None else F.when(F.col("role") == role, F.col("text"))
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def trailing_seconds(lines: DataFrame, key: str, seconds: int = 15) -> DataFrame:
    """WIN-03: the texts of the last seconds up to each row, system lines left out."""
    w = Window.partitionBy(key).orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    text = F.when(F.col("role") != "system", F.col("text"))
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def previous_question(lines: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-06: the last question before each row that stands alone (not short), else the row before it."""
    w = Window.partitionBy(key).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    alone = F.last(F.when(~F.col("is_short"), F.col("text")), ignorenulls=True).over(back)
    return lines.withColumn("previous", F.coalesce(alone, F.lag("text").over(w)))


def newest_first(rows: DataFrame, key: str, order: str, cap: int = 50) -> DataFrame:
    """WIN-05, SRC-24, STM-12: the last ``cap`` rows of each key, newest first as ``place``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def frame_gaps(frames: DataFrame, frame_ms: float) -> DataFrame:
    """WIN-11: per lane: delivered and expected frames, and the time lost where a gap exceeds a frame by half."""
    w = Window.partitionBy("lane").orderBy("at_ms")
    over = F.col("at_ms") - F.lag("at_ms").over(w) - frame_ms
    rows = frames.select("lane", "at_ms", F.when(over > 0.5 * frame_ms, over).otherwise(0.0).alias("lost"))
    return rows.groupBy("lane").agg(
        F.count("*").alias("delivered"), (F.round((F.max("at_ms") - F.min("at_ms")) / frame_ms).cast("long") + 1).alias("expected"),
        F.sum("lost").alias("lost_ms"), F.count_if(F.col("lost") > 0).alias("gaps"),
    )


def admit(prob: Column, duration_ms: Column, energy: Column, gate: Column) -> Column:
    """STM-04: ``silero``, ``high-energy`` or null where an utterance is dropped."""
    return F.when(prob.isNotNull(), F.when(prob >= SPEECH_PROB, "silero")).when(
        (energy >= gate * ENERGY_FACTOR) & (duration_ms >= ENERGY_MS), "high-energy"
    )


def once(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """STM-07, STM-13: the first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def daily_quota(events: DataFrame, limit: int = 20) -> DataFrame:
    """STM-11: (user_id, day, used, allowed, refused) by the session zone's calendar day."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy("user_id", day).agg(F.count("*").alias("used")).withColumns({
        "allowed": F.least(F.col("used"), F.lit(limit)), "refused": F.greatest(F.col("used") - limit, F.lit(0))
    })


#: Events from which on a user's windows are found by doubling pointers and not in one pass.
HOT_USER_ROWS = 1_000_000


def fixed_window_limit(events: DataFrame, limit: int = 120, seconds: int = 3600, hot_rows: int | None = None) -> DataFrame:
    """STM-10: (user_id, event_id, window_start, allowed) of every event with a time.

    A user's window opens at the first event after the one before has ended, so windows depend on each other. Users of up
    to ``hot_rows`` events pass in order of time, window by window; of larger ones the events are dealt out by time and the
    windows' starts found by doubling pointers. Both give the same; a null user is a user, ties are in order of event_id.
    """
    most = HOT_USER_ROWS if hot_rows is None else hot_rows
    span, kinds = seconds * 1_000_000, events.schema
    rows = events.select("user_id", "event_id", micros("ts").alias("t")).filter("t is not null")
    hot = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = materialize(hot.select(F.struct("user_id").alias("hot")), "hot-users")  # a struct is never null
    out = None
    if hot.isEmpty():
        out = _windows_in_turn(rows, span, limit, kinds)
    else:
        is_hot = F.struct("user_id").eqNullSafe(F.col("hot"))
        few = F.broadcast(hot)  # at most one for each hot_rows events
        if hot.count() > 100_000:
            few = hot
        cold, large = rows.join(few, is_hot, "left_anti"), rows.join(few, is_hot, "left_semi")
        out = _windows_in_turn(cold, span, limit, kinds).unionByName(_windows_by_doubling(large, span, limit))
    return out.select("user_id", "event_id", F.timestamp_micros("start").cast(kinds["ts"].dataType).alias("window_start"), "allowed")


def _windows_in_turn(rows: DataFrame, span: int, limit: int, kinds) -> DataFrame:
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")

    def limit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n, first = None, 0, 0, True
        for b in batches:
            t, names = b["t"].to_numpy(), b["u"].to_numpy()
            starts, counts = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            ends = np.r_[np.flatnonzero(names[1:] != names[:-1]) + 1, len(b)] if len(b) else []
            at = 0
            for end in ends:
                if first or names[at] != user:
                    user, first, n, start = names[at], False, 0, int(t[at])
                while at < end:
                    if t[at] - start >= span:
                        start, n = int(t[at]), 0
                    to = at + int(np.searchsorted(t[at:end], start + span))
                    starts[at:to], counts[at:to] = start, np.arange(n + 1, n + 1 + to - at)
                    n, at = n + to - at, to
            yield pd.DataFrame({"u": b["u"], "e": b["e"], "start": starts, "n": counts})

    # keys travel as text: a null among numbers would make floats of them
    named = rows.select(F.col("user_id").cast("string").alias("u"), F.col("event_id").cast("string").alias("e"), "t")
    out = named.mapInPandas(limit_rows, "u string, e string, start long, n long")
    return out.select(
        F.col("u").cast(kinds["user_id"].dataType).alias("user_id"), F.col("e").cast(kinds["event_id"].dataType).alias("event_id"),
        "start", (F.col("n") <= limit).alias("allowed"))


def _windows_by_doubling(rows: DataFrame, span: int, limit: int) -> DataFrame:
    """Time is cut into buckets of one span, so a window starts at most once in each, and an event's window starts in its bucket or the one before.

    next(t), the first event from t + span on, is in the next bucket or the first of a later one. The starts are what next
    reaches from the first event: with 2^i steps known for every event, a round doubles both the steps and the reach.
    """
    rows = materialize(rows.withColumn("b", F.floor(F.col("t") / span).cast("long")), "windows-rows")
    nodes = rows.select("user_id", "b", "t").distinct()
    first = nodes.groupBy("user_id", "b").agg(F.min("t").alias("first"))
    # a user has one row a bucket here, as many as spans in the time covered
    later = first.select("user_id", "b", F.min("first").over(Window.partitionBy("user_id").orderBy("b").rangeBetween(2, Window.unboundedFollowing)).alias("later"))
    asks = nodes.select("user_id", (F.col("b") + 1).alias("b"), (F.col("t") + span).alias("at"), F.col("t").alias("of"), F.lit(None).cast("long").alias("here"))
    found = asks.unionByName(nodes.select("user_id", "b", F.col("t").alias("at"), F.lit(None).cast("long").alias("of"), F.col("t").alias("here")))
    ahead = Window.partitionBy("user_id", "b").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    found = found.withColumn("next", F.min("here").over(ahead)).filter("of is not null").select("user_id", (F.col("b") - 1).alias("b"), F.col("of").alias("t"), "next")
    same = lambda a, b, *more: functools.reduce(lambda x, y: x & y, [F.col(f"{a}.user_id").eqNullSafe(F.col(f"{b}.user_id")), *more])
    jump = found.alias("f").join(later.alias("l"), same("f", "l", F.col("f.b") == F.col("l.b"))).select(
        "f.user_id", "f.t", F.coalesce("f.next", "l.later").alias("to"))
    jump = materialize(jump, "windows-jumps")
    starts = materialize(nodes.groupBy("user_id").agg(F.min("t").alias("t")), "windows-starts")
    while True:
        more = starts.alias("s").join(jump.alias("j"), same("s", "j", F.col("s.t") == F.col("j.t"))).filter("j.to is not null").select("s.user_id", F.col("j.to").alias("t"))
        more = materialize(more, "windows-more")
        if more.isEmpty():
            break
        starts = materialize(starts.unionByName(more), "windows-starts")
        # an event whose steps lead out of the data has no jump any more
        jump = materialize(jump.alias("a").join(jump.alias("b"), same("a", "b", F.col("a.to") == F.col("b.t"))).filter("b.to is not null").select("a.user_id", "a.t", "b.to"), "windows-jumps")
    marks = starts.select("user_id", F.explode(F.array(F.floor(F.col("t") / span).cast("long"), F.floor(F.col("t") / span).cast("long") + 1)).alias("b"), "t", F.col("t").alias("mark"))
    marks = marks.withColumns({"event_id": F.lit(None).cast(rows.schema["event_id"].dataType), "real": F.lit(False)})
    both = rows.withColumns({"mark": F.lit(None).cast("long"), "real": F.lit(True)}).unionByName(marks)
    upto = Window.partitionBy("user_id", "b").orderBy("t", "real").rowsBetween(Window.unboundedPreceding, 0)
    # marks come first of equals; the mark of the bucket before stands at its own time, before all events of this one
    placed = both.withColumn("start", F.last("mark", ignorenulls=True).over(upto)).filter("real").select("user_id", "event_id", "t", "start")
    placed = materialize(placed, "windows-placed")
    # the last allowed event of each window: its first rows alone are kept before they are shuffled
    order = Window.partitionBy("user_id", "start").orderBy("t", "event_id")
    last = placed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).groupBy("user_id", "start").agg(
        F.max_by(F.struct("t", "event_id"), "n").alias("cut"))
    met = placed.alias("p").join(last.alias("c"), same("p", "c", F.col("p.start") == F.col("c.start")), "left")
    ok = F.coalesce(F.struct("p.t", "p.event_id") <= F.col("c.cut"), F.lit(False))
    return met.select("p.user_id", "p.event_id", "p.start", ok.alias("allowed"))
