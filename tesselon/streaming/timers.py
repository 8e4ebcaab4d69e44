"""Keyed streams whose state ends by itself: an event-time timer per key gives state back, and requests meet results in a join of two streams.

State lives in the state store that keeps timers (RocksDB); :func:`timed_state` names it for the session. Events need a
time and a watermark; what comes later than the watermark is dropped by Spark. A key's outcome does not depend on how
its rows fall into batches: what a timer would have ended is also ended by the first row after that time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesselon.functions.scalars import micros

THREAD_TTL_MS = 45_000
#: Rows, the state before them -> rows to emit, the state after them, when that ends in ms (None: there is none).
Step = Callable[[tuple, pd.DataFrame, tuple | None], tuple[list[tuple], tuple | None, int | None]]
#: Key and state that has ended -> rows to emit.
End = Callable[[tuple, tuple], list[tuple]]


def timed_state(spark: SparkSession) -> None:
    """Streams of this session keep state in RocksDB, which holds timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class EndingState(StatefulProcessor):
    """One value a key, with the one timer that ends it."""

    def __init__(self, state: str, columns: list[str], step: Step, end: End):
        self.state, self.columns, self.step, self.end = state, columns, step, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.value.get()) if self.value.exists() else None
        out, after, ends = self.step(key, pd.concat(list(rows)), before)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after is None:
            self.value.clear()
        else:
            self.value.update(after)
            self.handle.registerTimer(ends)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.end(key, tuple(self.value.get())) if self.value.exists() else []
        self.value.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: str, schema: str, state: str, step: Step, end: End) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return events.groupBy(key).transformWithStateInPandas(EndingState(state, columns, step, end), schema, "Append", "EventTime")


def threads(answers: DataFrame, ttl_ms: int = THREAD_TTL_MS) -> DataFrame:
    """STM-08, SCL-14: (meeting_id, kind, seq, topic, ms) of a stream (meeting_id, seq, ms, topic, say, follow_up) with a watermark.

    kind ``reach``: what the answer seq can refer to (null topic: nothing). kind ``ended``: a thread that was neither replaced nor
    cleared within ``ttl_ms`` of its answer; ms is the time of its end, seq that of its answer. Its state goes then.
    """

    def step(key: tuple, rows: pd.DataFrame, thread: tuple | None):
        out = []
        for e in rows.sort_values(["ms", "seq"]).itertuples(index=False):
            now = int(e.ms)
            if thread is not None and now - thread[1] >= ttl_ms:
                out += end(key, thread)
                thread = None
            out.append((key[0], "reach", int(e.seq), thread[0] if thread else None, now))
            if isinstance(e.say, str) and e.say:
                thread = (e.topic, now, int(e.seq))
            elif not e.follow_up:
                thread = None
        return out, thread, None if thread is None else thread[1] + ttl_ms

    def end(key: tuple, thread: tuple) -> list[tuple]:
        return [(key[0], "ended", thread[2], thread[0], thread[1] + ttl_ms)]

    return _run(answers, "meeting_id", "meeting_id long, kind string, seq long, topic string, ms long", "topic string, at long, seq long", step, end)


def thread_rows(answers: DataFrame, ttl_ms: int = THREAD_TTL_MS) -> DataFrame:
    """The batch twin of :func:`threads`: the same rows of a whole table, all ends among them."""
    order = Window.partitionBy("meeting_id").orderBy("ms", "seq")
    says = F.coalesce(F.length("say") > 0, F.lit(False))
    # a row that speaks or clears decides what the later ones can reach
    sets = F.when(says | ~F.coalesce("follow_up", F.lit(False)), F.struct(F.when(says, F.struct("topic", "ms", "seq")).alias("thread")))
    last = F.last(sets, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))["thread"]
    upcoming = F.first(F.when(sets.isNotNull(), F.col("ms")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = answers.withColumns({"last": last, "upcoming": upcoming, "says": says})
    reach = rows.select("meeting_id", F.lit("reach").alias("kind"), "seq", F.when(F.col("ms") - F.col("last.ms") < ttl_ms, F.col("last.topic")).alias("topic"), "ms")
    ended = rows.filter(F.col("says") & (F.col("upcoming").isNull() | (F.col("upcoming") - F.col("ms") >= ttl_ms)))
    return reach.unionByName(ended.select("meeting_id", F.lit("ended").alias("kind"), "seq", "topic", (F.col("ms") + ttl_ms).alias("ms")))


def heard(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """STM-05: (id, kind, seq, text, versions) of a stream (id, seq, ms, text) with a watermark.

    kind: empty, appended, ignored (the same text again) or rewritten. An id that was not heard for ``idle_ms`` ends: a row of
    kind ``final`` gives its last text and how many versions it had, and its state goes; heard later it is new.
    """

    def step(key: tuple, rows: pd.DataFrame, said: tuple | None):
        out = []
        for e in rows.sort_values(["ms", "seq"]).itertuples(index=False):
            text, now = e.text if isinstance(e.text, str) else "", int(e.ms)
            if said is not None and now - said[1] >= idle_ms:
                out += end(key, said)
                said = None
            if not text:
                kind = "empty"
            elif said is None:
                kind, said = "appended", (text, now, 1, int(e.seq))
            else:
                kind = "ignored" if said[0] == text else "rewritten"
                said = (text, now, said[2] + (kind == "rewritten"), int(e.seq))
            out.append((key[0], kind, int(e.seq), text or None, said[2] if said else 0))
        return out, said, None if said is None else said[1] + idle_ms

    def end(key: tuple, said: tuple) -> list[tuple]:
        return [(key[0], "final", said[3], said[0], said[2])]

    return _run(events, "id", "id long, kind string, seq long, text string, versions long", "text string, at long, versions long, seq long", step, end)


def heard_rows(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """The batch twin of :func:`heard`, with the final row of every id and stretch."""
    order = Window.partitionBy("id").orderBy("ms", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.length("text") > 0, F.lit(False))
    rows = events.withColumn("full", full)
    # a stretch begins at a full row after idle_ms of silence
    prior = F.last(F.when(F.col("full"), F.col("ms")), ignorenulls=True).over(before)
    rows = rows.withColumn("new", (F.col("full") & (prior.isNull() | (F.col("ms") - prior >= idle_ms))).cast("int"))
    rows = rows.withColumns({"stretch": F.sum("new").over(order), "silent": prior.isNull() | (F.col("ms") - prior >= idle_ms)})
    inside = Window.partitionBy("id", "stretch").orderBy("ms", "seq")
    told = F.last(F.when(F.col("full"), F.col("text")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(~F.col("full"), "empty").when(F.col("new") == 1, "appended").when(told == F.col("text"), "ignored").otherwise("rewritten")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("versions", F.sum(F.col("kind").isin("appended", "rewritten").cast("long")).over(inside))
    rows = rows.withColumn("versions", F.when(~F.col("full") & F.col("silent"), 0).otherwise(F.col("versions")))
    each = rows.select("id", "kind", "seq", F.when(F.col("full"), F.col("text")).alias("text"), F.coalesce("versions", F.lit(0)).alias("versions"))
    last = rows.filter("full").groupBy("id", "stretch").agg(F.max_by(F.struct("seq", "text", "versions"), F.struct("ms", "seq")).alias("l"))
    return each.unionByName(last.select("id", F.lit("final").alias("kind"), "l.seq", "l.text", "l.versions"))


def rate_limits(events: DataFrame, limit: int = 120, seconds: int = 3600) -> DataFrame:
    """STM-10: (user_id, event_id, window_start_ms, allowed) of a stream (user_id, event_id, ms) with a watermark; batch twin: ``sessions.fixed_window_limit``.

    A window opens at the first event after the one before has ended; the timer at its end gives its state back.
    """

    def step(key: tuple, rows: pd.DataFrame, window: tuple | None):
        out = []
        for e in rows.sort_values(["ms", "event_id"]).itertuples(index=False):
            if window is None or e.ms - window[0] >= seconds * 1000:
                window = (int(e.ms), 0)
            window = (window[0], window[1] + 1)
            out.append((key[0], int(e.event_id), window[0], window[1] <= limit))
        return out, window, window[0] + seconds * 1000

    return _run(events, "user_id", "user_id long, event_id long, window_start_ms long, allowed boolean", "start long, n long", step, lambda key, window: [])


def newest_gate(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """STM-06: (meeting_id, id, seq, opens) of a stream (meeting_id, id, seq, ms, ordinal, role) with a watermark.

    A line of the other side opens the gate if no later one was seen; a rewrite of an older line does not. A meeting that was silent for
    ``idle_ms`` is over: its state goes, and lines after it are a new meeting's.
    """

    def step(key: tuple, rows: pd.DataFrame, seen: tuple | None):
        out = []
        for e in rows.sort_values(["ms", "seq"]).itertuples(index=False):
            if seen is not None and e.ms - seen[1] >= idle_ms:
                seen = None
            top, them = seen[0] if seen else -1, e.role == "them"
            out.append((key[0], int(e.id), int(e.seq), bool(them and e.ordinal >= top)))
            seen = (max(top, int(e.ordinal)) if them else top, int(e.ms))
        return out, seen, seen[1] + idle_ms

    return _run(events, "meeting_id", "meeting_id long, id long, seq long, opens boolean", "top long, at long", step, lambda key, seen: [])


def gate_rows(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """The batch twin of :func:`newest_gate`."""
    order = Window.partitionBy("meeting_id").orderBy("ms", "seq")
    gap = F.coalesce((F.col("ms") - F.lag("ms").over(order) >= idle_ms).cast("int"), F.lit(0))
    rows = events.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(order))
    them = F.coalesce(F.col("role") == "them", F.lit(False))
    top = F.max(F.when(them, F.col("ordinal"))).over(Window.partitionBy("meeting_id", "stretch").orderBy("ms", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("meeting_id", "id", "seq", (them & (F.col("ordinal") >= F.coalesce(top, F.lit(-1)))).alias("opens"))


def fresh_results(requests: DataFrame, results: DataFrame, within: str = "10 minutes", seconds: int = 600) -> DataFrame:
    """STM-15: results (session_id, epoch, ts, ...) that are not stale when they arrive; streams or tables.

    ``requests`` are (session_id, epoch, ts), epochs rise with each. A result is stale if a request of a newer epoch was made no later than it
    arrived. Requests are kept for ``within`` (``seconds``, the same): a result that takes longer than that is only
    held against the requests of that time. An outer join of the two streams: what met no newer request comes through once the
    watermark has passed it. Session and time bucket are the key, so a session of any length is many keys.
    """
    bucket = lambda c: F.floor(micros(c) / (seconds * 1_000_000)).cast("long")
    asked = requests.withWatermark("ts", within).select(
        F.col("session_id").alias("q_session"), F.col("epoch").alias("q_epoch"), F.col("ts").alias("q_ts"), F.explode(F.array(bucket("ts"), bucket("ts") + 1)).alias("q_bucket"))
    came = results.withWatermark("ts", within).withColumn("__bucket", bucket("ts"))
    newer = (
        (F.col("session_id") == F.col("q_session")) & (F.col("__bucket") == F.col("q_bucket")) & (F.col("q_epoch") > F.col("epoch"))
        & (F.col("q_ts") <= F.col("ts")) & (F.col("q_ts") > F.col("ts") - F.expr(f"INTERVAL {seconds} SECONDS"))
    )
    return came.join(asked, newer, "left_outer").filter(F.col("q_session").isNull()).drop("__bucket", "q_session", "q_epoch", "q_ts", "q_bucket")
