"""Batch twins of the streams whose state ends, over the events table: threads, heard texts, gates, results of current requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.plans.registry import query, table
from tesselon.streaming import timers

_HOURS = 3_600_000


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumns({"seq": F.col("event_id"), "ms": F.expr("unix_millis(cast(ts AS timestamp))")})


_THREADS = """e AS (SELECT user_id AS m, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type || event_id AS topic, event_type IN ('click', 'purchase') AS says, event_type = 'view' AS follows FROM events),
    s AS (SELECT *, says OR NOT follows AS sets FROM e),
    -- for each row the last one before it that decides, by a join on its number
    n AS (SELECT *, count(*) FILTER (sets) OVER w AS upto, count(*) FILTER (sets) OVER (PARTITION BY m ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WINDOW w AS (PARTITION BY m ORDER BY ms, seq)),
    d AS (SELECT m, upto AS k, topic, says, ms, seq FROM n WHERE sets)"""


@query(f"""WITH {_THREADS}
    SELECT n.m AS meeting_id, 'reach' AS kind, n.seq, CASE WHEN d.says AND n.ms - d.ms < {6 * _HOURS} THEN d.topic END AS topic, n.ms FROM n LEFT JOIN d ON d.m = n.m AND d.k = n.before
    UNION ALL SELECT a.m, 'ended', a.seq, a.topic, a.ms + {6 * _HOURS} FROM d a LEFT JOIN d b ON b.m = a.m AND b.k = a.k + 1 WHERE a.says AND (b.ms IS NULL OR b.ms - a.ms >= {6 * _HOURS})""")
def ended_threads(spark, sf_dir):
    """STM-08, SCL-14: what each answer can reach, and the threads that end by themselves."""
    e, kind = _events(spark, sf_dir), F.col("event_type")
    rows = e.select(F.col("user_id").alias("meeting_id"), "seq", "ms", F.concat(kind, F.col("event_id").cast("string")).alias("topic"), F.when(kind.isin("click", "purchase"), kind).alias("say"), (kind == "view").alias("follow_up"))
    return timers.thread_rows(rows, 6 * _HOURS)


@query(f"""WITH e AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'error' THEN event_type END AS text FROM events),
    f AS (SELECT *, lag(ms) OVER w AS p, lag(text) OVER w AS pt FROM e WHERE text IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY ms, seq)),
    g AS (SELECT *, p IS NULL OR ms - p >= {6 * _HOURS} AS fresh FROM f),
    h AS (SELECT *, CASE WHEN fresh THEN 'appended' WHEN pt = text THEN 'ignored' ELSE 'rewritten' END AS kind, count(*) FILTER (fresh) OVER (PARTITION BY id ORDER BY ms, seq) AS st FROM g),
    v AS (SELECT *, count(*) FILTER (kind <> 'ignored') OVER (PARTITION BY id, st ORDER BY ms, seq) AS versions FROM h),
    z AS (SELECT e.id, e.seq, e.ms, max(v.ms) AS lm, arg_max(v.versions, (v.ms, v.seq)) AS versions FROM e LEFT JOIN v ON v.id = e.id AND (v.ms, v.seq) < (e.ms, e.seq) WHERE e.text IS NULL GROUP BY ALL)
    SELECT id, kind, seq, text, versions FROM v UNION ALL SELECT id, 'empty', seq, NULL, CASE WHEN lm IS NULL OR ms - lm >= {6 * _HOURS} THEN 0 ELSE versions END FROM z
    UNION ALL SELECT id, 'final', seq, text, versions FROM v QUALIFY row_number() OVER (PARTITION BY id, st ORDER BY ms DESC, seq DESC) = 1""")
def heard_finals(spark, sf_dir):
    """STM-05: outcome of every text, and the final text of ids that fell silent."""
    kind = F.col("event_type")
    return timers.heard_rows(_events(spark, sf_dir).select(F.col("user_id").alias("id"), "seq", "ms", F.when(kind != "error", kind).alias("text")), 6 * _HOURS)


@query(f"""WITH e AS (SELECT user_id AS m, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_id % 20 AS o, event_type IN ('click', 'view') AS them FROM events),
    g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY m ORDER BY ms, seq) >= {12 * _HOURS} AS gap FROM e), s AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY m ORDER BY ms, seq) AS st FROM g)
    SELECT a.m AS meeting_id, a.seq AS id, a.seq, a.them AND NOT EXISTS (SELECT 1 FROM s b WHERE b.m = a.m AND b.st = a.st AND b.them AND (b.ms, b.seq) < (a.ms, a.seq) AND b.o > a.o) AS opens FROM s a""")
def newest_gates(spark, sf_dir):
    """STM-06: lines that open the gate, in meetings that end after half a day of silence."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("id"), "seq", "ms", (F.col("event_id") % 20).alias("ordinal"), F.when(F.col("event_type").isin("click", "view"), "them").otherwise("you").alias("role"))
    return timers.gate_rows(rows, 12 * _HOURS)


@query("""WITH r AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, ts AS asked, ts + to_microseconds((round(value * 60000000))::BIGINT) AS came FROM events)
    SELECT s AS session_id, e AS epoch, came AS ts FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.s = a.s AND b.e > a.e AND b.asked <= a.came AND b.asked > a.came - INTERVAL 43200 SECONDS)""")
def fresh_results(spark, sf_dir):
    """STM-15: results that no newer request of their session has overtaken."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.row_number().over(order).cast("long").alias("epoch"), "ts", F.round(F.col("value") * 60_000_000).cast("long").alias("us"))
    came = F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp))") + F.col("us")).cast(rows.schema["ts"].dataType)
    return timers.fresh_results(rows.drop("us"), rows.select("session_id", "epoch", came.alias("ts")), "12 hours", 43_200)
