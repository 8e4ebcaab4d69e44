"""Queries over telemetry, transcripts and judges: rollups that the first module leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import scalars as sc
from tesselon.operators import answers as answers_ops
from tesselon.operators import contract, metrics, sessions, telemetry
from tesselon.plans.registry import query, table


def _answers(spark, sf_dir):
    """Answer records made of events, with early lines, scenarios and texts."""
    e, u, i, v = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("value")
    pick = lambda c, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    return e.select(
        i.alias("ord"), "user_id", "ts", pick(i, ["localCard", "grounded", "synthesis", "silent"]).alias("tier"), (i % 5 != 0).alias("supported"), F.when(i % 7 != 0, "the line").alias("say"),
        (v * 0.25).alias("retrieve_ms"), (v * 0.125).alias("document_hydrate_ms"), (v * 8).alias("llm_ms"), (v * 0.0625).alias("verify_ms"), v.alias("total_ms"),
        (u % 4).alias("source_count"), (i % 3 != 0).alias("shadow_supported"), (v * (i % 4) * 0.5).alias("early_ms"), pick(u, ["multi-repo", "single", "repo-pdf", "other"]).alias("scenario"),
        pick(u + i, ["what now", "how so", "why not"]).alias("query"), (i % 2 == 0).alias("bypassed"),
    )


_A = """WITH a AS (SELECT event_id AS ord, user_id, ts, ['localCard', 'grounded', 'synthesis', 'silent'][event_id % 4 + 1] AS tier, event_id % 5 <> 0 AS supported, CASE WHEN event_id % 7 <> 0 THEN 'the line' END AS say,
    value * 0.25 AS retrieve_ms, value * 0.125 AS document_hydrate_ms, value * 8 AS llm_ms, value * 0.0625 AS verify_ms, value AS total_ms, user_id % 4 AS source_count, event_id % 3 <> 0 AS shadow_supported,
    value * (event_id % 4) * 0.5 AS early_ms, ['multi-repo', 'single', 'repo-pdf', 'other'][user_id % 4 + 1] AS scenario, ['what now', 'how so', 'why not'][(user_id + event_id) % 3 + 1] AS query, event_id % 2 = 0 AS bypassed FROM events) """


def _p(v: str, name: str) -> str:
    return ", ".join(f"coalesce(quantile_disc({v}, {q}) FILTER ({v} >= 0), 0)::DOUBLE AS {name}_p{int(q * 100)}" for q in (0.5, 0.95, 0.99))


@query(_A + f"""SELECT count(*) AS samples, count(*) FILTER (say IS NOT NULL) AS supported_n, {', '.join(_p(s, s) for s in ('retrieve_ms', 'document_hydrate_ms', 'llm_ms', 'verify_ms', 'total_ms'))} FROM a WHERE source_count > 1""")
def multi_source_report(spark, sf_dir):
    """AGG-08."""
    return telemetry.multi_source_report(_answers(spark, sf_dir))


@query(_A + "SELECT count(*) AS n FROM a WHERE supported AND say IS NOT NULL AND scenario IN ('multi-repo', 'repo-pdf')")
def multi_source_scenarios(spark, sf_dir):
    """AGG-44."""
    return telemetry.multi_source_scenarios(_answers(spark, sf_dir))


@query(_A + """SELECT ord, total_ms AS final_ms, CASE WHEN shadow_supported THEN early_ms END AS earliest_ms,
    CASE WHEN tier IN ('grounded', 'synthesis') AND shadow_supported AND total_ms > early_ms THEN total_ms - early_ms END AS save_ms FROM a""")
def progressive_timing(spark, sf_dir):
    """SCL-16."""
    return telemetry.progressive_timing(_answers(spark, sf_dir)).select("ord", "final_ms", "earliest_ms", "save_ms")


@query(_A + """, s AS (SELECT *, CASE WHEN tier IN ('grounded', 'synthesis') AND shadow_supported AND total_ms > early_ms THEN total_ms - early_ms END AS save_ms FROM a)
    SELECT count(*) AS samples, count(*) FILTER (shadow_supported) AS supported, coalesce(quantile_disc(save_ms, 0.5) FILTER (save_ms > 0), 0) AS save_p50, coalesce(quantile_disc(save_ms, 0.95) FILTER (save_ms > 0), 0) AS save_p95,
    coalesce(quantile_disc(save_ms, 0.99) FILTER (save_ms > 0), 0) AS save_p99, round(avg(save_ms) FILTER (save_ms > 0), 6) AS avg_save_ms FROM s""")
def progressive_report(spark, sf_dir):
    """AGG-09."""
    return telemetry.progressive_report(telemetry.progressive_timing(_answers(spark, sf_dir))).withColumn("avg_save_ms", F.round("avg_save_ms", 6))


@query(_A + """, p AS (SELECT quantile_disc(retrieve_ms, 0.95) AS r, quantile_disc(llm_ms, 0.95) AS l, quantile_disc(verify_ms, 0.95) AS v FROM a)
    SELECT 'retrieve_ms' AS rule, r AS value, 100.0::DOUBLE AS "limit", r > 100 AS fires FROM p UNION ALL SELECT 'llm_ms', l, 500, l > 500 FROM p UNION ALL SELECT 'verify_ms', v, 150, v > 150 FROM p""")
def latency_recommendations(spark, sf_dir):
    """AGG-12."""
    return telemetry.recommendations(_answers(spark, sf_dir))


@query("""SELECT CASE WHEN user_id % 6 = 0 THEN 'unknown' ELSE 'r' || (user_id % 6) END AS reason, count(*) AS n, min(value) AS least, median(value) AS median, max(value) AS largest FROM events GROUP BY 1""")
def drop_reasons(spark, sf_dir):
    """AGG-22."""
    u = F.col("user_id") % 6
    return telemetry.drop_reasons(table(spark, sf_dir, "events").select(F.when(u != 0, F.concat(F.lit("r"), u.cast("string"))).alias("reason"), F.col("value").alias("prob")))


@query("""SELECT l.label, l.place, count(e.event_id) AS n FROM (VALUES ('view', 0), ('error', 1), ('never', 2), ('click', 3)) l(label, place) LEFT JOIN events e ON e.event_type = l.label GROUP BY ALL""")
def feedback_counts(spark, sf_dir):
    """AGG-23."""
    return telemetry.feedback_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("result")), ["view", "error", "never", "click"])


@query(_A + "".join(f"{', ' if i else ', p AS ('}SELECT '{s}' AS stage, quantile_disc({s}, 0.95) FILTER (ord % 2 = 0) AS synthetic_p95, quantile_disc({s}, 0.95) FILTER (ord % 2 = 1) AS real_p95 FROM a".replace(", SELECT", " UNION ALL SELECT") for i, s in enumerate(("retrieve_ms", "document_hydrate_ms", "llm_ms", "verify_ms", "total_ms"))) + ") SELECT *, synthetic_p95 / real_p95 AS ratio FROM p")
def run_comparison(spark, sf_dir):
    """AGG-24."""
    a = _answers(spark, sf_dir)
    return telemetry.compare_runs(a.filter("ord % 2 = 0"), a.filter("ord % 2 = 1"))


_SAID = """['the queue retries three times', 'the queue retries', 'nothing alike here', 'the  QUEUE retries three times', '']"""
_CLASSED = f"""c AS (SELECT ord, tier, shadow_supported, {_SAID}[ord % 5 + 1] AS early, {_SAID}[(ord // 5) % 5 + 1] AS final FROM a),
    n AS (SELECT *, lower(regexp_replace(early, '\\s+', ' ', 'g')) AS e, lower(regexp_replace(final, '\\s+', ' ', 'g')) AS f FROM c),
    w AS (SELECT *, list_distinct(list_filter(string_split(e, ' '), lambda x: length(x) > 2)) AS ew, list_distinct(list_filter(string_split(f, ' '), lambda x: length(x) > 2)) AS fw FROM n),
    g AS (SELECT *, CASE WHEN tier = 'silent' OR f = '' THEN 'n/a' WHEN tier = 'localCard' THEN 'consistent' WHEN e = '' THEN 'n/a' WHEN e = f THEN 'consistent'
        WHEN contains(e, f) OR contains(f, e) OR len(list_intersect(ew, fw)) / greatest(1, len(list_distinct(list_concat(ew, fw)))) >= 0.25 THEN 'partial' ELSE 'conflicting' END AS agreement FROM w)"""


def _agreeing(spark, sf_dir):
    said = F.array(*[F.lit(x) for x in ("the queue retries three times", "the queue retries", "nothing alike here", "the  QUEUE retries three times", "")])
    at = lambda c: F.element_at(said, (c % 5 + 1).cast("int"))
    a = _answers(spark, sf_dir)
    return a.withColumn("agreement", telemetry.agreement_class(F.col("tier"), at(F.col("ord")), at(F.floor(F.col("ord") / 5))))


@query(_A + f", {_CLASSED} SELECT ord, agreement FROM g")
def agreement_classes(spark, sf_dir):
    """STR-31."""
    return _agreeing(spark, sf_dir).select("ord", "agreement")


@query(_A + f""", {_CLASSED}, k AS (SELECT agreement FROM g WHERE tier IN ('grounded', 'synthesis') AND shadow_supported AND agreement <> 'n/a'),
    s AS (SELECT count(*) AS n, count(*) FILTER (agreement = 'consistent') AS a, count(*) FILTER (agreement = 'partial') AS b, count(*) FILTER (agreement = 'conflicting') AS c FROM k)
    SELECT n AS comparable, a AS consistent, b AS partial, c AS conflicting, (a + 0.5 * b) / n AS rate, n > 0 AND c / n <= 0.05 AND (a + 0.5 * b) / n >= 0.85 AS safe FROM s""")
def agreement_summary(spark, sf_dir):
    """AGG-25."""
    return telemetry.agreement(_agreeing(spark, sf_dir))


_LINES = ["the queue retries three times before it gives up", "the queue retries", "the queue retries three times and gives up", "a cache holds the hot rows", "", "the queue retries three times before it gives up and logs"]
_L = "[" + ", ".join(f"'{x}'" for x in _LINES) + "]"


@query(f"""WITH c AS (SELECT event_id, {_L}[event_id % 6 + 1] AS b, {_L}[(event_id // 6) % 6 + 1] AS f FROM events),
    j AS (SELECT *, list_distinct(list_filter(string_split(b, ' '), lambda x: length(x) > 2)) AS bw, list_distinct(list_filter(string_split(f, ' '), lambda x: length(x) > 2)) AS fw FROM c),
    k AS (SELECT *, len(list_intersect(bw, fw)) / greatest(1, len(list_distinct(list_concat(bw, fw)))) AS j FROM j)
    SELECT event_id, CASE WHEN b = '' OR f = '' THEN 'materially incomplete' WHEN b = f THEN 'semantically equivalent'
        WHEN contains(b, f) OR contains(f, b) THEN CASE WHEN length(f) < length(b) * 0.75 THEN 'equivalent but narrower' ELSE 'equivalent but more precise' END
        WHEN j >= 0.65 THEN 'semantically equivalent' WHEN j >= 0.45 THEN CASE WHEN length(f) < length(b) * 0.8 THEN 'equivalent but narrower' ELSE 'semantically equivalent' END
        WHEN j >= 0.3 THEN 'equivalent but narrower' WHEN j < 0.2 THEN 'conflicting' ELSE 'equivalent but narrower' END AS class FROM k""")
def quality_classes(spark, sf_dir):
    """STR-32."""
    lines = F.array(*[F.lit(x) for x in _LINES])
    at = lambda c: F.element_at(lines, (c % 6 + 1).cast("int"))
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", telemetry.quality_class(at(i), at(F.floor(i / 6))).alias("class"))


@query(_A + """, b AS (SELECT scenario, query, arg_max(say, ord) AS base FROM (SELECT scenario, query, ord, 'line ' || (ord % 3) AS say FROM a WHERE NOT bypassed) GROUP BY 1, 2),
    o AS (SELECT 'line ' || (ord % 4) AS say, base FROM a LEFT JOIN b USING (scenario, query) WHERE bypassed)
    SELECT CASE WHEN base IS NULL THEN 'materially incomplete' WHEN say = base THEN 'semantically equivalent' ELSE 'semantically equivalent' END AS class, count(*) AS n FROM o GROUP BY 1""")
def baseline_comparison(spark, sf_dir):
    """JOIN-06, AGG-26: digits are too short to count as words, so lines that differ in one only are equivalent."""
    a = _answers(spark, sf_dir)
    line = lambda m: F.concat(F.lit("line "), (F.col("ord") % m).cast("string"))
    return telemetry.compare_with_baseline(a.filter("not bypassed").withColumn("say", line(3)), a.withColumn("say", line(4)))


@query("""SELECT user_id % 3 AS space_id, sum(user_id)::BIGINT AS files, sum(event_id)::BIGINT AS chunks, sum(epoch_us(ts) // 1000000)::BIGINT AS ms FROM events GROUP BY 1""")
def index_report(spark, sf_dir):
    """AGG-28."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("space_id"), F.col("event_type").alias("context_id"), F.col("user_id").alias("files"), F.col("event_id").alias("chunks"), F.floor(sc.micros("ts") / 1_000_000).alias("ms"))
    return telemetry.index_report(e)


@query("""SELECT conv_id AS meeting_id, count(*) FILTER (role = 'user') AS they_lines, count(*) FILTER (role = 'assistant') AS you_lines, substr(trim(arg_max(t, turn) FILTER (role = 'user'), ' '), 1, 160) AS last_question
    FROM (SELECT *, coalesce(text, '') AS t FROM conversations) GROUP BY 1""")
def transcript_summary(spark, sf_dir):
    """AGG-38."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "them").when(F.col("role") == "assistant", "you").otherwise(F.col("role"))
    return telemetry.transcript_summary(c.select(F.col("conv_id").alias("meeting_id"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("ord")))


@query(f"""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (user_id % 9 = 0) AS failed, {_p('value', 'latency')} FROM events GROUP BY 1""")
def viewer_metrics(spark, sf_dir):
    """AGG-45."""
    return contract.viewer_metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 9 != 0).alias("ok"), F.col("value").alias("latency_ms")))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'NOT_APPLICABLE' WHEN quality = 1 THEN 'APPLICABLE' ELSE 'NOT_APPLICABLE' END AS decision FROM labels""")
def ensemble_decisions(spark, sf_dir):
    """AGG-21."""
    name = lambda c: F.when(c == 1, "APPLICABLE").otherwise("NOT_APPLICABLE")
    return table(spark, sf_dir, "labels").select("doc_id", metrics.ensemble(name(F.col("quality")), name(1 - F.col("toxic"))).alias("decision"))


@query(f"""WITH r AS (SELECT 'j' || (doc_id % 3) AS judge, quality = 1 AS yes, toxic = 0 AS said, n_chars::DOUBLE AS latency_ms, (doc_id % 10) / 10.0::DOUBLE AS c FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT judge, count(*) AS total, count(*) FILTER (yes = said) / count(*) AS accuracy, count(*) FILTER (said AND NOT yes) / count(*) AS unsafe_rate, {_p('latency_ms', 'latency')} FROM r GROUP BY judge),
    t AS (SELECT judge, t.t, count(*) FILTER ((c >= t.t) = yes) AS k FROM r, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(t) GROUP BY 1, 2)
    SELECT b.*, threshold FROM b JOIN (SELECT judge, t AS threshold FROM t QUALIFY row_number() OVER (PARTITION BY judge ORDER BY k DESC, t) = 1) USING (judge)""")
def judge_report(spark, sf_dir):
    """AGG-41."""
    name = lambda c: F.when(c == 1, "APPLICABLE").otherwise("NOT_APPLICABLE")
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.concat(F.lit("j"), (F.col("doc_id") % 3).cast("string")).alias("judge"), name(F.col("quality")).alias("expected"), name(1 - F.col("toxic")).alias("predicted"),
        F.col("n_chars").cast("double").alias("latency_ms"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("confidence"))
    return telemetry.judge_report(r, [0.2, 0.5, 0.8])


@query("""WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"content": "' || repeat('x', 600) || '"}' WHEN 1 THEN '{"evidence" : ["a"]}' WHEN 2 THEN '{"k": "sk-abcdefghijk123"}' WHEN 3 THEN '{"note": "the Api_Key"}' WHEN 4 THEN '{"prompt": "x"}' ELSE props END AS p FROM events)
    SELECT event_id, event_id % 6 < 5 AS breaks FROM p""")
def privacy_breaks(spark, sf_dir):
    """FLT-14: each kind of content that may not be logged, and harmless records."""
    i = F.col("event_id") % 6
    p = F.when(i == 0, F.concat(F.lit('{"content": "'), F.repeat(F.lit("x"), F.lit(600)), F.lit('"}'))).when(i == 1, '{"evidence" : ["a"]}').when(i == 2, '{"k": "sk-abcdefghijk123"}').when(i == 3, '{"note": "the Api_Key"}').when(i == 4, '{"prompt": "x"}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", telemetry.breaks_privacy(p).alias("breaks"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value / 200 >= 0.5 THEN 'silero' END WHEN value >= 2.5 * 20 AND (event_id % 5) * 500 >= 1000 THEN 'high-energy' END AS how FROM events""")
def admitted_utterances(spark, sf_dir):
    """STM-04."""
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", sessions.admit(F.when(i % 3 == 0, v / 200), (i % 5) * 500, v, F.lit(20.0)).alias("how"))


@query("""WITH f AS (SELECT event_id, user_id % 3 AS lane, epoch_us(ts) / 1000.0 AS at_ms FROM events), w AS (SELECT *, (row_number() OVER (PARTITION BY lane ORDER BY at_ms DESC, event_id) - 1) * 100.0 AS after FROM f)
    SELECT lane, count(*) AS n FROM w WHERE after < 4000 GROUP BY lane""")
def trailing_frames(spark, sf_dir):
    """WIN-10: frames of 100 ms each."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("lane"), (sc.micros("ts") / 1000.0).alias("at_ms"), F.lit(100.0).alias("ms"))
    return contract.trailing_frames(e).groupBy("lane").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey AS pack, array_to_string(list_sort(list_distinct(list(split_part(n_name, ' ', 1)))), ',') AS names FROM nation WHERE n_regionkey = 1 GROUP BY 1""")
def components_under(spark, sf_dir):
    """AGG-32: names right below one directory."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.split("n_name", " ")[0], F.lit("/x.ts")).alias("path"))
    return answers_ops.components_under(n, "r1").select(F.lit(1).alias("pack"), F.array_join("names", ",").alias("names"))
