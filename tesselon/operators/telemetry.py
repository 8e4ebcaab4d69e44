"""Telemetry rollups over answer, feedback and lifecycle records.

Log order is a column (``ord``): where the engine takes a "first", it is the first by log order, not by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import jaccard, micros, percentile, share
from tesselon.operators.metrics import latency_triple

# --- fixed values ---------------------------------------------------------------------------------------
TIERS = ["localCard", "grounded", "synthesis", "silent"]
STAGES = ["retrieve_ms", "document_hydrate_ms", "llm_ms", "verify_ms", "total_ms"]
FUNNEL_ALIASES = {"SIGNUP": "USER_CREATED", "FIRST_ASK": "FIRST_QUESTION"}
CAPTURE_GOALS = {"localCard": 20, "llmTiers": 20, "multiSource": 10}
# ---------------------------------------------------------------------------------------------------------


def tier_report(answers: DataFrame, tiers: list[str] = TIERS) -> DataFrame:
    """AGG-06: per tier, tiers without answers included: counts and percentiles of every stage."""
    aggs = [c for s in STAGES for c in latency_triple(s, s)]
    supported = F.count_if(F.coalesce("supported", F.lit(True)) & (F.coalesce("say", F.lit("")) != ""))
    rows = answers.groupBy("tier").agg(F.count("*").alias("samples"), supported.alias("supported_n"), *aggs)
    names = answers.sparkSession.createDataFrame([(t,) for t in tiers], "tier string")
    return names.join(rows, "tier", "left").na.fill(0)


def model_report(answers: DataFrame) -> DataFrame:
    """AGG-07: per provider and model: the first row's name by log order, count, latencies."""
    keyed = answers.withColumns({"provider": F.coalesce("provider", F.lit("unknown")), "model_id": F.coalesce("model_id", F.lit("unknown"))})
    return keyed.groupBy("provider", "model_id").agg(
        F.min_by("model_name", "ord").alias("model_name"), F.count("*").alias("samples"),
        *latency_triple("total_ms", "total_ms"), *latency_triple("llm_ms", "llm_ms"), *latency_triple("verify_ms", "verify_ms"),
    )


def largest_p95_stage(answers: DataFrame, stages: list[str] = STAGES[:-1]) -> DataFrame:
    """AGG-10: the stage with the largest p95; the first in order wins a tie."""
    rows = answers.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"), F.col(s).cast("double").alias("v")) for i, s in enumerate(stages)
    ])).alias("r")).select("r.*").filter("v >= 0")
    p = rows.groupBy("i", "stage").agg(percentile("v", 0.95).alias("p95"))
    return p.agg(F.max_by("stage", F.struct("p95", -F.col("i"))).alias("stage"), F.max("p95").alias("p95"))


def capture_goals(answers: DataFrame, goals: dict[str, int] = CAPTURE_GOALS) -> DataFrame:
    """AGG-11: (goal, have, target, met)."""
    have = answers.agg(
        F.count_if(F.col("tier") == "localCard").alias("localCard"),
        F.count_if(F.col("tier").isin("grounded", "synthesis")).alias("llmTiers"),
        F.count_if(F.coalesce("source_count", F.lit(0)) > 1).alias("multiSource"),
    )
    rows = F.array(*[F.struct(F.lit(g).alias("goal"), F.col(g).alias("have"), F.lit(t).cast("long").alias("target")) for g, t in goals.items()])
    return have.select(F.explode(rows).alias("r")).select("r.*").withColumn("met", F.col("have") >= F.col("target"))


def quality_metrics(answers: DataFrame) -> DataFrame:
    """AGG-13: one row: count, supported and silence rates, latencies, sources a supported answer."""
    ok = F.col("supported")
    return answers.agg(
        F.count("*").alias("answers"), share(F.count_if(ok), F.count("*")).alias("supported_rate"),
        share(F.count_if(~ok), F.count("*")).alias("silence_rate"),
        percentile("CASE WHEN supported THEN latency_ms END", 0.5).alias("latency_p50"),
        percentile("CASE WHEN supported THEN latency_ms END", 0.95).alias("latency_p95"),
        F.coalesce(F.avg(F.when(ok, F.col("source_count"))), F.lit(0.0)).alias("avg_sources"),
        share(F.count_if(ok & (F.col("source_count") > 1)), F.count_if(ok)).alias("multi_source_rate"),
    )


def negative_reasons(feedback: DataFrame) -> DataFrame:
    """AGG-14: (reason, n) of feedback that is not useful, most frequent first."""
    reason = F.coalesce("failure_category", F.lit("other")).alias("reason")
    return feedback.filter(F.col("result") == "not-useful").groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def funnel(events: DataFrame, steps: list[str], aliases: dict[str, str] = FUNNEL_ALIASES) -> DataFrame:
    """AGG-15: (step, first_ts): each event's first time by log order, then the earliest over a step's aliases."""
    first = events.groupBy("event").agg(F.min_by("ts", "ord").alias("ts"))
    step = F.col("event")
    for a, s in aliases.items():
        step = F.when(F.col("event") == a, s).otherwise(step)
    per_step = first.withColumn("step", step).groupBy("step").agg(F.min("ts").alias("first_ts"))
    order = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "step_no int, step string")
    return order.join(per_step, "step", "left")


def lifecycle(events: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """AGG-16: one row, a count a name of the events listed for it (an event may count under several)."""
    return events.agg(*[F.count_if(F.col("event").isin(v)).alias(k) for k, v in names.items()])


def return_visits(events: DataFrame) -> DataFrame:
    """WIN-09: (user_id, day_1, day_7): whether a gap since the last activity lies in [1, 2) or [7, 8) days."""
    gap = micros("ts") - micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "ord")))
    day = 86_400_000_000
    rows = events.select("user_id", gap.alias("gap"))
    within = lambda d: F.coalesce(F.bool_or((F.col("gap") >= d * day) & (F.col("gap") < (d + 1) * day)), F.lit(False))
    return rows.groupBy("user_id").agg(within(1).alias("day_1"), within(7).alias("day_7"))


def quality_class(baseline: Column, fast: Column) -> Column:
    """STR-32: how an answer compares with the baseline's."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    words = lambda c: F.array_distinct(F.filter(F.split(norm(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    b, f, j = norm(baseline), norm(fast), jaccard(words(baseline), words(fast))
    short = lambda r: F.length(f) < F.length(b) * r
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank(baseline) | blank(fast), "materially incomplete").when(b == f, "semantically equivalent")
        .when(b.contains(f) | f.contains(b), F.when(short(0.75), "equivalent but narrower").otherwise("equivalent but more precise"))
        .when(j >= 0.65, "semantically equivalent")
        .when(j >= 0.45, F.when(short(0.8), "equivalent but narrower").otherwise("semantically equivalent"))
        .when(j >= 0.3, "equivalent but narrower").when(j < 0.2, "conflicting").otherwise("equivalent but narrower")
    )


def compare_with_baseline(baseline: DataFrame, optimized: DataFrame) -> DataFrame:
    """JOIN-06, AGG-26: (class, n) of bypassed answers against the last baseline row of (scenario, query)."""
    key = lambda df: df.withColumn("__k", F.concat_ws("::", F.coalesce("scenario", F.lit("")), "query"))
    last = key(baseline).groupBy("__k").agg(F.max_by("say", "ord").alias("base_say"))
    rows = key(optimized.filter("bypassed")).join(last, "__k", "left")
    return rows.groupBy(quality_class(F.col("base_say"), F.col("say")).alias("class")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """AGG-25: one row over comparable answers: counts by label and the rate, a partial one counting half."""
    ok = F.col("tier").isin("grounded", "synthesis") & F.col("shadow_supported") & (F.col("agreement") != "n/a")
    n = lambda x: F.count_if(F.col("agreement") == x)
    total = F.count("*")
    rate = F.when(total == 0, 1.0).otherwise(F.try_divide(n("consistent") + 0.5 * n("partial"), total))
    return rows.filter(ok).agg(
        total.alias("comparable"), n("consistent").alias("consistent"), n("partial").alias("partial"),
        n("conflicting").alias("conflicting"), rate.alias("rate"),
        ((total > 0) & (share(n("conflicting"), total) <= 0.05) & (rate >= 0.85)).alias("safe"),
    )


def breaks_privacy(payload: Column) -> Column:
    """FLT-14: whether a JSON record carries large contents, evidence bodies, keys or prompts."""
    from tesselon.functions.text import matches

    return (
        matches(payload, r'"content"\s*:\s*"[^"]{500,}') | matches(payload, r'"evidence"\s*:\s*\[')
        | matches(payload, r"\bsk-[a-zA-Z0-9]{10,}") | matches(payload, r"\bapi[_-]?key\b", True) | matches(payload, r'"prompt"\s*:')
    )


def recommendations(answers: DataFrame) -> DataFrame:
    """AGG-12: (rule, value, limit, fires): a stage's p95 over its limit calls for work on that stage."""
    limits = {"retrieve_ms": 100.0, "llm_ms": 500.0, "verify_ms": 150.0}
    p = answers.agg(*[percentile(f"CASE WHEN {s} >= 0 THEN {s} END", 0.95).alias(s) for s in limits])
    rows = F.array(*[F.struct(F.lit(s).alias("rule"), F.col(s).alias("value"), F.lit(x).alias("limit")) for s, x in limits.items()])
    return p.select(F.explode(rows).alias("r")).select("r.*").withColumn("fires", F.col("value") > F.col("limit"))


def drop_reasons(dropped: DataFrame) -> DataFrame:
    """AGG-22: per reason the number of dropped utterances and the least, median and largest probability."""
    return dropped.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(
        F.count("*").alias("n"), F.min("prob").alias("least"), F.median("prob").alias("median"), F.max("prob").alias("largest"))


def feedback_counts(feedback: DataFrame, labels: list[str]) -> DataFrame:
    """AGG-23: (place, label, n) in the given order, zeros included."""
    names = feedback.sparkSession.createDataFrame(list(enumerate(labels)), "place int, label string")
    return names.join(feedback.groupBy(F.col("result").alias("label")).agg(F.count("*").alias("n")), "label", "left").na.fill(0, ["n"])


def compare_runs(synthetic: DataFrame, real: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """AGG-24: (stage, synthetic_p95, real_p95, ratio) of two sets of answers."""
    def p95(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("v")) for s in stages])).alias("r")).select("r.*")
        return rows.filter("v >= 0").groupBy("stage").agg(percentile("v", 0.95).alias(name))

    out = p95(synthetic, "synthetic_p95").join(p95(real, "real_p95"), "stage", "full")
    return out.withColumn("ratio", share(F.col("synthetic_p95"), F.col("real_p95")))


def progressive_report(answers: DataFrame) -> DataFrame:
    """AGG-09: shadow samples, supported ones, and percentiles and mean of the positive savings."""
    saved = "CASE WHEN save_ms > 0 THEN save_ms END"
    return answers.filter("shadow_supported is not null").agg(
        F.count("*").alias("samples"), F.count_if("shadow_supported").alias("supported"), *[percentile(saved, p).alias(f"save_p{int(p * 100)}") for p in (0.5, 0.95, 0.99)],
        F.coalesce(F.avg(F.expr(saved)), F.lit(0.0)).alias("avg_save_ms"))


def transcript_summary(lines: DataFrame) -> DataFrame:
    """AGG-38: per meeting the lines of either side and the other side's last one (160 characters)."""
    them = F.col("role") == "them"
    return lines.groupBy("meeting_id").agg(
        F.count_if(them).alias("they_lines"), F.count_if(F.col("role") == "you").alias("you_lines"),
        F.substring(F.trim(F.max_by("text", F.when(them, F.col("ord")))), 1, 160).alias("last_question"))


def index_report(reports: DataFrame) -> DataFrame:
    """AGG-28: counters and timings of a space, summed over its contexts."""
    keys = [c for c in reports.columns if c not in ("space_id", "context_id")]
    return reports.groupBy("space_id").agg(*[F.sum(c).alias(c) for c in keys])


def usage(sources: DataFrame) -> DataFrame:
    """AGG-29, AGG-30, AGG-37: per user the pages, bytes and files, 0 for none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sources.groupBy("user_id").agg(total("pages").alias("pages"), total("bytes").alias("bytes"), F.count("*").alias("files"))


def agreement_class(tier: Column, early: Column, final: Column) -> Column:
    """STR-31: how an early line agrees with the final one: consistent, partial, conflicting, or n/a where they can't be compared."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    words = lambda c: F.array_distinct(F.filter(F.split(norm(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    e, f = norm(early), norm(final)
    a, b = words(early), words(final)
    overlap = share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    return (
        F.when((tier == "silent") | (f == ""), "n/a").when(tier == "localCard", "consistent").when(e == "", "n/a").when(e == f, "consistent")
        .when(e.contains(f) | f.contains(e) | (overlap >= 0.25), "partial").otherwise("conflicting")
    )


def progressive_timing(answers: DataFrame) -> DataFrame:
    """SCL-16: ``answers`` with final_ms, earliest_ms (of a supported early line) and save_ms (of a model's answer that came later)."""
    early = F.when(F.col("shadow_supported"), F.col("early_ms"))
    later = F.col("tier").isin("grounded", "synthesis") & (F.col("total_ms") > early)
    return answers.withColumns({"final_ms": F.col("total_ms"), "earliest_ms": early, "save_ms": F.when(later, F.col("total_ms") - early)})


def multi_source_report(answers: DataFrame) -> DataFrame:
    """AGG-08: the rollup of AGG-06 over answers from several sources, one row; none without such answers."""
    aggs = [c for s in STAGES for c in latency_triple(s, s)]
    rows = answers.filter(F.coalesce("source_count", F.lit(0)) > 1).agg(
        F.count("*").alias("samples"), F.count_if(F.coalesce("say", F.lit("")) != "").alias("supported_n"), *aggs)
    return rows.filter("samples > 0")


def multi_source_scenarios(answers: DataFrame) -> DataFrame:
    """AGG-44: supported answers with a line in scenarios of several sources."""
    ok = F.col("supported") & (F.coalesce("say", F.lit("")) != "") & F.col("scenario").isin("multi-repo", "repo-pdf", "synthesis-heavy")
    return answers.agg(F.count_if(ok).alias("n"))


def judge_report(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """AGG-41: per judge the safety metrics, latency percentiles and the threshold with the most correct decisions.

    ``rows`` has judge, expected, predicted, latency_ms and confidence; a tie of thresholds goes to the lower one.
    """
    a = "APPLICABLE"
    n, go = F.count("*"), F.col("predicted") == a
    base = rows.groupBy("judge").agg(
        n.alias("total"), share(F.count_if(F.col("expected") == F.col("predicted")), n).alias("accuracy"),
        share(F.count_if(go & (F.col("expected") != a)), n).alias("unsafe_rate"), *latency_triple("latency_ms", "latency"))
    at = rows.select("judge", "confidence", (F.col("expected") == a).alias("yes"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t"))
    right = at.groupBy("judge", "t").agg(F.count_if((F.col("confidence") >= F.col("t")) == F.col("yes")).alias("right"))
    best = right.groupBy("judge").agg(F.max_by("t", F.struct("right", -F.col("t"))).alias("threshold"))
    return base.join(best, "judge")


def synthetic_session(spark, rows: int, seed: int = 42) -> DataFrame:
    """SCL-15: a reproducible session of answer records, made in parallel from hashes of their numbers."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.floor(u(1) * 4) + 1).cast("int"))
    return spark.range(rows).select(
        F.col("id").alias("ord"), tier.alias("tier"), (tier != "silent").alias("supported"), F.when(tier != "silent", F.lit("line")).alias("say"),
        (1 + 4 * u(2)).alias("retrieve_ms"), u(3).alias("document_hydrate_ms"), F.when(tier.isin("grounded", "synthesis"), 400 + 900 * u(4)).otherwise(0.0).alias("llm_ms"),
        (2 * u(5)).alias("verify_ms"), (1 + F.floor(u(6) * 3)).cast("int").alias("source_count"), F.lit("p").alias("provider"), F.lit("m").alias("model_id"), F.lit("m").alias("model_name"),
    ).withColumn("total_ms", F.col("retrieve_ms") + F.col("document_hydrate_ms") + F.col("llm_ms") + F.col("verify_ms"))
