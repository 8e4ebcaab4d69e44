"""Classification quality: confusion, precision and recall, safety rates, threshold sweeps.

All are grouped aggregates with map-side combine; rates with a zero denominator are 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import percentile, share
from tesselon.session import materialize


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """AGG-17: (expected, predicted, n) over the union of labels, zeros included."""
    counts = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("expected", "predicted")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("expected")).join(labels.select(F.col("l").alias("predicted")), F.lit(True))
    return grid.join(counts, ["expected", "predicted"], "left").na.fill(0, ["n"])


def per_label(pairs: DataFrame) -> DataFrame:
    """AGG-17: (label, tp, predicted_n, expected_n, precision, recall)."""
    sides = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    rows = sides.select(
        F.explode(F.array(
            F.struct(F.col("expected").alias("label"), F.col("n").alias("e"), F.lit(0).cast("long").alias("p")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("e"), F.col("n").alias("p")),
        )).alias("r"), (F.col("expected") == F.col("predicted")).alias("hit"), "n",
    ).select("r.label", "r.e", "r.p", F.when(F.col("hit") & (F.col("r.e") > 0), F.col("n")).otherwise(0).alias("tp"))
    out = rows.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("predicted_n"), F.sum("e").alias("expected_n")
    )
    return out.withColumns({
        "precision": share(F.col("tp"), F.col("predicted_n")), "recall": share(F.col("tp"), F.col("expected_n"))
    })


def classification_summary(pairs: DataFrame) -> DataFrame:
    """AGG-17: one row: total, accuracy, macro_precision, macro_recall."""
    total = pairs.agg(
        F.count("*").alias("total"), share(F.count_if(F.col("expected") == F.col("predicted")), F.count("*")).alias("accuracy")
    )
    macro = per_label(pairs).agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
    )
    return total.join(macro, F.lit(True))


def _both(e: str, p: str) -> Column:
    return F.count_if((F.col("expected") == e) & (F.col("predicted") == p))


def applicability_safety(pairs: DataFrame) -> DataFrame:
    """AGG-18: labels APPLICABLE and NOT_APPLICABLE; unsafe is to go on where one should not."""
    a, n = "APPLICABLE", "NOT_APPLICABLE"
    total, tp, fp, fn = F.count("*"), _both(a, a), _both(n, a), _both(a, n)
    return pairs.agg(
        total.alias("total"), share(F.count_if(F.col("expected") == F.col("predicted")), total).alias("accuracy"),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), fp.alias("unsafe"),
        share(fp, total).alias("unsafe_rate"), fn.alias("false_silence"), share(fn, total).alias("false_silence_rate"),
        share(tp, total).alias("safe_coverage"),
        share(total - F.count_if(F.col("predicted") == a), total).alias("refusal_rate"),
    )


def escalation_safety(pairs: DataFrame) -> DataFrame:
    """AGG-19: labels ANSWER_WITH_CURRENT_PIPELINE, ESCALATE and SILENT."""
    a, e, s = "ANSWER_WITH_CURRENT_PIPELINE", "ESCALATE", "SILENT"
    total, pred = F.count("*"), lambda x: F.count_if(F.col("predicted") == x)
    unsafe = F.count_if((F.col("expected") == s) & (F.col("predicted") != s))
    quiet = F.count_if((F.col("expected") != s) & (F.col("predicted") == s))
    return pairs.agg(
        total.alias("total"), share(F.count_if(F.col("expected") == F.col("predicted")), total).alias("accuracy"),
        share(_both(a, a), pred(a)).alias("precision"), share(_both(a, a), F.count_if(F.col("expected") == a)).alias("recall"),
        unsafe.alias("unsafe"), share(unsafe, total).alias("unsafe_rate"), quiet.alias("false_silence"),
        share(quiet, total).alias("false_silence_rate"), _both(a, e).alias("false_escalation"),
        share(_both(a, a) + _both(e, e), total).alias("safe_coverage"), share(pred(a), total).alias("answer_rate"),
        share(pred(e), total).alias("escalate_rate"), share(pred(s), total).alias("silent_rate"),
    )


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """AGG-20: rates at each threshold of (confidence, expected_continue); no rows give rates of 0.

    Each row is replicated once a threshold (a short list) and combined map-side.
    """
    spark = rows.sparkSession
    base = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    spread = rows.select("confidence", "expected_continue", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    go = F.col("confidence") >= F.col("threshold")
    sums = spread.groupBy("threshold").agg(
        F.count("*").alias("n"), F.count_if(go & ~F.col("expected_continue")).alias("unsafe"),
        F.count_if(go & F.col("expected_continue")).alias("correct"), F.count_if(~go & F.col("expected_continue")).alias("quiet"),
        F.count_if(go).alias("go"), F.count_if(~go).alias("silent"),
    )
    out = base.join(sums, "threshold", "left")
    rate = lambda c: share(F.coalesce(c, F.lit(0)), F.col("n"))
    return out.select(
        "threshold", rate("unsafe").alias("unsafe_rate"), rate("correct").alias("correct_rate"),
        rate("quiet").alias("false_silence_rate"), rate("go").alias("escalation_rate"), rate("silent").alias("silence_rate"),
        rate("go").alias("coverage_rate"),
    )


def ensemble(deterministic: Column, judge: Column) -> Column:
    """AGG-21: the judge may reject what the rules accept, never the other way."""
    return F.when((deterministic == "APPLICABLE") & (judge == "NOT_APPLICABLE"), F.lit("NOT_APPLICABLE")).otherwise(deterministic)


def worst_cases(rows: DataFrame, n: int = 10) -> DataFrame:
    """AGG-42: the ``n`` most confident errors of each (judge, error); ties by id."""
    order = Window.partitionBy("judge", "error").orderBy(F.desc("confidence"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def latency_triple(value: str, prefix: str) -> list[Column]:
    """AGG-02: p50, p95, p99 by nearest rank of an SQL expression, negative and null values left out (AGG-05)."""
    kept = f"CASE WHEN {value} >= 0 THEN {value} END"
    return [percentile(kept, p).alias(f"{prefix}_p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]


#: Bins of a pass of :func:`exact_ranks`.
RANK_BINS = 1024


def nearest_rank(p: float):
    """The rank ceil(p n) of n values, 1 at least (AGG-01)."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))


#: Ranks of the two values around the middle; their mean is the interpolating median (AGG-04).
MEDIAN_RANKS = {"lower": lambda n: F.floor((n + 1) / 2), "upper": lambda n: F.floor(n / 2) + 1}


def exact_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict, bins: int | None = None) -> DataFrame:
    """AGG-01, AGG-02: (keys, n, one double for each of ``ranks``): the values at given ranks of each group, exactly.

    ``ranks`` maps a name to a function of the number of values. Nothing is sorted and no group's values are held: each pass
    counts a group's values in ``bins`` bins between the smallest and the largest candidate, and the bin that holds the rank gives the
    next pass its range, until the bin holds one value. Passes read the rows and shuffle counts alone.

    Null and NaN values, and negative ones (AGG-05), are left out; infinite ones count. A group without values has n 0 and nulls; null
    keys are a group; an empty table gives no rows.
    """
    size = RANK_BINS if bins is None else bins
    key = F.struct(*[F.col(k) for k in keys])
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) >= 0)
    rows = materialize(rows.select(*keys, key.alias("__k"), F.when(good, F.col(value).cast("double")).alias("__v")), "rank-rows")
    groups = rows.groupBy("__k", *keys).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    groups = materialize(groups, "rank-groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank")) for name, f in ranks.items()]))
    # below: values under lo; the bin with the rank is looked for between lo and hi
    state = groups.filter("n > 0").select("__k", wanted.alias("w"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    state = materialize(state.select("__k", "w.name", "w.rank", "lo", "hi", "below"), "rank-state")
    found = []
    while True:
        done, state = state.filter("lo = hi"), state.filter("lo < hi")
        found.append(done.select("__k", "name", F.col("lo").alias("v")))
        if state.isEmpty():
            break
        # a range is met once, whatever the number of ranks that look there
        ranges = state.select("__k", "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if ranges.count() <= 100_000 else ranges
        inside = rows.alias("r").join(ranges.alias("s"), F.col("r.__k").eqNullSafe(F.col("s.__k")) & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        # wide ranges have bins of one ratio, others of one width; zero and infinity are bins of their own
        v, lo, hi = F.col("__v"), F.greatest(F.col("lo"), F.lit(5e-324)), F.least(F.col("hi"), F.lit(1.79e308))
        by_ratio = (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))
        at = F.when(hi > 4 * lo, by_ratio).otherwise((v - F.col("lo")) / (F.col("hi") - F.col("lo")))
        part = F.when(v == 0, -1).when(v == float("inf"), 1 << 30).otherwise(F.floor(at * (size - 1)))
        cells = inside.groupBy("r.__k", "lo", "hi", part.alias("bin")).agg(F.count("*").alias("c"), F.min("__v").alias("from"), F.max("__v").alias("to"))
        order = Window.partitionBy("__k", "lo", "hi").orderBy("from")
        cells = cells.withColumn("upto", F.sum("c").over(order))
        met = state.alias("s").join(cells.alias("c"), F.col("s.__k").eqNullSafe(F.col("c.__k")) & (F.col("s.lo") == F.col("c.lo")) & (F.col("s.hi") == F.col("c.hi")))
        need = F.col("rank") - F.col("below")
        met = met.filter((need <= F.col("upto")) & (need > F.col("upto") - F.col("c")))
        state = materialize(met.select("s.__k", "name", "rank", F.col("from").alias("lo"), F.col("to").alias("hi"), (F.col("below") + F.col("upto") - F.col("c.c")).alias("below")), "rank-state")
    values = functools.reduce(DataFrame.unionByName, found)
    wide = values.groupBy("__k").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return groups.join(wide.withColumnRenamed("__k", "__o"), F.col("__k").eqNullSafe(F.col("__o")), "left").select(*keys, "n", *ranks)
