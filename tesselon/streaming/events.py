"""Event streams that Spark's own watermarked aggregates express, and the merge of a stream into a table; see ``timers`` for keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_quota_stream(events: DataFrame, limit: int = 20, late: str = "1 day") -> DataFrame:
    """STM-11: tumbling days by event time, with a watermark so state is dropped."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy("user_id", day).agg(F.count("*").alias("used"))
    return out.select("user_id", F.col("window.start").alias("day"), "used", F.least("used", F.lit(limit)).alias("allowed"))


def once_stream(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """STM-07, STM-13: the first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merge_latest(path: str, keys: list[str], order: str):
    """STM-09: a foreachBatch function that keeps the latest row of each key in the Parquet table at ``path``.

    Versions alternate between two folders, so a batch that fails leaves the table as it was.
    """
    from tesselon.operators.index import latest

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            rows = spark.read.parquet(f"{path}/v{(batch_id + 1) % 2}").unionByName(batch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            rows = batch
        latest(rows, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/v{batch_id % 2}")

    return merge
