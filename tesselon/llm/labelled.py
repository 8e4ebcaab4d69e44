"""What the trained operators share: hold-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 0) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents, whole texts, the same ones each time.

    With ``folds`` the rows of remainder 0 are left out. Labels that repeat a doc_id count by majority
    (a tie as 1); null ids and labels are left out. Of documents that repeat a doc_id one text is taken (the
    one with the smallest hash), so that the bound holds for any input.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if folds:
        y = y.filter(fold(folds) != 0)
    y = y.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    # the bound lets this side be broadcast
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "__y")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = rows.join(F.broadcast(y), F.col("doc_id") == F.col("__y")).select("doc_id", "text", "y")
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("one"))
    return one.select("doc_id", "one.text", "one.y")
