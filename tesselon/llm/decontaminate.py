"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Question: which documents hold at least ``threshold`` of the word shingles of a (short) test item?
Containment is measured against the item, whose size is tiny beside a long document's, so plain
Jaccard MinHash fails. Here items are partitioned by size (powers of two) and every item keeps a bottom-k
MinHash sketch: of n shingles the ``n - ceil(threshold * n) + 1`` smallest shingle hashes. A document that
contains enough of the item lacks at most ``k - 1`` of its shingles, so it must share one of these
k: no true pair is lost, at any document length. Each partition has a bound, the largest hash that
one of its sketches keeps, and a document is probed partition by partition: (partition, hash) for its
shingle hashes up to the partition's bound. Before they are exploded, a table of hash prefixes that occur in any
sketch (one byte a prefix, at most 2 ** 16 of them) drops shingles that can match nothing.

Pairs that share a sketch hash are candidates, verified by exact containment of the shingles themselves.
Texts are known by their SHA-256, so a group of exact copies is searched for once from there on. Sketches are
broadcast only if their number is at most ``BROADCAST_ROWS``; beyond that the same join is a shuffled one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.session import materialize

#: Rows of (hash, item) or (shingle, item) that may be broadcast: at most about 100 MB.
BROADCAST_ROWS = 1_000_000
#: Most bits of a hash prefix; the table of prefixes is 64 KB at most.
PREFIX_BITS = 16


def words_of(text: str) -> Column:
    """Lower-cased words: runs of anything but ASCII white space; none for null."""
    flat = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def text_id(text: str) -> Column:
    """A text's identity, 32 bytes: the SHA-256 of its UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _positions(words: Column, k: int) -> Column:
    """Start positions of the shingles: one for a text of 1 to k words, none for an empty one."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )


def shingle_hashes(words: Column, k: int) -> Column:
    return F.transform(_positions(words, k), lambda i: F.xxhash64(F.slice(words, i, k)))


def shingles(words: Column, k: int) -> Column:
    return F.transform(_positions(words, k), lambda i: F.array_join(F.slice(words, i, k), " "))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _prefix_filter(sketch: DataFrame, rows: int):
    """A test on hashes: may this one be in a sketch? Never false for one that is."""
    bits = min(PREFIX_BITS, max(1, math.ceil(math.log2(8 * rows + 1))))
    prefix = lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int")
    table = bytearray(1 << bits)
    for r in sketch.select(prefix(F.col("h")).alias("p")).distinct().collect():  # at most 2 ** PREFIX_BITS rows
        table[r["p"]] = 1
    return lambda h: F.substring(F.lit(bytes(table)), prefix(h) + 1, F.lit(1)) == F.lit(b"\x01")


def _contained(texts: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """(text_id, item_id, matched, item_shingles) of texts that hold enough of an item; None without items.

    ``texts`` has text_id and text and may repeat.
    """
    # a column of its own below each explode: inside a lambda the split would run again for every position
    d = texts.select("text_id", "text", words_of("text").alias("words"))
    words = F.col("words")
    i = items.select("item_id", text_id("text").alias("__of"), words_of("text").alias("words"))
    i = i.select("item_id", "__of", F.explode(F.array_distinct(shingles(words, k))).alias("shingle")).distinct()
    # a small table is not worth many tasks
    i = materialize(i.withColumn("h", F.xxhash64(F.split("shingle", " "))), "items")
    sizes = i.groupBy("item_id", "__of").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs"))
    sketch = sizes.select(
        "item_id", "__of", F.floor(F.log2("n")).cast("int").alias("size_class"),
        F.explode(F.slice("hs", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("h"),
    )
    sketch = materialize(sketch, "sketch")
    bounds = sketch.groupBy("size_class").agg(F.max("h").alias("top"), F.count("*").alias("rows")).collect()
    if not bounds:
        return None
    rows, top = sum(b["rows"] for b in bounds), max(b["top"] for b in bounds)
    may = _prefix_filter(sketch, rows)
    found = F.filter(shingle_hashes(words, k), lambda h: (h <= F.lit(top)) & may(h))
    hit = d.select("text_id", F.explode(F.array_distinct(found)).alias("h"))
    # each partition is probed with the hashes up to its own bound
    classes = F.array(*[F.struct(F.lit(b["size_class"]).alias("c"), F.lit(b["top"]).alias("top")) for b in bounds])
    admitted = F.filter(classes, lambda b: F.col("h") <= b["top"])
    probes = hit.select("text_id", "h", F.explode(F.transform(admitted, lambda b: b["c"])).alias("size_class"))
    pairs = probes.join(_sized(sketch, rows), ["size_class", "h"]).select("text_id", "item_id", "__of").distinct()
    pairs = materialize(pairs, "candidates")

    n_items = i.count()
    suspects = materialize(pairs.select(F.col("text_id").alias("__suspect")).distinct(), "suspects")
    same_item = lambda a, b: F.col(f"{a}.item_id").eqNullSafe(F.col(f"{b}.item_id")) & (F.col(f"{a}.__of") == F.col(f"{b}.__of"))
    # texts meet the suspects as they are; only those of suspects are cut into words
    few = texts.join(_sized(suspects, suspects.count()), F.col("text_id") == F.col("__suspect"), "left_semi")
    held = (
        few.select("text_id", words_of("text").alias("words"))
        .select("text_id", F.explode(shingles(words, k)).alias("shingle"))
        .join(_sized(i.select("shingle", "__of", "item_id"), n_items), "shingle")
        .distinct()
        .groupBy("text_id", "item_id", "__of")
        .agg(F.count("*").alias("matched"))
    )
    held = held.alias("a").join(pairs.alias("b"), same_item("a", "b") & (F.col("a.text_id") == F.col("b.text_id")), "left_semi").alias("a")
    out = held.join(sizes.alias("b"), same_item("a", "b"))
    return out.filter(F.col("matched") / F.col("n") >= threshold).select("text_id", "a.item_id", "matched", F.col("n").alias("item_shingles"))


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8
) -> DataFrame:
    """Pairs (doc_id, item_id, matched, item_shingles, containment) with containment >= threshold.

    ``docs`` has doc_id and text, ``items`` item_id and text. Sets of shingles count, so repeats in
    either text do not matter. A text of fewer than k words is one shingle. Documents without a
    contaminating item have no row.

    Edge cases: null and empty texts have no shingles and never match; rows that repeat an id and
    text give one pair; rows that share an id but not the text are judged each by itself; null ids
    stay null; empty tables give no rows; other columns are not read.
    """
    found = _contained(docs.select(text_id("text").alias("text_id"), "text"), items, k, threshold)
    if found is None:
        schema = "doc_id long, item_id long, matched long, item_shingles long, containment double"
        return docs.sparkSession.createDataFrame([], schema)
    found = materialize(found, "contained")
    rows = docs.select("doc_id", text_id("text").alias("__id"))
    bad = _sized(found.select(F.col("text_id").alias("__bad")).distinct(), found.count())
    rows = rows.join(bad, F.col("__id") == F.col("__bad"), "left_semi").distinct()
    return rows.join(found, F.col("__id") == F.col("text_id")).select(
        "doc_id", "item_id", "matched", "item_shingles", (F.col("matched") / F.col("item_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain a test item; columns stay, clean rows stay.

    Each row is judged by its own text: rows that share a doc_id, or have none, but not the text don't
    go with each other.
    """
    found = _contained(docs.select(text_id("text").alias("text_id"), "text"), items, k, threshold)
    if found is None:
        return docs
    bad = materialize(found.select(F.col("text_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(_sized(bad, bad.count()), text_id("text") == F.col("__bad"), "left_anti")
