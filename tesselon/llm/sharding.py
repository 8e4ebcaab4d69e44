"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the first point clockwise of its
hash. Loads are bounded: a shard takes at most its capacity of rows and the keys that overflow it go on
clockwise to the next shard with room. Capacities are floor(n / shards) or one more and sum to n, so
the law that holds is ``rows``: counts differ by at most one.

The walk needs no row: it only depends on how many keys each arc of the ring holds. Arcs are counted
in parallel, the (arcs, of a fixed number) counts are walked on the driver, and the walk's outcome, runs of
ranks within an arc, is joined back by a range condition. A key's rank in its arc comes from hash
buckets of a bounded mean size, and rows that are alike are counted before they are ranked, so neither an arc nor a repeated row of any
size needs a single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.session import materialize

VNODES = 64
BUCKET_ROWS = 8192
#: Rows of one group that a task writes out at a time.
COPIES = 4096


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order (signed 64-bit) and the shard that owns each."""
    points = sorted(
        (int(np.uint64(xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 3)).astype(np.int64)), s)
        for s in range(shards) for v in range(vnodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def walk(counts: dict[int, int], owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) for all keys of all arcs.

    A round lets every shard take from the arcs that stand at one of its points, nearest arc first,
    up to its capacity; what a shard refuses moves one point on.
    """
    n, arcs = sum(counts.values()), len(owner)
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    load = [0] * shards
    waiting = [(0, arc, 0, c) for arc, c in sorted(counts.items()) if c]
    out = []
    while waiting:
        later = []
        for steps, arc, lo, hi in sorted(waiting):
            s = int(owner[(arc + steps) % arcs])
            take = min(hi - lo, capacity[s] - load[s])
            if take:
                out.append((arc, lo, lo + take, s, load[s]))
                load[s] += take
            if lo + take < hi:
                later.append((steps + 1, arc, lo + take, hi))
        waiting = later
    return out


def _key(doc_id: str = "doc_id", text: str = "text") -> dict[str, F.Column]:
    """doc_id, size, checksum and place on the ring of a row; a null id is placed by the text's checksum and size."""
    body = F.coalesce(F.col(text), F.lit(""))
    doc, size, crc = F.col(doc_id).cast("long"), (F.octet_length(body) + 1).cast("long"), F.crc32(body.cast("binary"))
    return {"doc_id": doc, "size": size, "text_crc32": crc, "at": F.when(doc.isNotNull(), F.xxhash64(doc)).otherwise(F.xxhash64(crc, size))}


def _ranked(groups: DataFrame, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame, int]:
    """(groups with arc and first, their first rank in the arc; the runs of ranks a shard takes; the largest group).

    ``groups`` (doc_id, size, text_crc32, at, n and further columns) stand for n rows each, so that rows which are alike are counted
    before they are ordered. Order in an arc: buckets by place, and behind them, by checksum, the groups of places that hold
    more than a bucket's share (many texts under one id).
    """
    spark = groups.sparkSession
    points, owner = ring(shards, vnodes)

    def arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(arc=(np.searchsorted(points, b["at"].to_numpy()) % len(points)).astype(np.int32))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    groups = materialize(groups.mapInPandas(arcs, f"{shape}, arc int"), "shard-groups")
    seen = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    bits = max(0, math.ceil(math.log2(max(1, seen["groups"]) / BUCKET_ROWS)))
    # one row for each bucket's worth of groups at most
    full = materialize(groups.groupBy("at").agg(F.count("*").alias("k")).filter(F.col("k") > BUCKET_ROWS).select("at", F.lit(True).alias("full")), "shard-full")
    full = F.broadcast(full) if full.count() <= 1_000_000 else full
    groups = groups.join(full, "at", "left").withColumns({
        # high bits of the place in ring order (signed), so buckets of an arc follow each other
        "bucket": F.shiftright("at", 64 - bits) if bits else F.lit(0).cast("long"),
        "sub": F.when(F.col("full"), F.shiftright("text_crc32", 20)).otherwise(-1).cast("int"),
    })
    place = ["arc", "bucket", "sub"]
    sizes = groups.groupBy(*place).agg(F.sum("n").alias("held"))
    ahead = Window.partitionBy("arc").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("n0", F.coalesce(F.sum("held").over(ahead), F.lit(0))), "shard-sizes")
    counts = {r["arc"]: r["n"] for r in sizes.groupBy("arc").agg(F.sum("held").alias("n")).collect()}  # one row an arc
    runs = spark.createDataFrame(walk(counts, owner, shards), "arc int, lo long, hi long, shard int, slot0 long")
    others = [c for c in groups.columns if c not in (*place, "at", "n", "full", "doc_id", "text_crc32", "size")]
    inside = Window.partitionBy(*place).orderBy("at", "doc_id", "text_crc32", "size", *others).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sizes.drop("held"), place)
    return groups.withColumn("first", F.col("n0") + F.col("before")).drop("bucket", "sub", "full", "before", "n0", "at"), runs, seen["most"] or 0


def _copies(groups: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """A row for each of a group's n rows, with shard and slot instead of arc, first and n."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    rows = groups.withColumn("piece", piece)
    if most > COPIES:  # large groups are dealt out piece by piece
        rows = rows.repartition("piece", "first", "arc")
    start = F.col("first") + F.col("piece") * COPIES
    rows = rows.withColumn("rank", F.explode(F.sequence(start, F.least(start + COPIES, F.col("first") + F.col("n")) - 1))).alias("k")
    # at most shards * vnodes runs and one more for every time a shard fills up: a fixed bound
    met = rows.join(F.broadcast(runs.alias("w")), (F.col("k.arc") == F.col("w.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    kept = [F.col(f"k.`{c}`") for c in groups.columns if c not in ("arc", "first", "n")]
    return met.select(*kept, "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """``docs`` rows as (doc_id, size, text_crc32, shard, slot); slots are gapless from 0 in each shard.

    size is the text's UTF-8 bytes plus one. A key's place on the ring is the hash of its doc_id.

    Edge cases: a null text has no bytes (size 1, checksum 0); a row with a null doc_id is placed by its
    text's checksum and size; repeated rows, of any number, share a place on the ring and get slots of their own; with
    fewer rows than shards some shards stay empty; an empty table gives no rows; other columns are
    not read.
    """
    names = ["doc_id", "size", "text_crc32", "at"]
    groups = docs.select(*[c.alias(k) for k, c in _key().items()]).groupBy(*names).agg(F.count("*").alias("n"))
    return _copies(*_ranked(groups, shards, vnodes)).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """``docs`` with shard (int) and slot (long) beside its columns; columns of these names are replaced.

    Rows that are alike in all columns (by 128 bits of hash) are one group until they get their slots, so it does not matter which of
    them is which, and no task counts or collects them.

    Edge cases: as for :func:`assign_shards`; null and empty texts keep their rows; an empty table gives none.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    whole = [F.col(f"`{c}`") for c in kept]
    two = {"__a": F.xxhash64(*whole), "__b": F.xxhash64(F.lit(7), *whole)}
    alike = docs.withColumns(two).groupBy("__a", "__b").agg(F.any_value(F.struct(*whole)).alias("__row"), F.count("*").alias("n"))
    # the keys are counted without the texts; the join finds both sides dealt out by the two hashes
    keys = docs.select(*[c.alias(k) for k, c in (_key() | two).items()]).groupBy("__a", "__b", "doc_id", "size", "text_crc32", "at").agg(F.count("*").alias("n"))
    ranked, runs, most = _ranked(keys, shards, vnodes)
    rows = alike.drop("n").join(ranked.select("__a", "__b", "arc", "first", "n"), ["__a", "__b"])
    out = _copies(rows.drop("__a", "__b"), runs, most)
    return out.select(*[F.col("__row")[c].alias(c) for c in kept], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the output of :func:`shard_documents` as folders shard=j, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
