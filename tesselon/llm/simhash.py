"""SimHash near-duplicates by pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Two documents are linked if their fingerprints
differ in at most ``radius`` bits; the classes are the connected components. With ``prints`` above one a
document has several independent fingerprints and any of them may link it: each edit moves each
fingerprint by chance, so more of them find more of the near copies.

How links are found without comparing all pairs:

* Documents with equal fingerprints collapse to one node first, so a group of exact copies of any size is
  one row from there on (its size only shows in map-side aggregation).
* Each distinct fingerprint gets its pivot table row: the Hamming distances to ``PIVOTS`` reference
  fingerprints.
* Two fingerprints within ``radius`` bits agree in at least ``m`` of ``radius + m`` blocks of bits, so
  the choices of ``m`` blocks partition the comparisons without losing a link. ``m`` follows the
  number of fingerprints, to hold the mean bucket at a few rows at any size.
* Inside a bucket a pair is discarded if any pivot coordinate differs by more than ``radius``
  (triangle inequality), and survivors are verified on the fingerprints themselves.
* A bucket of more than ``CHUNK`` rows is cut into chunks and every pair of chunks is its own unit of
  work, so no task needs more than two chunks in memory. A unit emits a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.components import connected_components
from tesselon.session import materialize

PIVOTS = 16
CHUNK = 4096
_HASH_BLOCK = 1 << 16


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash of shingles from their first one (itself for j = 0): a bijective mix of 64 bits."""
    if not j:
        return h
    x = h ^ np.uint64(xxhash.xxh64_intdigest(str(j).encode(), 42))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(text: str | None, words: int = 3, prints: int = 1) -> list[int]:
    """Unsigned 64-bit SimHashes of a text.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles are ``words``
    words joined by a space, repeats included; a text of fewer words is one shingle, a text of none
    has fingerprints of zero.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return [0] * prints
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    digest, n, ones = xxhash.xxh64_intdigest, 0, np.zeros((prints, 64), np.int64)
    while block := [digest(s, 42) for s in itertools.islice(shingles, _HASH_BLOCK)]:
        h = np.array(block, np.uint64)
        for j in range(prints):
            bits = np.unpackbits(_mixed(h, j).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[j] += bits.sum(0, dtype=np.int64)
        n += len(block)
    return [int.from_bytes(np.packbits(x * 2 > n).tobytes(), "big") for x in ones]


def fingerprint(text: str | None, words: int = 3) -> int:
    return fingerprints_of(text, words)[0]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", prints: int = 1) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, and more, an array of the other fingerprints, if there are several. Whole
    texts are read; a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprints_of(t, words, prints) for t in b["text"]], np.uint64).reshape(-1, prints).view(np.int64)
            out = pd.DataFrame({"doc_id": b["doc_id"], "fp": fps[:, 0]})
            yield out.assign(more=list(fps[:, 1:])) if prints > 1 else out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long" + ", more array<long>" * (prints > 1))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of their numbers, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), 7)).astype(np.int64)) for i in range(n)]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """Adds p0 and p1: the distances to 16 pivots, a byte each."""
    ps = pivots()
    for c in range(2):
        packed = F.lit(0).cast("long")
        for j, p in enumerate(ps[8 * c : 8 * c + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * j))
        distinct = distinct.withColumn(f"p{c}", packed)
    return distinct


def blocks_for(n: int, radius: int) -> int:
    """The number m of matching blocks that keeps the mean bucket under 16 rows."""
    m = 1
    while n / 2 ** (64 * m / (radius + m)) > 16 and m < 4:
        m += 1
    return m


def bucket_keys(radius: int, m: int) -> list:
    """One key column for every choice of m of the radius + m blocks of bits; no choice loses a link alone."""
    k = radius + m
    cuts = [64 * i // k for i in range(k + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(k), m)):
        mask = 0
        for i in chosen:
            mask |= ((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i]
        signed = int(np.uint64(mask).astype(np.int64))
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k")))
    return keys


def _near(piv: np.ndarray, fps: np.ndarray, i, j, radius: int) -> np.ndarray:
    """For index arrays i, j: pairs that no pivot discards and that the fingerprints confirm."""
    keep = np.flatnonzero(np.abs(piv[i, 0] - piv[j, 0]) <= radius)
    if len(keep):
        a, b = (i[keep] if np.ndim(i) else i), (j[keep] if np.ndim(j) else j)
        keep = keep[np.abs(piv[a] - piv[b]).max(1) <= radius]
    if len(keep):
        a, b = (i[keep] if np.ndim(i) else i), (j[keep] if np.ndim(j) else j)
        keep = keep[np.bitwise_count(fps[a] ^ fps[b]) <= radius]
    return keep


def link_runs(units: np.ndarray, fps: np.ndarray, piv: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest (or of all pairs of small units) within runs of equal ``units``."""
    out_a, out_b = [], []
    starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
    lengths = np.diff(np.r_[starts, len(units)])
    small = np.repeat(lengths <= 64, lengths)
    rows = np.flatnonzero(small)
    shift = 1
    while len(rows):
        rows = rows[rows + shift < len(units)]
        rows = rows[units[rows] == units[rows + shift]]
        if len(rows):
            hit = rows[_near(piv, fps, rows, rows + shift, radius)]
            out_a.append(hit)
            out_b.append(hit + shift)
        shift += 1
    for s, n in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
        left = np.arange(s, s + n)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = _near(piv, fps, left, np.full(len(left), x), radius)
                if len(hit):
                    found = left[hit]
                    out_a.append(np.full(len(found), x))
                    out_b.append(found)
                    queue += found.tolist()
                    left = np.delete(left, hit)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_a), cat(out_b)


def _link_partition(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in itertools.chain(batches, [None]):
            whole = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if whole is None or not len(whole):
                continue
            key = whole[["t", "k", "c"]].to_numpy()
            change = np.r_[True, (key[1:] != key[:-1]).any(1)]
            units = np.cumsum(change)
            # the last unit may go on in the next batch
            cut = len(whole) if b is None else int(np.flatnonzero(change)[-1])
            rest = None if b is None else whole.iloc[cut:]
            if not cut:
                continue
            fps, node = whole["fp"].to_numpy()[:cut], whole["node"].to_numpy()[:cut]
            piv = whole[["p0", "p1"]].to_numpy(np.int64)[:cut].copy().view(np.uint8).astype(np.int16)
            a, b2 = link_runs(units[:cut], fps.view(np.uint64), piv, radius)
            yield pd.DataFrame({"a": node[a], "b": node[b2]})

    return run


def links(nodes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between nodes whose components are those of all links within radius.

    ``nodes`` must be cheap to read again (materialized); it has long columns node and fp, and print where nodes
    have several fingerprints, a row each: fingerprints of the same number are compared with each other.
    """
    if "node" not in nodes.columns:
        nodes = nodes.withColumn("node", F.col("fp"))
    if "print" not in nodes.columns:
        nodes = nodes.withColumn("print", F.lit(0))
    n = nodes.filter("print = 0").count()
    keys = bucket_keys(radius, blocks_for(n, radius))
    rows = pivot_table(nodes.select("node", "print", "fp")).select("*", F.explode(F.array(*keys)).alias("key"))
    rows = rows.select("node", "fp", "p0", "p1", (F.col("print") * len(keys) + F.col("key.t")).alias("t"), "key.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["t", "k"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(11)), parts).cast("int")
    # the unit (i, j), i <= j, holds chunks i and j; a row of chunk i is in the units with any j
    unit = F.when(parts == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    )
    rows = rows.select("node", "fp", "p0", "p1", "t", "k", F.explode(unit).alias("c"))
    dealt = rows.repartition("t", "k", "c").sortWithinPartitions("t", "k", "c")
    return dealt.mapInPandas(_link_partition(radius), "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
    prints: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), fingerprint (hex), component_id.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.

    Edge cases: null texts count as empty; empty texts have fingerprint zero and link like any other;
    repeated doc_ids give a row each; a null doc_id stays a row and takes its component's smallest
    non-null doc_id (null if there is none); an empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    node = F.col("fp") if prints == 1 else F.xxhash64("fp", "more")
    fps = materialize(fingerprints(docs, words, id_col, text_col, prints).withColumn("node", node), "simhash-fp")
    # longs alone in both aggregates, so that they hash and do not sort
    distinct = materialize(fps.groupBy("node").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    each = distinct.select("node", F.col("node").alias("fp"))
    if prints > 1:
        each = fps.select("node", F.posexplode(F.concat(F.array("fp"), "more")).alias("print", "fp"))
        each = materialize(each.distinct(), "simhash-prints")
    labels = connected_components(links(each, radius, chunk))
    rooted = distinct.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    out = fps.join(classes, "node")
    return out.select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, words: int = 3, radius: int = 3, prints: int = 1) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Columns and their order stay. Rows that repeat a doc_id are reduced to one of them (the one with
    the smallest text hash). A row with a null doc_id names no document: it takes no part and stays.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    classes = simhash_components(named, words, radius, prints=prints)
    dropped = materialize(
        classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct(),
        "simhash-gone",
    )
    kept = docs.join(dropped, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = materialize(
        docs.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1 and doc_id is not null")
        .select(F.col("doc_id").alias("__again")),
        "simhash-again",
    )
    if again.isEmpty():
        return kept
    single = kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti")
    several = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi")
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))))
    one = several.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
    return single.unionByName(one)


