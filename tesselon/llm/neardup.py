"""Near-duplicates by the Jaccard similarity of distinct word shingles, verified exactly.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least
``threshold``; the classes are the connected components. Candidates come from SimHash, whose links are those of
:mod:`tesselon.llm.simhash` (three-word shingles, 3 of 64 bits at most). Texts at 0.8 differ in about 10 bits, where
blocks of bits fill with strangers, so min-hashes widen the search. An exact check follows both.

* Texts of equal words collapse to one node first, so a group of exact copies of any size is one row.
* Nodes whose fingerprints are equal, or within 3 bits by the blocks of bits of ``simhash.links``, are candidates.
* ``BANDS`` bands of ``ROWS`` min-hashes each: texts at 0.8 miss each other in all of them with
  probability (1 - 0.8 ** 7) ** 44 = 0.00003, more similar ones less.
* Inside a bucket a pair is passed on if ``SKETCH`` bytes of min-hashes put it above ``LOOSE`` (at 0.8 they
  fall below with probability 0.000003). The components of all these pairs are classes of candidates: they need not be
  right, only hold the true links.
* Each class is resolved on the shingle sets themselves, fetched for its members alone. A class of any
  size is cut into chunks and every pair of chunks is its own unit of work; a unit emits a spanning
  forest of the true links among its rows, and the forests together have the components of all links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm import simhash
from tesselon.llm.components import connected_components
from tesselon.session import materialize

BANDS, ROWS = 44, 7
SKETCH, LOOSE = 128, 0.64
#: Rows of a bucket's chunk; least and most rows of a class's chunk, whose rows hold whole shingle sets.
CHUNK, CLASS_CHUNK = 4096, (128, 1024)
#: Shingles that a class's chunk may hold in the mean (4 MB), so that chunks of very long texts have fewer rows.
CHUNK_SHINGLES = 1 << 19
#: Rows of (row key, class) that may be broadcast.
BROADCAST_ROWS = 1_000_000
_BLOCK = 1024


def words_of(text: str | None) -> list[bytes]:
    """Words as in :mod:`tesselon.llm.simhash`: A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_set(w: list[bytes], words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one of none has none."""
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in grams), np.uint64))


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), seed) | 1 for i in range(n)], np.uint64)


def min_hashes(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    a, b = _constants(n, 5)[:, None], _constants(n, 6)[:, None]
    out = np.full(n, np.iinfo(np.uint64).max)
    for s in range(0, len(shingles), _BLOCK):
        x = (shingles[s : s + _BLOCK] ^ b) * a
        # the high bits of a product are the mixed ones
        out = np.minimum(out, ((x ^ (x >> np.uint64(32))) * a).min(1))
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One long a band: the band's number and min-hashes, hashed."""
    rows = mins.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _signatures(words: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes, more, keys, sketches, sizes, fps = [], [], [], [], [], []
            for t in b["text"]:
                w = words_of(t)
                whole = b" ".join(w)
                nodes.append(xxhash.xxh64_intdigest(whole))
                more.append(xxhash.xxh64_intdigest(whole, 7))
                fps.append(simhash.fingerprint(t))
                found = shingle_set(w, words)
                mins = min_hashes(found) if w else None
                sizes.append(len(found))
                keys.append(band_keys(mins) if w else [])
                sketches.append((mins[:SKETCH] >> np.uint64(40)).astype(np.uint8).tobytes() if w else b"")
            node, more, fp = (np.array(x, np.uint64).view(np.int64) for x in (nodes, more, fps))
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "rk": b["rk"], "node": node, "more": more, "fp": fp, "size": sizes, "keys": keys, "sketch": sketches,
            })

    return run


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """Edges of a spanning forest of n rows; near(x, others) says which of the others x is linked to."""
    out_a, out_b, left = [], [], np.arange(n)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                found = left[hit]
                out_a += [x] * len(found)
                out_b += found.tolist()
                queue += found.tolist()
                left = left[~hit]
    return out_a, out_b


def _loose_links(sketches: list[bytes]) -> tuple[list, list]:
    s = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    need = math.floor(SKETCH * LOOSE)
    return _forest(len(s), lambda x, others: (s[others] == s[x]).sum(1) >= need)


def true_links(threshold: float) -> Callable:
    """Spanning forest of the pairs of shingle sets (bytes) whose Jaccard similarity reaches the threshold."""

    def run(sets: list[bytes]) -> tuple[list, list]:
        size = np.array([len(s) // 8 for s in sets])
        _, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        starts = np.r_[0, np.cumsum(size)[:-1]]
        held = np.zeros(len(codes), np.int32)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            own = codes[starts[x] : starts[x] + size[x]]
            held[own] = 1
            both = np.add.reduceat(held[codes], starts)[others]
            held[own] = 0
            return both >= threshold * (size[x] + size[others] - both) - 1e-9

        return _forest(len(sets), near)

    return run


def _by_unit(unit: list[str], column: str, link: Callable) -> Callable:
    """Runs ``link`` on the values of ``column`` of each unit; rows come sorted by unit, units may span batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in itertools.chain(batches, [None]):
            whole = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if whole is None or not len(whole):
                continue
            key = whole[unit].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            ends = np.r_[starts[1:], len(whole)]
            if b is not None:
                rest = whole.iloc[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = None
            node, value, out_a, out_b = whole["node"].to_numpy(), whole[column].to_numpy(), [], []
            for s, e in zip(starts, ends, strict=True):
                if e - s > 1:
                    x, y = link(list(value[s:e]))
                    out_a += [s + i for i in x]
                    out_b += [s + i for i in y]
            if out_a:
                yield pd.DataFrame({"a": node[out_a], "b": node[out_b]})

    return run


def _units(parts: Column) -> Column:
    """Units (i, j), i <= j, of a group in ``parts`` chunks: a row of chunk i is in the units with any j."""
    own = F.pmod(F.xxhash64("node", F.lit(11)), parts).cast("int")
    return F.when(parts == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    )


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` and its nodes (node, rk, size), where texts share a node only if 128 bits of their hashes are equal.

    A node is one long; texts whose ``node`` is equal by chance (tens among 5 * 10 ** 10) have another ``more``, and
    get a node made of both.
    """
    def one_row_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(
            F.min("rk").alias("rk"), F.max("size").alias("size"), (F.min("more") != F.max("more")).alias("mixed")
        )

    nodes = materialize(one_row_each(signed), "near-nodes")
    mixed = nodes.filter("mixed").select(F.col("node").alias("__mixed"))
    if not mixed.isEmpty():
        met = signed.join(mixed, F.col("node") == F.col("__mixed"), "left")
        node = F.when(F.col("__mixed").isNull(), F.col("node")).otherwise(F.xxhash64("node", "more"))
        signed = materialize(met.withColumn("node", node).drop("__mixed"), "near-signatures")
        nodes = materialize(one_row_each(signed), "near-nodes")
    return signed, nodes.drop("mixed")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes (node, fp) by SimHash; nodes of equal fingerprints meet once, at the smallest of them."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "near-prints")
    same = nodes.select("node", "fp").join(prints.filter("n > 1").select("fp", "first"), "fp").filter("node <> first")
    apart = simhash.links(prints.select(F.col("first").alias("node"), "fp"))
    return same.select(F.col("node").alias("a"), F.col("first").alias("b")).union(apart)


def candidate_classes(nodes: DataFrame) -> DataFrame:
    """(node, root): classes of nodes that hold all links; ``nodes`` has node, fp, keys and sketch, one row a node."""
    keys = nodes.select("node", F.explode("keys").alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("n"))
    rows = materialize(keys.join(shared.filter("n > 1").select("k", "n"), "k"), "near-buckets")
    rows = rows.join(nodes.select("node", "sketch"), "node").select(
        "node", "sketch", "k", F.explode(_units(F.ceil(F.col("n") / CHUNK).cast("int"))).alias("c")
    )
    dealt = rows.repartition("k", "c").sortWithinPartitions("k", "c")
    loose = dealt.mapInPandas(_by_unit(["k", "c"], "sketch", _loose_links), "a long, b long").distinct()
    return connected_components(simhash_links(nodes).union(loose))


def near_links(rows: DataFrame, classes: DataFrame, threshold: float, words: int, repeats: bool = False) -> DataFrame:
    """(a, b): true links whose components are those of all true links inside the classes.

    ``rows`` has rk and text, with row keys that come again if ``repeats``; ``classes`` rk, node, size (shingles) and
    root, one row a node.
    """
    least, most = CLASS_CHUNK
    sizes = classes.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    chunk = F.greatest(F.lit(least), F.least(F.lit(most), F.col("n") / 20))
    # no more chunks than rows
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("shingles") / CHUNK_SHINGLES))).cast("int")
    members = materialize(classes.join(sizes, "root").select("rk", "node", "root", parts.alias("parts")), "near-members")
    few = members.count() <= BROADCAST_ROWS

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingle_set(words_of(t), words).tobytes() for t in b["text"]]
            yield b.drop(columns="text").assign(shingles=found)

    texts = rows.join(F.broadcast(members) if few else members, "rk").select("node", "root", "parts", "text")
    texts = texts.dropDuplicates(["node"]) if repeats else texts
    held = texts.mapInPandas(sets, "node long, root long, parts int, shingles binary")
    units = held.select("node", "root", "shingles", F.explode(_units(F.col("parts"))).alias("c"))
    dealt = units.repartition("root", "c").sortWithinPartitions("root", "c")
    run = _by_unit(["root", "c"], "shingles", true_links(threshold))
    return dealt.mapInPandas(run, "a long, b long").distinct()


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Edge cases: texts without words (null, empty) are copies of one another; rows that repeat doc_id and
    text are reduced to one; rows that share a doc_id but not the text are judged each by itself; a row
    with a null doc_id names no document, takes no part and stays; an empty table stays empty. Columns
    and their order stay.
    """
    keyed = docs.withColumn("__rk", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))
    rows = keyed.filter(F.col("__rk").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__rk").alias("rk"), F.col("text").cast("string").alias("text")
    )
    schema = "doc_id long, rk long, node long, more long, fp long, size int, keys array<long>, sketch binary"
    signed, nodes = told_apart(materialize(rows.mapInPandas(_signatures(words), schema), "near-signatures"))
    again = materialize(signed.groupBy("rk").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rk").alias("__again")), "near-again")
    repeats = not again.isEmpty()
    each = signed.join(nodes.select("rk"), "rk", "left_semi").select("node", "fp", "keys", "sketch")
    classes = candidate_classes(each.dropDuplicates(["node"]) if repeats else each)
    links = near_links(rows.select("rk", "text"), classes.join(nodes, "node"), threshold, words, repeats)
    labels = connected_components(links)

    # the first of a class: longs alone are grouped, and only its one row key is carried on
    ids = signed.select("doc_id", "rk", "node").distinct()
    rooted = materialize(ids.join(labels, "node", "left").select("doc_id", "rk", F.coalesce("root", "node").alias("root")), "near-classes")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("first")).select("first.doc_id", "first.rk")
    gone = rooted.select("doc_id", "rk").join(first, ["doc_id", "rk"], "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("__gone_id"), F.col("rk").alias("__gone")), "near-gone")
    is_gone = (F.col("__rk") == F.col("__gone")) & (F.col("doc_id").cast("long") == F.col("__gone_id"))
    kept = keyed.join(gone, is_gone, "left_anti")
    if not repeats:
        return kept.drop("__rk")
    single = kept.join(again, F.col("__rk") == F.col("__again"), "left_anti")
    several = kept.join(again, F.col("__rk") == F.col("__again"), "left_semi")
    order = Window.partitionBy("__rk", "doc_id").orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    one = several.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
    return single.unionByName(one).drop("__rk")
