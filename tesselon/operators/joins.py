"""Joins whose keys may be hot: keys cut into pairs of chunks, and a set-similarity join on prefixes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.session import materialize

#: Rows of a key that one task meets at most, on each side.
CHUNK_ROWS = 2000
#: Longs of parities that a set is told apart by: before its pairs are made, and once they are.
PARITIES, FINE_PARITIES = 8, 64
#: Pairs that are looked at together in a task.
PAIRS_AT_ONCE = 1 << 19


def chunked_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None, rows: int | None = None) -> DataFrame:
    """Inner join of ``left`` and ``right`` (aliases l and r in ``condition``) on ``keys``, which no task holds whole.

    A key with more than ``rows`` rows on a side is cut there into chunks by a hash of the row. Each chunk of one side meets each
    of the other, so a hot key is as many units of work as pairs of chunks, and each row is copied once for each chunk of the other
    side. Keys that are on one side alone are dropped before that. Rows with a null key meet nothing. Columns of
    both sides but the keys must differ; the keys come out once.
    """
    size = CHUNK_ROWS if rows is None else rows
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = materialize(count(left, "__nl").join(count(right, "__nr"), keys).filter("__nl > 1 OR __nr > 1"), "hot-keys")
    # at most one key for each ``rows`` rows
    hot = F.broadcast(parts) if parts.count() <= 1_000_000 else parts

    def side(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        met = df.join(hot, keys, "left")
        whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        met = met.withColumn(mine, F.pmod(whole, F.coalesce(own, F.lit(1))).cast("int"))
        return met.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__nl", "__nr")

    a, b = side(left, "__nl", "__nr", "__i", "__j").alias("l"), side(right, "__nr", "__nl", "__j", "__i").alias("r")
    on = [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in [*keys, "__i", "__j"]] + ([] if condition is None else [condition])
    kept = [F.col(f"l.`{c}`") for c in left.columns] + [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return a.join(b, functools.reduce(lambda x, y: x & y, on)).select(*kept)


def set_classes(sets: DataFrame, id_col: str = "id", set_col: str = "words") -> DataFrame:
    """(id, class_id): rows with the same set of words share a class, named by its smallest id; nulls among the words are left out."""
    same = F.sort_array(F.array_distinct(F.array_compact(F.coalesce(set_col, F.array().cast("array<string>")))))
    keyed = sets.select(F.col(id_col).alias("id"), F.sha2(F.to_json(same), 256).alias("h"))
    return keyed.join(keyed.groupBy("h").agg(F.min("id").alias("class_id")), "h").select("id", "class_id")


def _parities(ws: pa.Array) -> pa.Array:
    """FINE_PARITIES longs a list of numbers: each bit is the parity of the numbers that fall on it."""
    out = np.zeros((len(ws), FINE_PARITIES), np.uint64)
    for s in range(0, len(ws), 256):
        some = ws.slice(s, 256)
        at = (some.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        row = s + np.repeat(np.arange(len(some)), some.value_lengths().to_numpy(zero_copy_only=False))
        np.bitwise_xor.at(out, (row, at >> np.uint64(6)), np.uint64(1) << (at & np.uint64(63)))
    return pa.array([r.tobytes() for r in out], pa.binary())


def _coarse(fine: pa.Array) -> pa.Array:
    """PARITIES longs of each row of :func:`_parities`, whose bits are folded."""
    longs = np.frombuffer(b"".join(fine.to_pylist()), np.uint64).reshape(-1, FINE_PARITIES // PARITIES, PARITIES)
    return pa.array([r.tobytes() for r in np.bitwise_xor.reduce(longs, axis=1)], pa.binary())


def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint64).reshape(len(v), -1) for v in (a, b))
    return pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int32))


def _least(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Words that sets of these sizes share at least if they are similar."""
    return np.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)


def _candidates(threshold: float):
    """Batches of rows (w, i, j, c, r, n, at, p), sorted by the unit (w, i, j), to the pairs (a, b) of r in a unit that may be similar.

    A unit holds one chunk of a word's rows (i = j), which meet one another, or two (by c), of which each meets the other. What
    is kept between batches is one unit.
    """

    def pairs(c: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = ends - np.arange(len(ends)) - 1
        upto = np.cumsum(many)
        # rows whose partners are looked at together
        first = 0
        while first < len(many):
            base = upto[first] - many[first]
            last = max(first + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")))
            k = many[first:last]
            a = np.repeat(np.arange(first, last), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            first = last
            na, nb = c["n"][a], c["n"][b]
            good = (np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9) & ((c["i"][a] == c["j"][a]) | (c["c"][a] != c["c"][b]))
            a, b, na, nb = a[good], b[good], na[good], nb[good]
            least = _least(na, nb, threshold)
            good = 1 + np.minimum(na - c["at"][a] - 1, nb - c["at"][b] - 1) >= least
            a, b, na, nb, least = a[good], b[good], na[good], nb[good], least[good]
            # each differing bit is a word that only one of them holds
            good = na + nb - np.bitwise_count(c["p"][a] ^ c["p"][b]).sum(1, dtype=np.int64) >= 2 * least
            x, y = c["r"][a[good]], c["r"][b[good]]
            found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in _and_end(batches):
            if batch is not None:
                c = {k: v.to_numpy(zero_copy_only=False) for k, v in zip(batch.schema.names, batch.columns, strict=True) if k != "p"}
                c["p"] = np.frombuffer(b"".join(batch.column("p").to_pylist()), np.uint64).reshape(-1, PARITIES)
                kept = c if kept is None else {k: np.concatenate([kept[k], c[k]]) for k in c}
            if kept is None or not len(kept["w"]):
                continue
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([kept[k][1:] != kept[k][:-1] for k in ("w", "i", "j")])])
            # the last unit may go on in the next batch
            done = len(kept["w"]) if batch is None else new[-1]
            ends = np.repeat(np.r_[new[1:], len(kept["w"])], np.diff(np.r_[new, len(kept["w"])]))[:done]
            yield from pairs({k: v[:done] for k, v in kept.items()}, ends)
            kept = {k: v[done:] for k, v in kept.items()}

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def similar_sets(sets: DataFrame, threshold: float = 0.8, id_col: str = "id", set_col: str = "words") -> DataFrame:
    """SET-06: (a, b, jaccard) of all pairs a < b of classes (see :func:`set_classes`) with a Jaccard similarity of ``threshold`` at least.

    Words are ordered by rarity. Two sets that are that similar share a word among the first n - ceil(t n) + 1 of each (prefix),
    their sizes differ by no more than t (size), what can follow the shared place is enough (position), and so is what the
    parities of their words leave room for (bits): each differing bit is a word that only one of them holds. The rows of a word meet in
    its task, where they are sent once; hot words are cut into chunks. What passes is sifted again by more parities, and
    counted on the sets. Words travel as numbers, and sets only where a pair is all but sure. Equal sets are one class, so copies make no
    pairs. An empty set is similar to no other class. ``threshold`` is over 0.
    """
    named = sets.select(F.col(id_col).alias("id"), F.array_distinct(F.array_compact(F.coalesce(set_col, F.array().cast("array<string>")))).alias("words"))
    named = materialize(named, "similar-sets")
    classes = materialize(set_classes(named).filter("id = class_id").select("id").distinct(), "similar-classes")
    few = classes.count() <= 1_000_000
    named = named.join(F.broadcast(classes) if few else classes, "id", "left_semi")
    # an id may be repeated with another set: the class is what counts
    if not named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        named = named.dropDuplicates(["id"])
    words = named.select("id", F.explode("words").alias("w"))
    # numbers rise with the frequency, so a set is in order of rarity by its numbers alone
    no = materialize(words.groupBy("w").agg(F.count("*").alias("df")).orderBy("df", "w").select("w", F.monotonically_increasing_id().alias("no")), "similar-words")
    ranked = words.join(no, "w").groupBy("id").agg(F.sort_array(F.collect_list("no")).alias("ws"))
    ranked = ranked.select(F.monotonically_increasing_id().alias("r"), "id", "ws")
    ranked = materialize(ranked.withColumn("fine", F.arrow_udf(_parities, "binary")("ws")), "similar-ranked")
    n = F.size("ws")
    # a little less than t n, so that rounding loses no pair
    prefix = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    coarse = ranked.select("r", "ws", F.arrow_udf(_coarse, "binary")("fine").alias("p"))
    keyed = coarse.select("r", n.alias("n"), "p", F.posexplode(F.slice("ws", F.lit(1), prefix)).alias("at", "w"))
    counts = ranked.select(F.explode(F.slice("ws", F.lit(1), prefix)).alias("w")).groupBy("w").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("m"))
    hot = materialize(counts.filter("m > 1"), "hot-words")
    met = keyed.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "w", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    met = met.withColumn("c", F.pmod(F.xxhash64("r"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    units = met.select("w", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "r", "n", "at", "p").repartition("w", "i", "j").sortWithinPartitions("w", "i", "j")
    pairs = units.mapInArrow(_candidates(threshold), "a long, b long").distinct()
    part = lambda c, s: ranked.select(F.col("r").alias(s), F.col(c).alias(f"{c}_{s}"), F.size("ws").alias(f"n_{s}"))
    seen = pairs.join(part("fine", "a"), "a").join(part("fine", "b"), "b")
    seen = seen.withColumn("differ", F.arrow_udf(_differing, "int").asNondeterministic()("fine_a", "fine_b"))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    sure = materialize(seen.filter(F.col("n_a") + F.col("n_b") - F.col("differ") >= 2 * least).select("a", "b"), "similar-pairs")
    whole = lambda s: ranked.select(F.col("r").alias(s), F.col("id").alias(f"id_{s}"), F.col("ws").alias(f"w{s}"))
    met = sure.join(whole("a"), "a").join(whole("b"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    met = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), (shared / (F.size("wa") + F.size("wb") - shared)).alias("jaccard"))
    return met.filter(F.col("jaccard") >= threshold)


def rank_in_bits(flags: list[Column]) -> Column:
    """Flags as bits of a number, the first one lowest; null counts as false."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def rarest_but_one(words: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """``words`` (keys, w) without the most frequent word of each group by ``counts`` (w, n), ties by word.

    Two groups that share two words still share one if both are cut by the same counts: the rarer of the two is the most frequent of neither.
    """
    top = Window.partitionBy(*keys).orderBy(F.desc("n"), "w")
    return words.join(counts, "w").withColumn("__rn", F.row_number().over(top)).filter("__rn > 1").drop("__rn", "n")
