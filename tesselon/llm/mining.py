"""Hard-negative mining over k-means inverted lists, exact by Cauchy-Schwarz bounds.

Vectors become integers; a score is their integer inner product with an anchor. Centroids are fitted on a bounded
sample, every row is put on the list of its nearest centroid, and each list keeps its radius, the largest distance of a
row from the centroid c. For an anchor a every score of the list lies in a.c - |a| r to a.c + |a| r. An anchor visits
lists by falling upper bound, skips those whose interval misses the wanted window of scores, and stops when the upper
bound falls strictly below the k-th best score that is known by then (of the sampled rows, which are rows like any other),
so that ties are still met. What is left out cannot be among the first k: the result is exact.

Two such searches are made: for an anchor's positives, and for the negatives in each positive's window. Lists are packed
into about ``UNITS`` units, of more rows the more there are (``unit_rows``, within bounds), and a list that is larger is cut into
several, so a list that holds a third of all rows is many units of work. A task holds one unit and reads the anchors
that visit it batch by batch; a unit returns its k best an anchor. An anchor goes to each unit it visits, so what is sent grows
with anchors times units; it is made ``ASK_ROWS`` rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm.ann import kmeans, nearest
from tesselon.session import materialize

#: Bound of the sample that fits the centroids and gives the first k-th scores; bound of the centroids.
SAMPLE_ROWS, CENTROIDS = 8192, 1024
#: Units that the lists are packed into; rows of a unit at least, and at most (lists of one centroid aside, which are cut).
UNITS, UNIT_ROWS, UNIT_MOST = 128, 1024, 16384
#: Anchors that are scored at once; rows of anchors and units that are handed on at once.
ASKS_AT_ONCE, ASK_ROWS = 128, 4096
SEED = 11
_LONG = np.iinfo(np.int64)


def integers(v: str, scale: int) -> F.Column:
    """floor(scale * x) of each component; beyond the range of a long it saturates."""
    return F.transform(F.col(v), lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def takes_part(v: str) -> F.Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of a by rows of x); beyond the range of a long they saturate."""
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    largest = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * a.shape[1]
    if largest < 2.0**53:  # every partial sum is an integer that a double holds
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ x.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def bounds(a: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the scores of each list's rows with anchor a, with room for rounding."""
    a = a.astype(np.float64)
    mid, off = centers @ a, np.sqrt((a**2).sum()) * radii
    room = 1e-9 * (np.abs(centers) @ np.abs(a) + off) + 1e-6
    return mid - off - room, mid + off + room


def visits(low: np.ndarray, high: np.ndarray, least: int | None, most: int | None, kth: int | None) -> np.ndarray:
    """Lists by falling upper bound that meet the window least to most, up to the first bound strictly below kth."""
    order = np.argsort(-high, kind="stable")
    meets = np.ones(len(order), bool)
    if least is not None:
        meets &= high[order] >= least
    if most is not None:
        meets &= low[order] <= most
    order = order[meets]
    if kth is not None:
        order = order[: np.searchsorted(-high[order], -float(kth), side="right")]
    return order


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def _kth(scores: np.ndarray, k: int) -> int | None:
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else None


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score."""
    return max(-((-low * score) // 100), _LONG.min), min((high * score) // 100, _LONG.max)


def unit_rows(n: int) -> int:
    """Rows of a unit of a table of ``n`` rows."""
    return max(UNIT_ROWS, min(n // UNITS, UNIT_MOST))


class Lists:
    """Centroids, radii and the units that hold each list; as large as the number of centroids."""

    def __init__(self, centers: np.ndarray, radii: np.ndarray, sizes: np.ndarray):
        most = unit_rows(int(sizes.sum()))
        self.centers, self.radii, self.chunks = centers, radii, np.maximum(1, -(-sizes // most))
        self.first, used, unit = np.zeros(len(sizes), np.int64), 0, 0
        for c, n in enumerate(sizes):
            if used and used + n > most:
                unit, used = unit + 1, 0
            self.first[c] = unit
            if n > most:
                unit, used = unit + int(self.chunks[c]), 0
            else:
                used += int(n)

    def units(self, lists: np.ndarray) -> list[tuple[int, bytes]]:
        """(unit, the visited lists as bytes of int32) of all units that hold any of ``lists``."""
        n = self.chunks[lists]
        of = np.repeat(lists, n)
        at = np.repeat(self.first[lists], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((of, at))
        of, at = of[order].astype(np.int32), at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        return [(int(at[s]), of[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], len(at)], strict=True)] if len(at) else []


_SHAPE = "unit long, ask boolean, key long, vec_id long, label long, list int, q binary, floors array<long>, ceilings array<long>, lists binary"


def _matrix(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, dim)


_COLUMNS = [x.split()[0] for x in _SHAPE.split(", ")]


def asks_of(lists: Lists, filled: np.ndarray, sample: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, percent: tuple[int, int] | None):
    """Batches of anchors to rows of ``_SHAPE``, one an anchor and unit that it visits, ``ASK_ROWS`` at a time at most.

    ``sample`` holds the ids, labels and vectors of known rows, ``filled`` the lists that have rows. ``percent`` are the bounds of the windows around an
    anchor's scores; without them its own label is searched, without a window.
    """
    s_ids, s_labels, s_x = sample
    centers, radii = lists.centers[filled], lists.radii[filled]

    def visited(x, own, label, known, scores) -> tuple[list[int], list[int], np.ndarray]:
        lo_of, hi_of = bounds(x, centers, radii)
        if percent is None:
            kth = _kth(known[(s_labels == label) & (s_ids != own)], k)
            return [_LONG.min if kth is None else kth], [_LONG.max], visits(lo_of, hi_of, None, None, kth)
        got, floors, tops, met = known[s_labels != label], [], [], np.zeros(0, np.int64)
        for p in scores:
            least, most = window(int(p), *percent)
            kth = _kth(got[(got >= least) & (got <= most)], k) if least <= most else None
            floors.append(max(least, _LONG.min if kth is None else kth))
            tops.append(most)
            if least <= most:
                met = np.union1d(met, visits(lo_of, hi_of, least, most, kth))
        return floors, tops, met

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            for at in range(0, len(b), ASKS_AT_ONCE):
                part = b.iloc[at : at + ASKS_AT_ONCE]
                x = _matrix(part["q"], s_x.shape[1])
                scores = [None] * len(part) if percent is None else part["scores"]
                for row, key, own, label, q, known, found in zip(x, part["key"], part["vec_id"], part["label"], part["q"], products(x, s_x), scores, strict=True):
                    floors, tops, met = visited(row, own, label, known, found)
                    out += [(u, True, key, own, label, 0, q, floors, tops, seen) for u, seen in lists.units(filled[met])]
                    while len(out) >= ASK_ROWS:
                        yield pd.DataFrame(out[:ASK_ROWS], columns=_COLUMNS)
                        out = out[ASK_ROWS:]
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _search(index: DataFrame, asks: DataFrame, lists: Lists, dim: int, k: int, same_label: bool) -> DataFrame:
    """(key, no, vec_id, score): for each ask and each of its windows the k first rows, over all units it visits.

    ``asks`` has the columns of ``_SHAPE``; floors and ceilings hold one window of scores each (null: open).
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b["list"].to_numpy()
            unit = lists.first[c] + b["key"].to_numpy() % lists.chunks[c]
            yield b.assign(unit=unit, ask=False, floors=None, ceilings=None, lists=None)[_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, x, ids, labels, of = None, [], None, None, None, None
        for b in batches:
            unit, is_ask, out = b["unit"].to_numpy(), b["ask"].to_numpy(bool), []
            mark = unit * 2 + is_ask
            starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                if unit[s] != now:
                    now, parts = unit[s], []
                if not is_ask[s]:  # a unit's rows come before the asks
                    parts.append(b.iloc[s:e])
                    x = None
                    continue
                if not parts:
                    continue
                if x is None:
                    whole = pd.concat(parts)
                    x, ids, of = _matrix(whole["q"], dim), whole["vec_id"].to_numpy(), whole["list"].to_numpy()
                    labels = whole["label"].to_numpy()
                for at in range(s, e, ASKS_AT_ONCE):
                    a = b.iloc[at : min(e, at + ASKS_AT_ONCE)]
                    found = products(_matrix(a["q"], dim), x)
                    for row, key, own, label, floors, tops, seen in zip(
                        found, a["key"], a["vec_id"], a["label"], a["floors"], a["ceilings"], a["lists"], strict=True
                    ):
                        fits = (labels == label) & (ids != own) if same_label else labels != label
                        fits &= (row >= min(floors)) & (row <= max(tops))
                        some = np.flatnonzero(fits)
                        some = some[np.isin(of[some], np.frombuffer(seen, np.int32))]
                        got = row[some]
                        for no, (lo, hi) in enumerate(zip(floors, tops, strict=True)):
                            good = some[(got >= lo) & (got <= hi)]
                            best = good[first(row[good], ids[good], k)]
                            if len(best):
                                out.append((np.full(len(best), key), np.full(len(best), no, np.int32), ids[best], row[best]))
            if out:
                yield pd.DataFrame(dict(zip(["key", "no", "vec_id", "score"], map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # where a row of a large list goes does not matter, as whoever visits the list visits all its units
    dealt = index.withColumn("key", F.monotonically_increasing_id())
    rows = dealt.select("key", "vec_id", "label", "list", "q").mapInPandas(place, _SHAPE)
    both = rows.unionByName(asks).repartition("unit").sortWithinPartitions("unit", "ask")
    found = both.mapInPandas(run, "key long, no int, vec_id long, score long")
    order = Window.partitionBy("key", "no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchor_every: int = 100,
    scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``. An anchor's positives are its ``positives``
    best other rows of its label; for each, the ``negatives`` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller id.

    Edge cases: rows with a null id, label or vector, or with null or non-finite components, take no part; shorter vectors
    count as filled up with zeros, so an empty one scores 0; a row that has the anchor's own id is none of its positives;
    other repeated rows count each; anchors that repeat in all columns are one anchor, those that share the id alone
    are anchors each; a negative positive_score leaves an empty window unless high and low are equal; components and scores saturate at the range
    of a long; an anchor without positives or negatives gives no rows, as an empty table does; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part("v"))
    rows = rows.select("vec_id", "label", integers("v", scale).alias("q"))
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    n_all, dim = shape["n"], max(1, shape["dim"] or 1)
    if not n_all:
        return spark.createDataFrame([], schema)
    # a share below the bound, then the bound itself in a fixed order: the same rows each time
    share = min(1.0, 0.95 * SAMPLE_ROWS / n_all)
    drawn = F.xxhash64("vec_id", F.lit(SEED))
    picked = rows.filter(F.pmod(drawn, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = picked.orderBy(drawn, "vec_id", "label", "q").limit(SAMPLE_ROWS).collect()

    def padded(qs) -> np.ndarray:
        out = np.zeros((len(qs), dim), np.int64)
        for i, q in enumerate(qs):
            out[i, : len(q)] = q
        return out

    s_x, s_ids = padded([r["q"] for r in sample]), np.array([r["vec_id"] for r in sample], np.int64)
    s_labels = np.array([r["label"] for r in sample], np.int64)
    count = int(np.clip(round(n_all**0.5), 1, CENTROIDS))
    centers = kmeans(s_x.astype(np.float64), count) if len(sample) else np.zeros((1, dim))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = padded(b["q"])
                own = nearest(x.astype(np.float64), centers).astype(np.int32)
                off = np.sqrt(((x - centers[own]) ** 2).sum(1))
                yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "list": own, "off": off, "q": [r.tobytes() for r in x]})

    index = materialize(rows.mapInPandas(assign, "vec_id long, label long, list int, off double, q binary"), "mining-lists")
    radii, sizes = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    for r in index.groupBy("list").agg(F.max("off").alias("r"), F.count("*").alias("n")).collect():  # one row a centroid
        radii[r["list"]], sizes[r["list"]] = r["r"], r["n"]
    lists = Lists(centers, radii, sizes)
    filled = np.flatnonzero(sizes)
    named = F.col("vec_id") % anchor_every == 0
    anchors = index.filter(named).select("vec_id", "label", "q").distinct()
    anchors = materialize(anchors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "q"), "mining-anchors")

    known = s_ids, s_labels, s_x
    # few rows that are much work: all cores take part
    spread = lambda df: df.repartition(spark.sparkContext.defaultParallelism, "key")
    best = _search(index, spread(anchors).mapInPandas(asks_of(lists, filled, known, positives, None), _SHAPE), lists, dim, positives, True)
    best = materialize(best.select("key", "rank", "vec_id", "score"), "mining-positives")
    scored = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))  # at most ``positives``
    wanted = anchors.join(scored, "key").select("key", "vec_id", "label", "q", F.col("found.score").alias("scores"))
    hard = _search(index, spread(wanted).mapInPandas(asks_of(lists, filled, known, negatives, (low, high)), _SHAPE), lists, dim, negatives, False)
    pairs = anchors.select("key", F.col("vec_id").alias("anchor_id")).join(best, "key").select(
        "key", (F.col("rank") - 1).alias("no"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return pairs.join(hard, ["key", "no"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
