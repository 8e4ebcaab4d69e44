"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook of K centroids (k-means on a
bounded sample); a vector's cell is its pair of centroids. A query sorts the centroids of each half by
distance and walks the occupied ones of the K x K pairs in order of summed distance with a heap, cell by cell, until the
cells hold ``visit`` of all indexed vectors. The entries of those cells are reranked by exact distance
in double precision on the original vectors.

Cells are dealt out in groups, cut into chunks of at most ``CHUNK_ROWS`` entries, so a cell that holds a
third of all vectors is many units of work. A task holds one unit's entries and reads the queries that visit it
batch by batch, so its memory does not grow with the number of queries. A unit returns its ten best a
query, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.session import materialize

CENTROIDS = 512
#: Bound of the sample that the codebooks are fitted on.
SAMPLE_ROWS = 8192
CHUNK_ROWS = 4096
#: Queries that walk their cells in one task.
PROBES_A_TASK = 32
SEED = 5


def usable(col: str) -> F.Column:
    """True for vectors that take part: neither null, empty nor zero, all components finite."""
    v = F.col(col)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centroids of the rows of x; with fewer distinct rows than k, those rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def cells_in_order(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Occupied cells (i * K2 + j) by rising d1[i] + d2[j] until they hold ``enough`` entries.

    The heap holds, for each centroid of the first half, the nearest of its occupied partners that is not visited yet, so empty
    pairs are never walked.
    """
    rows, cols = np.nonzero(counts)
    by = np.lexsort((d2[cols], rows))
    rows, cols = rows[by], cols[by]
    sums, held = (d1[rows] + d2[cols]).tolist(), counts[rows, cols].tolist()
    cells, ends = (rows * len(d2) + cols).tolist(), np.searchsorted(rows, rows, side="right").tolist()
    heap = [(sums[p], p) for p in np.unique(np.searchsorted(rows, rows)).tolist()]
    heapq.heapify(heap)
    out, have = [], 0
    while heap and have < enough:
        p = heap[0][1]
        out.append(cells[p])
        have += held[p]
        if p + 1 < ends[p]:
            heapq.heapreplace(heap, (sums[p + 1], p + 1))
        else:
            heapq.heappop(heap)
    return out


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, query_every: int = 100, visit: float = 0.25,
    centroids: int = CENTROIDS, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every`` its k nearest.

    score is the Euclidean distance in double precision on the original vectors; nearest first, ties
    to the smaller vec_id. The query's own row is no candidate. A query walks cells until
    they hold the share ``visit`` of all vectors, and ten vectors for each neighbour asked for.

    Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null id, take no part; vectors must be of one dimension (others than the most frequent one take no part);
    repeated vectors are candidates each; repeated ids are one candidate for each distinct vector; with
    fewer than k candidates all are returned; query rows that share an id but not the vector are one query, whose
    neighbours are the nearest to any of them; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("v"))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n_all = dims["dim"], dims["n"]
    half = (dim + 1) // 2
    rows = rows.filter(F.size("v") == dim)
    # below the bound, so that the limit hardly ever cuts and the same rows are drawn each time
    share = min(1.0, 0.95 * SAMPLE_ROWS / n_all)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    drawn = picked.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").select("v").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["v"] for r in drawn] or [[0.0] * dim])
    books = [kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids)]
    if not half < dim:
        books[1] = np.zeros((1, 0))
    k2 = len(books[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                yield b.assign(cell=(nearest(x[:, :half], books[0]) * k2 + nearest(x[:, half:], books[1])).astype(np.int32))

    index = materialize(rows.mapInPandas(assign, "vec_id long, v array<double>, cell int"), "ann-index")
    counts = np.zeros((len(books[0]), k2), np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most centroids squared
        counts[divmod(r["cell"], k2)] = r["n"]
    enough = max(10 * k, int(np.ceil(visit * n_all))) + 1
    # neighbouring cells share a unit up to CHUNK_ROWS entries, larger cells are cut into chunks; local numbers a unit's cells
    flat = counts.ravel()
    first, local = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
    chunks, used, unit, held = np.maximum(1, -(-flat // CHUNK_ROWS)).astype(np.int32), 0, 0, 0
    for c in np.flatnonzero(flat):
        if used and used + flat[c] > CHUNK_ROWS:
            unit, used, held = unit + 1, 0, 0
        first[c], local[c] = unit, held
        if flat[c] > CHUNK_ROWS:
            unit, used, held = unit + int(chunks[c]), 0, 0
        else:
            used, held = used + int(flat[c]), held + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = b["cell"].to_numpy()
            to = (first[cell] + b["salt"].to_numpy() % chunks[cell]).astype(np.int32)
            yield pd.DataFrame({"unit": to, "query": False, "vec_id": b["vec_id"], "v": b["v"], "cell": local[cell], "visits": b""})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, v in zip(b["vec_id"], b["v"], strict=True):
                d1 = ((books[0] - v[:half]) ** 2).sum(1)
                d2 = ((books[1] - v[half:]) ** 2).sum(1)
                cells = np.array(cells_in_order(d1, d2, counts, enough))
                out = []
                for u in np.unique(first[cells]):
                    mine = cells[first[cells] == u]
                    # a bit for each of the unit's cells; the chunks of a large cell are units of one cell
                    bits = np.zeros(int(local[mine].max()) + 1, np.uint8)
                    bits[local[mine]] = 1
                    out += [(w, True, q, v, 0, np.packbits(bits).tobytes()) for w in range(u, u + chunks[mine[0]])]
                yield pd.DataFrame(out, columns=["unit", "query", "vec_id", "v", "cell", "visits"])

    shape = "unit int, query boolean, vec_id long, v array<double>, cell int, visits binary"
    entries = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))).mapInPandas(place, shape)
    asked = index.filter(F.col("vec_id") % query_every == 0).select("vec_id", "v")
    queries = asked.repartition(max(1, n_all // (query_every * PROBES_A_TASK)), "vec_id").mapInPandas(probe, shape)

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, x, ids, cell = None, [], None, None, None
        for b in batches:
            unit, asks, out = b["unit"].to_numpy(), b["query"].to_numpy(bool), []
            key = unit.astype(np.int64) * 2 + asks
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                if unit[s] != now:
                    now, parts = unit[s], []
                if not asks[s]:  # a unit's entries come before its queries
                    parts.append(b.iloc[s:e])
                    x = None
                    continue
                if not parts:
                    continue
                if x is None:
                    whole = pd.concat(parts)
                    x, ids, cell = np.stack(whole["v"].to_numpy()), whole["vec_id"].to_numpy(), whole["cell"].to_numpy()
                for q, v, visits in zip(b["vec_id"].to_numpy()[s:e], b["v"].to_numpy()[s:e], b["visits"].to_numpy()[s:e], strict=True):
                    bits = np.unpackbits(np.frombuffer(visits, np.uint8)).astype(bool)
                    rows = np.flatnonzero((cell < len(bits)) & bits[np.minimum(cell, len(bits) - 1)] & (ids != q))
                    d = np.sqrt(((x[rows] - v) ** 2).sum(1))
                    if len(d) > k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        rows, d = rows[near], d[near]
                    best = np.lexsort((ids[rows], d))[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[rows[best]], "score": d[best]}))
            if out:
                yield pd.concat(out)

    dealt = entries.unionByName(queries).repartition("unit").sortWithinPartitions("unit", "query")
    found = dealt.mapInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
