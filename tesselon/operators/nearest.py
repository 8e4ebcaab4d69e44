"""RET-15: exact cosine top-k of a stated set of queries over all vectors, in blocks, with bounds that skip work.

Vectors of length one are packed into pieces of about a thousand with a centre c and the largest distance r of a member from it: a
query's cosine with any member is at most q.c + r. Queries are packed into blocks, each query with the smallest cosine that
can still count: the floor, or its k-th best among a bounded sample of the vectors, which are rows like any other. A block skips a
piece that no query of it can use. Within a piece the first ``HEAD`` components give partial products, and the norms of
what remains bound the rest: only rows that some query can still use are multiplied in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE_ROWS, BLOCK_QUERIES, SAMPLE_ROWS, HEAD = 1024, 256, 4096, 16
#: Room for rounding in a bound.
_ROOM = 1e-9


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def usable(v: str) -> F.Column:
    """Vectors that can have a cosine over 0: not null, not zero, all components finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(v).isNotNull() & F.forall(F.col(v), good) & F.exists(F.col(v), lambda x: x != 0)


def top_cosines(queries: DataFrame, vectors: DataFrame, limit: int, floor: float) -> DataFrame:
    """(query_id, chunk_id, cos): of each query the ``limit`` vectors with the highest cosine over ``floor``, ties by chunk_id.

    ``queries`` (query_id, v) and ``vectors`` (chunk_id, v) hold arrays of doubles of one length; see :func:`usable` for what takes part.
    """
    spark = vectors.sparkSession
    asked, rows = queries.filter(usable("v")), vectors.filter(usable("v"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": vectors.schema["chunk_id"].dataType.simpleString()}
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, cos double")
    # the same rows each time: a share under the bound by hash, then the bound in order of it
    drawn = F.xxhash64("chunk_id", F.lit(3))
    picked = rows.filter(F.pmod(drawn, F.lit(1_000_000)) < int(min(1.0, 0.95 * SAMPLE_ROWS / n) * 1_000_000) + 1)
    sample = [r["v"] for r in picked.orderBy(drawn, "chunk_id").limit(SAMPLE_ROWS).select("v").collect()]
    known = _units(pd.Series([np.array(v) for v in sample])) if sample else None

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), PIECE_ROWS):
                part = b.iloc[at : at + PIECE_ROWS]
                x = _units(part["v"])
                centre = x.mean(0)
                far = np.sqrt(((x - centre) ** 2).sum(1)).max()
                yield pd.DataFrame({"ids": [part["id"].tolist()], "x": [x.tobytes()], "c": [centre.tobytes()], "r": [far]})

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_QUERIES):
                part = b.iloc[at : at + BLOCK_QUERIES]
                q = _units(part["v"])
                least = np.full(len(q), floor)
                if known is not None and len(known) >= limit:
                    kth = np.partition(q @ known.T, -limit, axis=1)[:, -limit]
                    least = np.maximum(least, kth - _ROOM)
                yield pd.DataFrame({"q_ids": [part["id"].tolist()], "q": [q.tobytes()], "least": [least.tobytes()]})

    # vectors that lean the same way in their first components share pieces, so that pieces have smaller radii
    lean = sum((F.when(F.get("v", F.lit(i)) > 0, 1 << i).otherwise(0) for i in range(10)), F.lit(0))
    pieces = rows.select(F.col("chunk_id").alias("id"), "v").sortWithinPartitions(lean)
    pieces = pieces.mapInPandas(pack, f"ids array<{kinds['chunk_id']}>, x binary, c binary, r double")
    blocks = asked.select(F.col("query_id").alias("id"), "v").mapInPandas(block, f"q_ids array<{kinds['query_id']}>, q binary, least binary")
    blocks = blocks.withColumn("query_id", F.monotonically_increasing_id())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, x, c, r, q_ids, q, least in zip(b["ids"], b["x"], b["c"], b["r"], b["q_ids"], b["q"], b["least"], strict=True):
                least, centre = np.frombuffer(least), np.frombuffer(c)
                x, q = np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(q).reshape(len(q_ids), -1)
                able = np.flatnonzero(q @ centre + r + _ROOM >= least)
                if not len(able):
                    continue
                q, least, names = q[able], least[able], np.asarray(q_ids, object)[able]
                rest = lambda m: np.sqrt((m[:, HEAD:] ** 2).sum(1))
                bound = q[:, :HEAD] @ x[:, :HEAD].T + np.outer(rest(q), rest(x)) + _ROOM
                use = np.flatnonzero((bound >= least[:, None]).any(0))
                if not len(use):
                    continue
                cos, of = q @ x[use].T, np.asarray(ids, object)[use]
                out = []
                for name, row, low in zip(names, cos, least, strict=True):
                    good = np.flatnonzero((row > floor) & (row >= low))
                    if len(good) > limit:
                        kth = np.partition(row[good], -limit)[-limit]
                        good = good[row[good] >= kth - _ROOM]  # ties are settled over all pieces
                    out += [(name, of[i], row[i]) for i in good]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "chunk_id", "cos"])

    from tesselon.operators.retrieval import against_all

    met = against_all(blocks, pieces)
    found = met.select("ids", "x", "c", "r", "q_ids", "q", "least").mapInPandas(score, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, cos double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "chunk_id")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")
