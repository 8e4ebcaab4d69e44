"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) joined back to the edges, so a hub with very many
neighbours is a skewed join side that adaptive execution splits. Edges are written to the shared
folder after every round; nothing is collected but one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has long columns a, b in any direction; self-loops, repeats and null ends are ignored.
    """
    clean = edges.filter("a is not null and b is not null and a != b")
    cur = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # a forest of stars on their least nodes: no node has two parents and no parent has one
        flat = (
            cur.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
            and cur.select("a").join(cur.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        )
        if flat:
            break
        cur = materialize(_small_star(_large_star(cur)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
