"""An inverted index that grows by segments (DML-11 on postings).

A batch of sources is compared with what is indexed by content hash. New and changed ones become a segment of their own; what they
replace, and what is deleted, is named in tombstones (source, segment it lives in). Nothing written is ever rewritten, so a
batch costs what has changed, not what is there. Each segment also keeps by how much it changes the number of chunks of
each term, so document frequencies are a sum over segments. Segments of one size class are merged once there are ``fanout``
of them: then tombstones are applied to the rows themselves.

All of it is Parquet in one folder. A version is one small table of segment numbers and sizes, written last: readers see whole
batches, and a job that fails leaves the version before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators.retrieval import postings
from tesselon.session import materialize

_VERSION = "v int, no int, rows long"


class PostingIndex:
    """Postings, sources and document frequencies of the sources that are live.

    ``build`` makes chunks (source_id, chunk_id, and what ``make`` reads) of sources; ``make`` makes postings (chunk_id, term, ...) of
    chunks. Chunk ids are unique among the live ones. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame] = postings, fanout: int = 4):
        self.spark, self.path, self.build, self.make, self.fanout = spark, path.rstrip("/"), build, make, fanout

    def create(self) -> PostingIndex:
        """Write the version without segments; it is an error if there is an index already."""
        self._commit(0, [])
        return self

    def _commit(self, version: int, segments: list[tuple[int, int]]) -> None:
        rows = self.spark.createDataFrame([(no, n) for no, n in segments], "no int, rows long")
        rows.coalesce(1).write.parquet(f"{self.path}/versions/v={version}")

    def _version(self) -> tuple[int, list[tuple[int, int]]]:
        """The newest version and its segments (no, rows); there are about fanout for each size class."""
        rows = self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions")
        newest = max([int(r["v"]) for r in rows.select("v").distinct().collect()] or [0])
        return newest, sorted((r["no"], r["rows"]) for r in rows.filter(F.col("v") == newest).collect())

    def _read(self, kind: str, segments: list[int]) -> DataFrame | None:
        """Rows of that kind of the segments, with the number of each."""
        parts = [self.spark.read.parquet(f"{self.path}/seg-{no}/{kind}").withColumn("no", F.lit(no)) for no in segments]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _live(self, kind: str, segments: list[int], among: list[int] | None = None) -> DataFrame | None:
        """Rows of ``among`` (all segments if not given) without those that a tombstone of any segment names."""
        rows, gone = self._read(kind, segments if among is None else among), self._read("gone", segments)
        if rows is None:
            return None
        return rows.join(gone.select("source_id", F.col("lives_in").alias("no")).distinct(), ["source_id", "no"], "left_anti")

    def sources(self) -> DataFrame | None:
        """(source_id, content_hash, chunks, no) of the live sources; None if nothing was indexed yet."""
        return self._live("sources", [no for no, _ in self._version()[1]])

    def postings(self) -> DataFrame | None:
        """What ``make`` gives for the chunks of all live sources, with source_id."""
        rows = self._live("posts", [no for no, _ in self._version()[1]])
        return None if rows is None else rows.drop("no")

    def frequencies(self) -> DataFrame | None:
        """(term, df): chunks that hold the term, by the segments' differences alone."""
        rows = self._read("deltas", [no for no, _ in self._version()[1]])
        return None if rows is None else rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")

    def _write(self, no: int, posts: DataFrame, sources: DataFrame, gone: DataFrame, lost: DataFrame | None) -> int:
        """Write a segment; ``lost`` holds the postings that its tombstones end. Returns its number of postings."""
        at = f"{self.path}/seg-{no}"
        posts.write.parquet(f"{at}/posts")
        sources.write.parquet(f"{at}/sources")
        gone.write.parquet(f"{at}/gone")
        posts = self.spark.read.parquet(f"{at}/posts")
        change = posts.select("term", F.lit(1).alias("d"))
        if lost is not None:
            change = change.unionByName(lost.select("term", F.lit(-1).alias("d")))
        change.groupBy("term").agg(F.sum("d").alias("df")).filter("df <> 0").write.parquet(f"{at}/deltas")
        return posts.count()

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None) -> dict[str, int]:
        """Index a batch: ``upserts`` (source_id, content_hash, ...) are new or replace what they name, ``deletes`` (source_id) go.

        Returns how many sources were written, replaced or deleted, and kept as they were. Of rows that share a source_id the one
        with the largest hash counts; a source in both is deleted and written anew if its hash differs, kept if it does not; null ids are left out.
        """
        version, segments = self._version()
        nos = [no for no, _ in segments]
        batch = upserts.filter(F.col("source_id").isNotNull())
        best = batch.groupBy("source_id").agg(F.max("content_hash").alias("content_hash"))
        batch = batch.join(best, ["source_id", "content_hash"]).dropDuplicates(["source_id"])
        live = self._live("sources", nos)
        if live is None:
            changed, gone = batch, self.spark.createDataFrame([], batch.select("source_id").schema).withColumn("lives_in", F.lit(0))
        else:
            live = materialize(live.select("source_id", "content_hash", "no"), "index-live")
            same = live.select("source_id", "content_hash")
            changed = batch.join(same, ["source_id", "content_hash"], "left_anti")
            ends = changed.select("source_id")
            if deletes is not None:
                ends = ends.unionByName(deletes.select("source_id").join(batch.join(same, ["source_id", "content_hash"]).select("source_id"), "source_id", "left_anti"))
            gone = live.join(ends.distinct(), "source_id", "left_semi").select("source_id", F.col("no").alias("lives_in"))
        changed, gone = materialize(changed, "index-changed"), materialize(gone, "index-gone")
        counts = {"written": changed.count(), "ended": gone.count()}
        counts["kept"] = batch.count() - counts["written"]
        if not counts["written"] and not counts["ended"]:
            return counts
        chunks = materialize(self.build(changed), "index-chunks")
        posts = self.make(chunks).join(chunks.select("chunk_id", "source_id"), "chunk_id")
        sources = changed.select("source_id", "content_hash").join(chunks.groupBy("source_id").agg(F.count("*").alias("chunks")), "source_id", "left")
        lost = self._read("posts", nos)
        if lost is not None:
            lost = lost.join(gone.select("source_id", F.col("lives_in").alias("no")), ["source_id", "no"], "left_semi")
        no = max(nos, default=0) + 1
        rows = self._write(no, posts, sources.fillna(0, ["chunks"]), gone, lost)
        self._commit(version + 1, [*segments, (no, rows)])
        return counts

    def merge(self) -> list[int]:
        """Merge the smallest size class that has ``fanout`` segments; the numbers merged, none if no class is full.

        A class holds the sizes between two powers of ``fanout``. Rows under tombstones are dropped; tombstones for segments that
        stay are kept, and so are the sums of the differences.
        """
        version, segments = self._version()
        classes: dict[int, list[int]] = {}
        for no, rows in segments:
            classes.setdefault(int(math.log(max(1, rows), self.fanout)), []).append(no)
        full = [nos for _, nos in sorted(classes.items()) if len(nos) >= self.fanout]
        if not full:
            return []
        merged, all_ = full[0], [no for no, _ in segments]
        no = max(all_) + 1
        at = f"{self.path}/seg-{no}"
        posts, sources = (self._live(kind, all_, merged).drop("no") for kind in ("posts", "sources"))
        posts.write.parquet(f"{at}/posts")
        sources.write.parquet(f"{at}/sources")
        self._read("gone", merged).filter(~F.col("lives_in").isin(merged)).drop("no").write.parquet(f"{at}/gone")
        self._read("deltas", merged).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").write.parquet(f"{at}/deltas")
        rows = self.spark.read.parquet(f"{at}/posts").count()
        self._commit(version + 1, [*((n, r) for n, r in segments if n not in merged), (no, rows)])
        return merged
