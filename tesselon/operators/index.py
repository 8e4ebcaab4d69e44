"""Incremental index and table maintenance.

Tables are DataFrames keyed by ids; a change is a join that says insert, update, keep or delete, and the
new state is a projection of it. Chunks are rebuilt for changed sources only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSIONS = ("chunker_version", "index_version")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (DML-07's dedupe, WIN-07, JOIN-06's last row wins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ledger_plan(sources: DataFrame, ledger: DataFrame, versions: dict[str, int]) -> DataFrame:
    """JOIN-03, JOIN-04, SET-05, DML-11: (source_id, action): reuse, rebuild, new or delete.

    A ledger row is valid if the content hash and all versions agree and its chunk count is known.
    """
    s = sources.select("source_id", F.col("content_hash").alias("s_hash"))
    led = ledger.withColumnRenamed("content_hash", "l_hash")
    both = s.join(led, "source_id", "full")
    valid = F.col("s_hash").eqNullSafe(F.col("l_hash")) & (F.coalesce("chunk_count", F.lit(-1)) >= 0)
    for v, n in versions.items():
        valid = valid & (F.coalesce(v, F.lit(-1)) == n)
    action = F.when(F.col("s_hash").isNull(), "delete").when(F.col("l_hash").isNull(), "new").when(valid, "reuse").otherwise("rebuild")
    return both.select("source_id", action.alias("action"))


def incremental_chunks(sources: DataFrame, ledger: DataFrame, old_chunks: DataFrame, build, versions: dict[str, int]) -> DataFrame:
    """DML-11: kept chunks of valid sources and fresh ones of the others; deleted sources leave none.

    ``build`` makes chunks (with source_id) of a sources table; it sees changed sources only.
    """
    plan = ledger_plan(sources, ledger, versions)
    kept = old_chunks.join(plan.filter("action = 'reuse'").select("source_id"), "source_id", "left_semi")
    changed = sources.join(plan.filter("action in ('new', 'rebuild')").select("source_id"), "source_id", "left_semi")
    return kept.unionByName(build(changed).select(*kept.columns))


def bundle_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """JOIN-14, DML-02: (key, change): insert, update, delete or same."""
    o, n = old.select(key, F.col(content).alias("o")), new.select(key, F.col(content).alias("n"))
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") == F.col("n"), "same").otherwise("update")
    return o.join(n, key, "full").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """JOIN-15, DML-01, DML-07: rows of ``new`` replace those of the same keys; the rest of ``old`` stays."""
    incoming = latest(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML-08: rows of ``new`` whose keys are not there yet are added, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DML-05, DML-06, DML-10, FLT-09: rows whose keys are listed go."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def keep_keys(table: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """DML-05: orphan collection: rows whose keys are not listed go."""
    return table.join(keep.select(*keys).distinct(), keys, "left_semi")


def add_counts(table: DataFrame, deltas: DataFrame, keys: list[str], counter: str, status: Column | None = None) -> DataFrame:
    """DML-09: a counter raised by the sum of the deltas, the status set where there are any."""
    sums = deltas.groupBy(*keys).agg(F.sum(counter).alias("__d"))
    out = table.join(sums, keys, "left").withColumn(counter, F.col(counter) + F.coalesce("__d", F.lit(0)))
    if status is not None:
        out = out.withColumn("status", F.when(F.col("__d").isNotNull(), status).otherwise(F.col("status")))
    return out.drop("__d").select(*table.columns)


def commit_staged(rows: DataFrame) -> DataFrame:
    """DML-03: a staged version that is ready is promoted, one that failed is dropped, others stay as they are."""
    ready = F.col("staged_readiness") == "ready"
    return rows.withColumns({
        "content_hash": F.when(ready, F.col("staged_hash")).otherwise(F.col("content_hash")),
        "readiness": F.when(ready, F.lit("ready")).otherwise(F.col("readiness")),
        "staged_hash": F.when(F.col("staged_readiness").isin("ready", "failed"), F.lit(None).cast("string")).otherwise(F.col("staged_hash")),
        "staged_readiness": F.when(F.col("staged_readiness").isin("ready", "failed"), F.lit(None).cast("string")).otherwise(F.col("staged_readiness")),
    })


def space_status(members: DataFrame) -> DataFrame:
    """SRC-38, AGG-39, DML-12: per space: error if any member has one, else indexing if any is, else ready; sources summed."""
    rank = F.when(F.col("status") == "error", 2).when(F.col("status") == "indexing", 1).otherwise(0)
    return members.groupBy("space_id").agg(F.max(rank).alias("r"), F.sum("source_count").alias("source_count")).select(
        "space_id", F.element_at(F.array(F.lit("ready"), F.lit("indexing"), F.lit("error")), F.col("r") + 1).alias("status"), "source_count"
    )


def expand_members(spaces: DataFrame) -> DataFrame:
    """JOIN-17: (space_id, context_id) of each space's distinct members, the primary one included."""
    return spaces.select("space_id", F.explode(F.array_distinct(F.array_compact(F.concat("context_ids", F.array("primary_id"))))).alias("context_id"))


def stale_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """RET-28, RET-29: chunks without a vector for their content hash."""
    return chunks.join(vectors.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def upload_batches(pages: DataFrame, group: str, order: list[str], size: int = 50) -> DataFrame:
    """SRC-28: batch number of every row, ``size`` rows a batch in order."""
    w = Window.partitionBy(group).orderBy(*order)
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def batch_faults(rows: DataFrame, max_bytes: int = 3_000_000, max_text: int = 100_000) -> DataFrame:
    """SRC-29: (batch, faults) of batches that break a rule: bytes, empty ids, oversize texts, repeated pages."""
    per = rows.groupBy("batch").agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.coalesce("id", F.lit("")) == "").alias("blank"),
        F.count_if(F.length("text") > max_text).alias("long"), (F.count("*") - F.count_distinct("id")).alias("again"),
    )
    faults = F.array_compact(F.array(
        F.when(F.col("bytes") > max_bytes, "bytes"), F.when(F.col("blank") > 0, "id"), F.when(F.col("long") > 0, "text"),
        F.when(F.col("again") > 0, "repeat"),
    ))
    return per.select("batch", faults.alias("faults")).filter(F.size("faults") > 0)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """SET-08: whether two tables hold the same rows the same number of times."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SET-10: (n, digest) of a table, whatever the order of its rows."""
    h = F.xxhash64(*keys)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest"))


def sources_by_path(files: DataFrame, sources: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """JOIN-02, JOIN-09: ``files`` with the source_id that holds each path, of the same ``scope`` columns if given; files without one go."""
    keys = [*(scope or []), "path"]
    return files.join(sources.select(*keys, "source_id").dropDuplicates(keys), keys)


def ready_chunks(chunks: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-01: chunks whose source, by all of ``keys`` (tenant, space, source, version), is ready."""
    ready = sources.filter(F.col("status") == "ready").select(*keys).distinct()
    return chunks.join(ready, keys, "left_semi")


def hit_pages(pages: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-12, SRC-37: the pages that any hit needs, each once; only these are read in full."""
    return pages.join(hits.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)


def point_read(table: DataFrame, **key) -> DataFrame:
    """SRC-36: the rows of one key, as filters that reach the scan (null is a key of its own)."""
    out = table
    for c, v in key.items():
        out = out.filter(F.col(c).isNull() if v is None else F.col(c) == v)
    return out


def lookup(ids: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """JOIN-08: the newest row (by ord) of ``history`` for each wanted id."""
    return latest(history.join(ids.select(key).distinct(), key, "left_semi"), [key], [F.desc("ord")])


def current_evidence(evidence: DataFrame, texts: DataFrame, documents: DataFrame, commits: DataFrame) -> DataFrame:
    """JOIN-10: ``evidence`` with ``current``: whether what it cites is still there as it was.

    Text evidence needs a source of its id and hash, document evidence also one of the same normalised hash,
    commit evidence a commit of its sha; evidence of any other kind is never current.
    """
    on = lambda df, *cols: df.select(*[F.col(c).alias(f"__{c}") for c in cols]).distinct()
    t, d, c = on(texts, "source_id", "content_hash"), on(documents, "source_id", "content_hash", "normalized_hash"), on(commits, "sha")
    same = lambda *cols: [F.col(x) == F.col(f"__{x}") for x in cols]
    kinds = {"text": (t, ["source_id", "content_hash"]), "document": (d, ["source_id", "content_hash", "normalized_hash"]), "commit": (c, ["sha"])}
    out = None
    for kind, (df, cols) in kinds.items():
        rows = evidence.filter(F.col("kind") == kind).join(df, same(*cols), "left")
        rows = rows.withColumn("current", F.col(f"__{cols[0]}").isNotNull()).select(*evidence.columns, "current")
        out = rows if out is None else out.unionByName(rows)
    other = evidence.filter(F.col("kind").isNull() | ~F.col("kind").isin(list(kinds))).withColumn("current", F.lit(False))
    return out.unionByName(other)


def apply_parses(sources: DataFrame, parses: DataFrame, fields: list[str]) -> DataFrame:
    """DML-04: ``sources`` with what a finished parse of the same id and content hash says; nulls of a parse change nothing.

    A parse of an older content, or of a source that is gone, is dropped.
    """
    new = latest(parses, ["source_id", "content_hash"], [F.desc("ord")]).select(
        F.col("source_id").alias("__s"), F.col("content_hash").alias("__h"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = sources.join(new, (F.col("source_id") == F.col("__s")) & (F.col("content_hash") == F.col("__h")), "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(*sources.columns)


def ordered(rows: DataFrame, by: list, of: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """SRT-02..07: ``rows`` with their place in an order, within ``of`` if given, the first ``limit`` if given.

    An order is a column, so it outlives a shuffle and a write; ``by`` ends in a key, so it is total.
    """
    w = Window.partitionBy(*(of or [])).orderBy(*by)
    out = rows.withColumn("place", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("place") <= limit)


def smallest_support(spans: DataFrame, claim: str = "claim_id") -> DataFrame:
    """SRT-11: of each claim's supporting spans the shortest, ties to the first by source and start."""
    size = F.col("end") - F.col("start")
    return latest(spans.filter("supports"), [claim], [size, "source_id", "start"])


def usable_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """FLT-10: document chunks that can be cited: with text, on a known page, inside its text, and equal to what stands there."""
    p = pages.select(F.col("source_id").alias("__s"), F.col("page").alias("__p"), F.col("text").alias("__t"))
    shaped = chunks.filter((F.trim("text") != "") & (F.col("page") >= 1) & (F.col("start") >= 0) & (F.col("end") > F.col("start")))
    found = shaped.join(p, (F.col("source_id") == F.col("__s")) & (F.col("page") == F.col("__p")))
    here = F.substring(F.col("__t"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return found.filter((F.col("end") <= F.length("__t")) & here).select(*chunks.columns)


def exclusive_ranges(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """LAY-19: ranges of a page that no item of another owner meets.

    Ranges and items meet on (page, tile), tiles of the mean length of a range, so nearby ones only are compared.
    """
    mean = ranges.agg(F.avg(F.col("end") - F.col("start")).alias("m")).first()["m"]
    tile = max(1, int(mean or 1))
    tiles = lambda: F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("tile")
    r = ranges.filter("end > start").select("page", F.col("owner").alias("r_owner"), F.col("start").alias("r0"), F.col("end").alias("r1"), "start", "end").select("*", tiles()).drop("start", "end")
    i = items.filter("end > start").select("page", "owner", "start", "end", tiles())
    met = r.join(i, ["page", "tile"]).filter((F.col("owner") != F.col("r_owner")) & (F.col("start") < F.col("r1")) & (F.col("end") > F.col("r0")))
    met = met.select("page", F.col("r_owner").alias("owner"), F.col("r0").alias("start"), F.col("r1").alias("end")).distinct()
    return ranges.join(met, ["page", "owner", "start", "end"], "left_anti")
