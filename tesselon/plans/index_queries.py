"""Queries over what is written and read again: an index kept up batch by batch, JSON logs, rings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesselon.operators import segments
from tesselon.plans import queries as base
from tesselon.plans.registry import query, table
from tesselon.session import shared_dir
from tesselon.sources import readers

# what the documents say after three batches, and the words of that; sources of a number divisible by 7 are deleted in the last
_SQL_FINAL = f"""d AS (SELECT doc_id, 'docs/' || doc_id AS path, CASE WHEN doc_id % 13 = 1 THEN 'replacedText ' || doc_id WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' revised_edition' ELSE coalesce(text, '') END AS text
        FROM documents WHERE doc_id % 7 <> 0),
    bw AS (SELECT path AS chunk_id, unnest({base._words_sql('text')}) AS w, 1 AS b, 0 AS p FROM d UNION ALL SELECT path, unnest({base._words_sql('path')}), 0, 1 FROM d),
    wc AS (SELECT chunk_id, w, sum(b)::BIGINT AS b, sum(p)::BIGINT AS p FROM bw GROUP BY ALL),
    posts AS (SELECT chunk_id, term, sum(b)::BIGINT AS body, sum(p)::BIGINT AS path_tf FROM (SELECT chunk_id, w AS term, b, p FROM wc UNION ALL
        SELECT chunk_id, '~' || {base._stem_sql('w')}, b, p FROM wc WHERE {base._stem_sql('w')} <> w) GROUP BY ALL)"""


def _batches(spark, sf_dir):
    """(upserts, deletes) three times: two thirds of the documents; the rest, revisions and rows sent again; replacements and deletions."""
    d = base.spread_small(table(spark, sf_dir, "documents")).select("doc_id", F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    revised = d.withColumn("text", F.when(i % 5 == 0, F.concat("text", F.lit(" revised_edition"))).otherwise(F.col("text")))
    replaced = d.filter(i % 13 == 1).withColumn("text", F.concat(F.lit("replacedText "), i.cast("string")))
    hashed = lambda x: x.withColumn("content_hash", F.sha2("text", 256))
    return [(hashed(d.filter(i % 3 != 2)), None), (hashed(revised.filter((i % 3 == 2) | (i % 5 == 0) | (i % 11 == 1))), None), (hashed(replaced.filter(i % 7 != 0)), d.filter(i % 7 == 0).select("source_id"))]


def _index(spark, sf_dir):
    build = lambda files: files.select("source_id", F.col("path").alias("chunk_id"), "path", "text")
    index = segments.PostingIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}", build, fanout=2).create()
    for upserts, deletes in _batches(spark, sf_dir):
        index.apply(upserts, deletes)
        index.merge()
    return index


@query(f"""WITH {_SQL_FINAL} SELECT term, count(*) AS df, count(*) AS rows, sum(body)::BIGINT AS body, sum(path_tf)::BIGINT AS path_tf FROM posts GROUP BY term""")
def posting_segments(spark, sf_dir):
    """DML-11 on postings: three batches of inserts, updates and deletes with merges equal an index built at once; df by the segments' differences."""
    index = _index(spark, sf_dir)
    rows = index.postings().groupBy("term").agg(F.count("*").alias("rows"), F.sum("body").alias("body"), F.sum("path_tf").alias("path_tf"))
    return index.frequencies().join(rows, "term", "full").select("term", "df", "rows", "body", "path_tf")


@query("""SELECT event_id AS at, event_type AS tier, value AS total_ms FROM events WHERE event_id % 10 NOT IN (3, 5)
    UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 10 = 4""")
def log_records(spark, sf_dir):
    """SRC-22, SRC-23, SCL-17: events written as JSON lines, some broken, some of a kind that is not kept, some two records in one document, and read back."""
    i = F.col("event_id")
    record = lambda kind: F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("event_type").alias("tier"), i.alias("timestamp"), F.struct(F.col("value").alias("totalMs")).alias("latency")))
    both = F.concat(F.lit('{"records":['), record("answer"), F.lit(","), record("answer"), F.lit("]}"))
    line = F.when(i % 10 == 3, F.lit('{"kind": "answer", broken')).when(i % 10 == 5, record("other")).when(i % 10 == 4, both).otherwise(record("answer"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return readers.read_log(spark.read.text(path)).select(F.col("timestamp").alias("at"), "tier", F.col("latency.totalMs").alias("total_ms"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 500")
def ring_rows(spark, sf_dir):
    """SRC-24: rows appended in two batches to a ring whose reader sees the last 500."""
    path, rows = f"{shared_dir(spark)}/ring-{uuid.uuid4().hex[:12]}", table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (0, 1):
        readers.write_ring(rows.filter(F.col("event_id") % 2 == part), path, "event_id")
    return readers.read_ring(spark, path, "event_id", 500)
