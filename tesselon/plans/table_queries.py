"""Queries over keyed tables: lookups, currency of evidence, orders, maintenance, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import contract, index
from tesselon.plans.registry import query, table


def _str(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_suppkey % 3 = o_custkey % 3""")
def ready_chunks(spark, sf_dir):
    """JOIN-01: lines as chunks, orders as sources; status F is ready, and the tenant must agree."""
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("tenant"), F.col("l_orderkey").alias("source_id"), F.lit("s").alias("space_id"), F.lit("h").alias("content_hash"))
    sources = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("tenant"), F.col("o_orderkey").alias("source_id"), F.lit("s").alias("space_id"), F.lit("h").alias("content_hash"),
                                                    F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"))
    return index.ready_chunks(chunks, sources, ["tenant", "space_id", "source_id", "content_hash"]).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey AS file_id, ps.s_suppkey AS source_id FROM part JOIN (SELECT min(s_suppkey) AS s_suppkey, s_suppkey % 40 AS k, s_nationkey % 3 AS g FROM supplier GROUP BY 2, 3) ps ON ps.k = p_partkey % 40 AND ps.g = p_size % 3""")
def sources_by_path(spark, sf_dir):
    """JOIN-02, JOIN-09."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_size") % 3).alias("pack_id"), _str("f", F.col("p_partkey") % 40).alias("path"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("pack_id"), _str("f", F.col("s_suppkey") % 40).alias("path"))
    s = s.groupBy("pack_id", "path").agg(F.min("s_suppkey").alias("source_id"))
    return index.sources_by_path(files, s, ["pack_id"]).select("file_id", "source_id")


@query("""SELECT page_id % 50 AS source_id, min(page_id) AS page FROM pages WHERE page_id % 50 IN (SELECT doc_id % 50 FROM documents WHERE doc_id % 9 = 0) AND page_id % 50 < 20 GROUP BY 1""")
def hit_pages(spark, sf_dir):
    """JOIN-12, SRC-37: first pages of the sources that are hit."""
    pages = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 50).alias("source_id")).agg(F.min("page_id").alias("page"))
    hits = table(spark, sf_dir, "documents").filter("doc_id % 9 = 0").select((F.col("doc_id") % 50).alias("source_id"))
    return index.hit_pages(pages.filter("source_id < 20"), hits, ["source_id"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7""")
def point_read(spark, sf_dir):
    """SRC-36."""
    return index.point_read(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), o_custkey=7).select("o_orderkey", "o_totalprice")


@query("""SELECT user_id AS id, event_id AS ord, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def history_lookup(spark, sf_dir):
    """JOIN-08."""
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), "event_type")
    return index.lookup(table(spark, sf_dir, "customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("id")), history)


@query("""WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'document' WHEN 2 THEN 'commit' ELSE 'other' END AS kind, o_custkey AS s, o_custkey % 4 AS h, o_custkey % 6 AS n FROM orders)
    SELECT id, CASE kind WHEN 'text' THEN coalesce(c_nationkey % 4 = h AND c_custkey % 3 = 0, false) WHEN 'document' THEN coalesce(c_nationkey % 4 = h AND c_nationkey % 6 = n AND c_custkey % 3 = 1, false)
        WHEN 'commit' THEN coalesce(c_acctbal > 0, false) ELSE false END AS current FROM e LEFT JOIN customer ON c_custkey = s""")
def evidence_currency(spark, sf_dir):
    """JOIN-10."""
    i, s = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(i % 4 == 0, "text").when(i % 4 == 1, "document").when(i % 4 == 2, "commit").otherwise("other")
    e = table(spark, sf_dir, "orders").select(i.alias("id"), kind.alias("kind"), s.alias("source_id"), (s % 4).alias("content_hash"), (s % 6).alias("normalized_hash"), _str("c", s).alias("sha"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_nationkey") % 4).alias("content_hash"), (F.col("c_nationkey") % 6).alias("normalized_hash"), "c_acctbal")
    commits = c.filter("c_acctbal > 0").select(_str("c", F.col("source_id")).alias("sha"))
    return index.current_evidence(e, c.filter("source_id % 3 = 0"), c.filter("source_id % 3 = 1"), commits).select("id", "current")


@query("""SELECT c_custkey AS source_id, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 3 = 1 THEN 'parsed' ELSE 'waiting' END AS readiness,
    CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 3 = 1 AND c_custkey % 5 <> 0 THEN c_custkey * 10 ELSE -1 END AS page_count FROM customer""")
def applied_parses(spark, sf_dir):
    """DML-04: parses of the content hash 1 alone, the newest one; a null page count changes nothing."""
    c = table(spark, sf_dir, "customer")
    sources = c.select(F.col("c_custkey").alias("source_id"), (F.col("c_nationkey") % 3).alias("content_hash"), F.lit("waiting").alias("readiness"), F.lit(-1).cast("long").alias("page_count"))
    even = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_id"), F.lit(1).cast("long").alias("content_hash"), F.lit("parsed").alias("readiness"),
                                                 F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") * 10).alias("page_count"), F.lit(2).alias("ord"))
    old = even.withColumns({"readiness": F.lit("old"), "page_count": F.lit(0).cast("long"), "ord": F.lit(1)})
    return index.apply_parses(sources, even.unionByName(old), ["readiness", "page_count"]).select("source_id", "readiness", "page_count")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_linenumber)::INT AS place FROM lineitem""")
def chunk_order(spark, sf_dir):
    """SRT-02, SRT-03: chunks of a file by offset (page), line, id."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")  # noqa: E741
    return index.ordered(l, ["l_shipdate", "l_quantity", "l_linenumber"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 40""")
def listing_order(spark, sf_dir):
    """SRT-04, SRT-05, SRT-07: newest first, then by name, the first forty of each status."""
    return index.ordered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [F.desc("o_orderdate"), "o_orderkey"], ["o_orderstatus"], 40).select("o_orderkey", "place")


@query("""SELECT l_orderkey AS claim_id, l_suppkey AS source_id, l_linenumber AS start FROM lineitem WHERE l_discount > 0.03 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_suppkey, l_linenumber) = 1""")
def smallest_support(spark, sf_dir):
    """SRT-11."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).alias("end"), (F.col("l_discount") > 0.03).alias("supports"))  # noqa: E741
    return index.smallest_support(l).select("claim_id", "source_id", "start")


@query("""WITH t AS (SELECT page_id, coalesce(html, '') AS t FROM pages), c AS (SELECT page_id, page_id % 3 AS v, CASE page_id % 3 WHEN 0 THEN substr(t, 6, 20) WHEN 1 THEN substr(t, 7, 20) ELSE '  ' END AS text, t FROM t)
    SELECT page_id AS chunk_id FROM c WHERE trim(text) <> '' AND length(t) >= 25 AND substr(t, 6, 20) = text""")
def usable_chunks(spark, sf_dir):
    """FLT-10: chunks that claim the span [5, 25) of page 1; some hold another text, some none."""
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.lit(1).alias("page"), F.coalesce("html", F.lit("")).alias("text"))
    v, text = F.col("source_id") % 3, F.col("text")
    said = F.when(v == 0, F.substring(text, 6, 20)).when(v == 1, F.substring(text, 7, 20)).otherwise("  ")
    chunks = t.select(F.col("source_id").alias("chunk_id"), "source_id", F.lit(1).alias("page"), F.lit(5).alias("start"), F.lit(25).alias("end"), said.alias("text"))
    return index.usable_chunks(chunks, t).select("chunk_id")


_RANGES = """r AS (SELECT l_orderkey % 40 AS page, l_suppkey AS owner, min(l_partkey) AS "start", min(l_partkey) + 3 AS "end" FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_RANGES} SELECT page, owner, "start", "end" FROM r WHERE NOT EXISTS (SELECT 1 FROM r i WHERE i.page = r.page AND i.owner <> r.owner AND i."start" < r."end" AND i."end" > r."start")""")
def exclusive_ranges(spark, sf_dir):
    """LAY-19."""
    r = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("page"), F.col("l_suppkey").alias("owner")).agg(F.min("l_partkey").alias("start"))
    r = r.withColumn("end", F.col("start") + 3)
    return index.exclusive_ranges(r, r)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS content_hash, CASE WHEN c_custkey % 4 = 0 THEN 'ready' ELSE 'stale' END AS readiness,
    CASE WHEN c_custkey % 4 = 2 THEN 'new' END AS staged_hash, CASE WHEN c_custkey % 4 = 2 THEN 'parsing' END AS staged_readiness FROM customer""")
def staged_commit(spark, sf_dir):
    """DML-03: of four, one staged version is ready, one failed, one is being parsed, one isn't there."""
    i = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("old").alias("content_hash"), F.lit("stale").alias("readiness"), F.when(i != 3, "new").alias("staged_hash"),
                                                   F.when(i == 0, "ready").when(i == 1, "failed").when(i == 2, "parsing").alias("staged_readiness"))
    return index.commit_staged(rows)


@query("""SELECT c_custkey, c_acctbal::BIGINT AS n FROM customer UNION ALL SELECT o_custkey + 1000000000, count(*) FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1""")
def insert_missing(spark, sf_dir):
    """DML-08: rows whose key is there already are left alone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.bround(F.col("c_acctbal").cast("double")).cast("long").alias("n"))
    o = table(spark, sf_dir, "orders").filter("o_custkey % 5 = 0").groupBy("o_custkey").agg(F.count("*").alias("n"))
    new = o.select((F.col("o_custkey") + 1_000_000_000).alias("c_custkey"), "n").unionByName(o.select(F.col("o_custkey").alias("c_custkey"), "n"))
    return index.insert_missing(c, new, ["c_custkey"])


@query("""SELECT c_custkey, coalesce(n, 0) + 5 AS used, CASE WHEN n IS NOT NULL THEN 'busy' ELSE 'idle' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def raised_counters(spark, sf_dir):
    """DML-09."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(5).cast("long").alias("used"), F.lit("idle").alias("status"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).cast("long").alias("used"))
    return index.add_counts(c, o, ["c_custkey"], "used", F.lit("busy"))


@query("""SELECT c_custkey, greatest(coalesce(nullif(c_nationkey, 3), 0), 3) AS schema_version, CASE WHEN coalesce(nullif(c_nationkey, 3), 0) < 3 AND c_custkey % 2 = 0 THEN 'none' WHEN c_custkey % 2 = 1 THEN 'x' END AS notes FROM customer""")
def migrated_rows(spark, sf_dir):
    """DML-13: versions below three get the column's default where it is null."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("schema_version"), F.when(F.col("c_custkey") % 2 == 1, "x").alias("notes"))
    return contract.migrate(c, {"notes": F.lit("none")}, 3)


@query("""SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def stale_vectors(spark, sf_dir):
    """RET-28, RET-29: chunks without a vector (each seventh) or with one of an older text (each fifth)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), _str("h", F.col("doc_id")).alias("content_hash"))
    v = d.filter("chunk_id % 7 <> 0").withColumn("content_hash", F.when(F.col("chunk_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return index.stale_vectors(d, v).select("chunk_id")


@query("""WITH b AS (SELECT doc_id % 20 AS batch, CASE WHEN doc_id % 97 = 0 THEN '' ELSE (doc_id // (CASE WHEN doc_id % 20 = 3 THEN 40 ELSE 1 END))::VARCHAR END AS id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT batch, sum(octet_length(encode(t))) > 60000 AS a, count(*) FILTER (id = '') > 0 AS b, count(*) FILTER (length(t) > 20000) > 0 AS c, count(*) > count(DISTINCT id) AS d FROM b GROUP BY batch)
    SELECT batch, array_to_string(list_filter([CASE WHEN a THEN 'bytes' END, CASE WHEN b THEN 'id' END, CASE WHEN c THEN 'text' END, CASE WHEN d THEN 'repeat' END], lambda x: x IS NOT NULL), ',') AS faults FROM f WHERE a OR b OR c OR d""")
def batch_faults(spark, sf_dir):
    """SRC-29."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((i % 20).alias("batch"), F.when(i % 97 == 0, "").otherwise(F.floor(i / F.when(i % 20 == 3, 40).otherwise(1)).cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return index.batch_faults(rows, 60_000, 20_000).select("batch", F.array_join("faults", ",").alias("faults"))


@query("""SELECT n_regionkey AS space_id, n_nationkey AS context_id FROM nation UNION SELECT r_regionkey, 100 + r_regionkey FROM region WHERE r_regionkey > 0""")
def space_members(spark, sf_dir):
    """JOIN-17, SET-01: members of each space, its primary one included; a member that is listed twice counts once."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("space_id")).agg(F.collect_list("n_nationkey").alias("x"))
    spaces = n.select("space_id", F.concat("x", "x").alias("context_ids"), F.when(F.col("space_id") > 0, F.col("space_id") + 100).alias("primary_id"))
    return index.expand_members(spaces)


@query("""SELECT true AS same, false AS other, count(*) AS n FROM orders""")
def pack_fingerprints(spark, sf_dir):
    """SET-08, SET-10: a table in another order has the same digest, one row less has another."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    keys = ["o_orderkey", "o_totalprice"]
    a, b = index.fingerprint(o, keys), index.fingerprint(o.repartition(5, "o_totalprice"), keys)
    c = index.fingerprint(o.filter("o_orderkey > 1"), keys)
    out = a.select("n", "digest").crossJoin(b.select(F.col("digest").alias("b"))).crossJoin(c.select(F.col("digest").alias("c")))  # one row each
    return out.select((F.col("digest") == F.col("b")).alias("same"), (F.col("digest") == F.col("c")).alias("other"), "n")
