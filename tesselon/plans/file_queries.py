"""Queries over paths and files: selection, scores, classes, exclusion patterns, sniffing, commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import scalars as sc
from tesselon.operators import chunking, retrieval, scope
from tesselon.plans.registry import TREE_PATH, query, table, tree_path

_TREE = f"tree AS (SELECT doc_id, {TREE_PATH} AS path, lower({TREE_PATH}) AS p, coalesce(n_chars, 0) * (doc_id % 60) AS size, doc_id % 5 AS pack_id FROM documents)"


def _tree(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tree_path().alias("path"), (F.coalesce("n_chars", F.lit(0)) * (F.col("doc_id") % 60)).alias("size"), (F.col("doc_id") % 5).alias("pack_id"))


_SCORE = r"""(
    CASE WHEN regexp_matches(p, '(^|/)(src|lib|internal|pkg|cmd|app|apps|services|service|api|server|core|backend|domain|handlers|usecase)(/|$)') THEN 10 ELSE 0 END
    + CASE WHEN regexp_matches(p, '\.(ts|tsx|go|py|java|rs|kt)$') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(p, '\.(docx|xlsx|csv|ppt|pptx)$') THEN 8 ELSE 0 END
    + CASE WHEN regexp_matches(p, '\.(js|jsx|rb|cs)$') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(p, '(adr|architecture|rfc|design-doc)') THEN 7 ELSE 0 END
    + CASE WHEN regexp_matches(p, '(^|/)docs/.*\.md$') THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(p, '\.(spec|test|e2e)\.|(^|/)(__tests__|testdata|fixtures|mocks|stories|e2e)(/|$)') THEN -10 ELSE 0 END
    + CASE WHEN regexp_matches(p, '(^|/)(migrations|fixtures|snapshots|__snapshots__)(/|$)') THEN -6 ELSE 0 END
    + CASE WHEN regexp_matches(p, '(jenkins|_scm_|github/workflows|environment-mapping|site-packages|dist-packages|deno-deck-venv)') THEN -40 ELSE 0 END
    + CASE WHEN regexp_matches(p, '(^|/)__init__\.py$') THEN -5 ELSE 0 END + CASE WHEN regexp_matches(p, '\.json$') THEN -2 ELSE 0 END
    + CASE WHEN regexp_matches(p, '\.(yml|yaml)$') AND NOT regexp_matches(p, '(^|/)(src|docs)/') THEN -8 ELSE 0 END
    + CASE WHEN len(string_split(p, '/')) <= 4 THEN 2 WHEN len(string_split(p, '/')) > 8 THEN -2 ELSE 0 END)"""


@query(f"WITH {_TREE} SELECT doc_id, {_SCORE}::INT AS score FROM tree")
def path_scores(spark, sf_dir):
    """SRC-08."""
    return _tree(spark, sf_dir).select("doc_id", scope.path_score(F.col("path")).alias("score"))


@query(f"WITH {_TREE} SELECT path, {_SCORE}::INT AS score FROM tree WHERE {_SCORE} >= 2")
def pruned_pack(spark, sf_dir):
    """SRC-07."""
    return scope.prune(_tree(spark, sf_dir).select("path"))


@query(f"""WITH {_TREE} SELECT doc_id, CASE
    WHEN regexp_matches(p, '(^|/)(node_modules|vendor|dist|build|target|\\.git|\\.next|\\.venv|venv|__pycache__)/') THEN 'vendor and build folders'
    WHEN regexp_matches(p, '(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|cargo\\.lock|composer\\.lock|poetry\\.lock)$') THEN 'lockfiles'
    WHEN regexp_matches(p, '\\.(png|jpe?g|gif|webp|ico|svg|mp[34]|mov|wav|zip|gz|tar|jar|exe|dll|so|woff2?|ttf|pdf)$') THEN 'binaries and media'
    WHEN p LIKE '%.json' AND size > 12000 THEN 'large JSON'
    WHEN CASE WHEN regexp_matches(p, '\\.(docx|xlsx|csv|ppt|pptx)$') THEN size > 4000000 ELSE size > 150000 END THEN 'files over the size limit' END AS reason FROM tree""")
def skip_reasons(spark, sf_dir):
    """SRC-02, SRC-03, SRC-04."""
    return _tree(spark, sf_dir).select("doc_id", scope.skip_reason(F.col("path"), F.col("size")).alias("reason"))


@query(f"""WITH RECURSIVE {_TREE}, o AS (SELECT pack_id, path, size, row_number() OVER (PARTITION BY pack_id ORDER BY {_SCORE} DESC, path) AS no FROM tree),
    w AS (SELECT pack_id, no, path, CASE WHEN size <= 600000 THEN 1 ELSE 0 END AS n, CASE WHEN size <= 600000 THEN size ELSE 0 END AS used, size <= 600000 AS kept FROM o WHERE no = 1
        UNION ALL SELECT o.pack_id, o.no, o.path, w.n + CASE WHEN w.n < 30 AND w.used + o.size <= 600000 THEN 1 ELSE 0 END,
            w.used + CASE WHEN w.n < 30 AND w.used + o.size <= 600000 THEN o.size ELSE 0 END, w.n < 30 AND w.used + o.size <= 600000
        FROM w JOIN o ON o.pack_id = w.pack_id AND o.no = w.no + 1)
    SELECT pack_id, (n - 1)::INT AS place, path FROM w WHERE kept""")
def selected_files(spark, sf_dir):
    """SRC-05, SRC-06: at most 30 files and 600,000 bytes a pack."""
    return scope.select_files(_tree(spark, sf_dir), 30, 600_000)


@query(f"WITH {_TREE} SELECT pack_id, path FROM tree QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY {_SCORE} DESC, path) = 1")
def preferred_files(spark, sf_dir):
    """SRT-08."""
    return scope.preferred_file(_tree(spark, sf_dir)).select("pack_id", "path")


@query(f"""WITH {_TREE}, e AS (SELECT doc_id, p, CASE WHEN contains(path, '.') THEN regexp_extract(p, '\\.([^./]+)$', 1) ELSE '' END AS ext FROM tree)
    SELECT doc_id, CASE WHEN ext IN ('tsx', 'js', 'jsx', 'mjs', 'cjs') THEN 'ts' WHEN ext = 'mdx' THEN 'md' WHEN ext = '' THEN 'txt' ELSE ext END AS language FROM e""")
def file_languages(spark, sf_dir):
    """STR-30."""
    return _tree(spark, sf_dir).select("doc_id", scope.language_of(F.col("path")).alias("language"))


_FLAGS = r"""regexp_matches(p, '(^|/)(__tests__|tests?|testdata|fixtures?|mocks?|stories|e2e|examples?|snapshots?)(/|$)|\.(spec|test|e2e)\.[a-z]+$') AS is_test,
    regexp_matches(path, '(?i)(^|/)(docs|contracts?|architecture|security)(/|$)|(^|/)README\.md$|(^|/)AGENTS\.md$|(^|/)CLAUDE\.md$') AS auth,
    regexp_matches(p, '(^|/)(services?|workers?|container-lambdas|lambdas|handlers|usecases?|domain|core|pipeline|processing|ingest|extraction|indexing)(/|$)') AS is_behavior,
    regexp_matches(p, '(^|/)(routes?|controllers?|endpoints?|api)(/|$)|(?:^|/)(router|routes)\.[a-z]+$') AS route,
    NOT (regexp_matches(p, '(node_modules|site-packages|dist-packages|__pypackages__|\.venv|/venv/|\.deno|deno-deck-venv|lib/python\d)')
        OR regexp_matches(p, '(^|/)(dist|build|out|coverage|vendor|__generated__|generated|\.next|\.turbo|\.cache|__snapshots__)/|\.(gen|generated)\.[a-z]+$|\.d\.ts$|\.min\.(js|css)$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|composer\.lock)$|\.snap$')
        OR regexp_matches(path, '(^|/)\.[A-Za-z0-9_-]+/')) AS evidence"""


@query(f"WITH {_TREE}, f AS (SELECT doc_id, {_FLAGS} FROM tree) SELECT doc_id, is_test, auth AND NOT is_test AS is_authoritative, is_behavior, route AND NOT is_behavior AS is_route, evidence FROM f")
def path_classes(spark, sf_dir):
    """FLT-01, FLT-02."""
    p = F.col("path")
    return _tree(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in retrieval.path_flags(p).items()], retrieval.is_evidence_path(p).alias("evidence"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN chr(1) || repeat('ab', (doc_id % 9)::INT) || coalesce(text, '') WHEN 2 THEN repeat(chr(7) || 'abcdefghij', 20) ELSE repeat(chr(5) || 'abcdefghijklmnop', 9) END AS t FROM documents),
    h AS (SELECT doc_id, substr(t, 1, 800) AS h FROM s)
    SELECT doc_id, len(list_filter(string_split(h, ''), lambda c: unicode(c) BETWEEN 1 AND 8 OR unicode(c) BETWEEN 14 AND 31)) / greatest(length(h), 1) < 0.08 AS looks FROM h""")
def text_sniff(spark, sf_dir):
    """SRC-09."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    t = F.when(i % 4 == 0, text).when(i % 4 == 1, F.concat(F.lit("\x01"), F.repeat(F.lit("ab"), (i % 9).cast("int")), text)).when(
        i % 4 == 2, F.repeat(F.lit("\x07abcdefghij"), F.lit(20))).otherwise(F.repeat(F.lit("\x05abcdefghijklmnop"), F.lit(9)))
    return table(spark, sf_dir, "documents").select("doc_id", scope.looks_like_text(t).alias("looks"))


@query("""SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN ['docs/**', 'src'] WHEN 1 THEN ['docs/**', '*.md'] ELSE ['*.md', 'src'] END, ',') AS patterns,
    array_to_string(CASE doc_id % 3 WHEN 0 THEN ['docs/**'] WHEN 1 THEN ['docs/**', '*.md', 'src'] ELSE ['*.md'] END, ',') AS toggled FROM documents""")
def exclude_patterns(spark, sf_dir):
    """SET-03, SET-04, SET-09: cleaned, distinct in order; then one of them toggled."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" /docs/** "), F.lit("src/"), F.lit("docs/**"))).when(
        F.col("doc_id") % 3 == 1, F.array(F.lit("docs/**"), F.lit(""), F.lit("*.md"), F.lit("/docs/**"))).otherwise(F.array(F.lit("*.md"), F.lit("  "), F.lit("src")))
    d = table(spark, sf_dir, "documents").select("doc_id", scope.distinct_patterns(raw).alias("p"))
    return d.select("doc_id", F.array_join("p", ",").alias("patterns"), F.array_join(scope.toggle(F.col("p"), F.lit("src")), ",").alias("toggled"))


@query("""SELECT doc_id AS chunk_id, 'w1' AS workspace_id, 's1' AS space_id, coalesce(lang, 'c1') AS context_id FROM documents""")
def tagged_chunks(spark, sf_dir):
    """FLT-07."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("workspace_id"), F.lit(None).cast("string").alias("space_id"), F.col("lang").alias("context_id"))
    return scope.tag_scope(d, "w1", "s1", "c1")


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9._-]+', '-', 'g'), '-') AS prefix FROM part""")
def path_prefixes(spark, sf_dir):
    """CHK-16."""
    return table(spark, sf_dir, "part").select("p_partkey", chunking.clean_prefix(F.concat_ws(" / ", "p_name", "p_brand")).alias("prefix"))


@query("""SELECT 'p' || (o_custkey % 7) AS pack_id, 'commit:sha' || o_orderkey AS chunk_id, 'why' AS kind, 'commits/sha' || o_orderkey AS path,
    sha256('order of ' || o_custkey || chr(10) || 'src/a' || (o_orderkey % 3) || '.ts' || chr(10) || 'docs/b.md') AS digest, NULLIF(o_orderkey % 5, 0)::VARCHAR AS pr FROM orders""")
def commit_chunks(spark, sf_dir):
    """CHK-02."""
    o = table(spark, sf_dir, "orders")
    c = o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("pack_id"), F.concat(F.lit("sha"), F.col("o_orderkey").cast("string")).alias("sha"), F.lit("me").alias("author"),
                 F.col("o_orderdate").alias("date"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("message"), F.nullif(F.col("o_orderkey") % 5, F.lit(0)).cast("string").alias("pr"),
                 F.array(F.concat(F.lit("src/a"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".ts")), F.lit("docs/b.md")).alias("files"))
    return chunking.commit_chunks(c).select("pack_id", "chunk_id", "kind", "path", sc.content_hash(F.col("text")).alias("digest"), "pr")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT AS n, sum(floor(l_quantity)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS upto FROM lineitem)
    SELECT l_orderkey, l_linenumber, upto - n AS start, upto AS "end", (upto - n) < 40 AND upto > 25 OR (upto - n) < 100 AND upto > 90 AS banned FROM l""")
def banned_overlaps(spark, sf_dir):
    """CHK-11."""
    from pyspark.sql import Window

    upto = F.sum(F.col("l_quantity").cast("long")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (upto - F.col("l_quantity").cast("long")).alias("start"), upto.alias("end"))
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((25, 40), (90, 100))])
    return r.withColumn("banned", chunking.overlaps(F.col("start"), F.col("end"), ranges))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, floor(l_quantity)) AS no FROM lineitem),
    w AS (SELECT l_orderkey, no, 0 AS g, n AS used FROM o WHERE no = 1 UNION ALL
        SELECT o.l_orderkey, o.no, w.g + CASE WHEN w.used + o.n <= 60 THEN 0 ELSE 1 END, CASE WHEN w.used + o.n <= 60 THEN w.used + o.n ELSE o.n END FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.no = w.no + 1)
    SELECT l_orderkey, string_agg(g, ',' ORDER BY no) AS groups FROM w GROUP BY l_orderkey""")
def packed_items(spark, sf_dir):
    """CHK-09: an order's lines packed up to 60 pieces."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("n")))).alias("x"))
    return items.select("l_orderkey", F.array_join(chunking.pack_greedy(F.transform("x", lambda x: x["n"]), 60), ",").alias("groups"))
