"""Queries over the geometry of pages: the words of every document laid out in one column, in two, in a grid, or reaching over the middle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import regions
from tesselon.plans.registry import query, table
from tesselon.session import spread_small

# a document's number decides its style: one column, two columns, a grid of single words, two columns with boxes too wide for one
_SQL_ITEMS = r"""
    d AS (SELECT doc_id, (doc_id % 4)::INT AS s, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    e AS (SELECT *, CASE s WHEN 2 THEN 1 ELSE 5 END AS per FROM d),
    t AS (SELECT doc_id, s, i, CASE s WHEN 2 THEN substr(ws[i + 1], 1, 8) ELSE array_to_string(list_slice(ws, i * per + 1, i * per + per), ' ') END AS text
        FROM (SELECT *, unnest(range(0, CAST(ceil(len(ws) / per) AS BIGINT))) AS i FROM e)),
    p AS (SELECT *, i // CASE s WHEN 0 THEN 30 WHEN 2 THEN 40 ELSE 60 END AS page,
        CASE s WHEN 0 THEN 0 WHEN 2 THEN i % 4 ELSE i % 60 // 30 END AS col, CASE s WHEN 2 THEN i % 40 // 4 ELSE i % 30 END AS r FROM t),
    q AS (SELECT *, CASE s WHEN 2 THEN 40.0 + 110 * col ELSE 40.0 + 280 * col + i % 3 * 4 END::DOUBLE AS x,
        (760.0 - 14 * r - CASE WHEN s IN (1, 3) THEN 1.5 * col ELSE 0 END)::DOUBLE AS y,
        CASE WHEN s = 0 THEN 200 WHEN s = 2 THEN 30 WHEN s = 3 AND col = 0 THEN 300 ELSE 220 END::DOUBLE AS w, string_split(text, ' ') AS parts FROM p),
    it AS (SELECT *, x + w AS rt, length(text) AS n_chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(parts) AS tokens,
        len(list_filter(parts, lambda v: regexp_matches(v, '[A-Za-z]{2}'))) AS words2, len(list_filter(parts, lambda v: regexp_matches(v, '[A-Za-z]{3}'))) AS words3,
        x < 286 AS lo, x > 314 AS ro, x < 300 AND x + w > 320 AND w > 270 AS wide FROM q),
    f AS (SELECT *, words3 >= 2 OR n_chars >= 24 AS prose FROM it),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY col) - 1 AS k
        FROM (SELECT *, bool_or(prose) OVER (PARTITION BY doc_id, page) AS anyp FROM f) WHERE prose OR NOT anyp)"""


def page_items(spark, sf_dir):
    """Items of 600 units wide pages made of the words of ``documents``."""
    i, s = F.col("i"), F.col("s")
    d = spread_small(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.col("doc_id") % 4).alias("s"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \x09-\x0D]+", " ").alias("t"))
    # runs of words as one pass over the text
    words = lambda more: F.regexp_extract_all("t", F.lit(f"[^ ]+(?: [^ ]+){{0,{more}}}"), F.lit(0))
    d = d.select("doc_id", "s", F.posexplode(F.when(s == 2, words(0)).otherwise(words(4))).alias("i", "text"))
    d = d.withColumn("text", F.when(s == 2, F.substring("text", 1, 8)).otherwise(F.col("text")))
    page = F.floor(i / F.when(s == 0, 30).when(s == 2, 40).otherwise(60)).cast("int")
    col = F.when(s == 0, 0).when(s == 2, i % 4).otherwise(F.floor(i % 60 / 30))
    row = F.when(s == 2, F.floor(i % 40 / 4)).otherwise(i % 30)
    two = s.isin(1, 3)
    return d.select(
        F.col("doc_id").cast("string").alias("source_id"), page.alias("page_number"), i.alias("item"), "text",
        F.when(s == 2, 40.0 + 110 * col).otherwise(40.0 + 280 * col + i % 3 * 4).cast("double").alias("x"),
        (760.0 - 14 * row - F.when(two, 1.5 * col).otherwise(0.0)).cast("double").alias("y"),
        F.when(s == 0, 200.0).when(s == 2, 30.0).when((s == 3) & (col == 0), 300.0).otherwise(220.0).alias("width"), F.lit(10.0).alias("height"), F.lit(600.0).alias("page_width"))


_ID = "doc_id::VARCHAR AS source_id, page::INT AS page_number"


@query(f"""WITH {_SQL_ITEMS} SELECT {_ID}, r::INT AS line, count(*) AS items, round(avg(y), 6) AS y, sum(words2)::BIGINT AS words FROM f GROUP BY doc_id, page, r""")
def page_lines(spark, sf_dir):
    """LAY-01 over rows: visual lines of every page."""
    lined = regions.visual_lines(regions.item_features(page_items(spark, sf_dir)), carry=["words"])
    return lined.groupBy("source_id", "page_number", "line").agg(F.count("*").alias("items"), F.round(F.first("line_y"), 6).alias("y"), F.sum("words").cast("long").alias("words"))


@query(f"""WITH {_SQL_ITEMS},
    g AS (SELECT doc_id, page, k, avg(x) AS cx, count(*) AS items, max(y) - min(y) AS y_span, max(w) AS median_width, count(*) FILTER (n_chars <= 12) / count(*) >= 0.7 AS short_noise,
        sum(letters)::BIGINT AS letters, min(x) AS l, max(rt) AS rt FROM c GROUP BY ALL),
    ln AS (SELECT doc_id, page, r, min(x) AS anchor, sum(words2) AS words FROM f GROUP BY ALL),
    nr AS (SELECT doc_id, page, r, words, arg_min(k, abs(cx - anchor) * 1000 + k) AS k FROM ln JOIN g USING (doc_id, page) GROUP BY ALL),
    pl AS (SELECT doc_id, page, k, count(*) FILTER (words >= 2) AS prose_lines FROM nr GROUP BY ALL)
    SELECT {_ID}, k::INT AS region, CASE WHEN letters >= 40 THEN 'prose' ELSE 'unknown' END AS kind, round(cx, 6) AS x, items, coalesce(prose_lines, 0) AS prose_lines, y_span, median_width,
        lead(l) OVER (PARTITION BY doc_id, page ORDER BY l) - rt AS gutter_to_next, letters, short_noise, round(letters / greatest(1, sum(letters) OVER (PARTITION BY doc_id, page)), 6) AS share
    FROM g LEFT JOIN pl USING (doc_id, page, k)""")
def page_regions(spark, sf_dir):
    """LAY-02, LAY-11: candidate regions with gutters, letters and prose lines."""
    out = regions.regions(page_items(spark, sf_dir))
    return out.select("source_id", "page_number", "region", "kind", F.round("x", 6).alias("x"), "items", "prose_lines", "y_span", "median_width", "gutter_to_next", "letters", "short_noise", F.round("share", 6).alias("share"))


@query(f"""WITH {_SQL_ITEMS},
    n AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page, r ORDER BY x) AS nx FROM f),
    g AS (SELECT doc_id, page, r, count(*) AS items, min(x) AS left_x, max(rt) AS right_x, max(w) AS max_width, bool_or(wide) AS overflow,
        coalesce(bool_or(rt <= 300 AND nx >= 300 AND nx - rt >= 20), false) AS gap, bool_or(lo) AND bool_or(ro) AS bothsides FROM n GROUP BY ALL)
    SELECT {_ID}, r::INT AS line, items, left_x, right_x, 300::DOUBLE AS mid, max_width, overflow, gap FROM g WHERE bothsides OR overflow OR gap""")
def gutter_crossings(spark, sf_dir):
    """LAY-11: lines that cross the middle of their page."""
    return regions.gutter_crossings(page_items(spark, sf_dir))


_KINDS = """
    bx AS (SELECT doc_id, page, count(*) FILTER (n >= 3) AS xs, stddev_pop(n) / avg(n) AS stability FROM (SELECT doc_id, page, floor(x / 8 + 0.5) AS b, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL),
    byy AS (SELECT doc_id, page, count(*) FILTER (n >= 3) AS ys FROM (SELECT doc_id, page, floor(y / 8 + 0.5) AS b, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL),
    ll AS (SELECT doc_id, page, count(*) AS lines, count(*) FILTER (words >= 4) AS long FROM (SELECT doc_id, page, r, sum(words2) AS words FROM f GROUP BY ALL) GROUP BY ALL),
    tt AS (SELECT doc_id, page, count(*) AS items, count(*) FILTER (n_chars <= 12) / count(*) AS short, sum(letters) AS letters, sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS digits,
        sum(length(regexp_replace(text, '[^=∑∫√∞±×÷≤≥≠≈∈→←()\\[\\]{}^_]', '', 'g'))) AS signs, sum(length(replace(text, ' ', ''))) AS chars FROM f GROUP BY ALL),
    kk AS (SELECT *, letters / chars AS alpha, items >= 12 AND xs >= 3 AND ys >= 3 AND short >= 0.7 AS dense FROM tt JOIN ll USING (doc_id, page) JOIN bx USING (doc_id, page) JOIN byy USING (doc_id, page)),
    kd AS (SELECT *, CASE WHEN NOT dense THEN 'none' WHEN (long >= 8 AND alpha >= 0.4) OR (long >= 5 AND long / lines >= 0.28 AND alpha >= 0.35) THEN 'math' ELSE 'table' END AS kind FROM kk)"""


@query(f"""WITH {_SQL_ITEMS}, {_KINDS}
    SELECT {_ID}, items, lines, long AS long_lines, round(short, 6) AS short, round(alpha, 6) AS alpha, round(digits / chars, 6) AS "numeric", round(signs / chars, 6) AS equations,
        xs AS recurring_x, ys AS recurring_y, round(stability, 6) AS stability, dense, kind,
        CASE WHEN kind = 'math' THEN 'likely-math' WHEN kind = 'table' OR (xs >= 3 AND ys >= 3 AND short >= 0.7 AND long <= 1) THEN 'likely-grid' ELSE 'unknown' END AS hypothesis FROM kd""")
def grid_features(spark, sf_dir):
    """LAY-03, LAY-11, LAY-20: grid and formula features of every page."""
    out = regions.grid_features(page_items(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("short", "alpha", "numeric", "equations", "stability")})


def _confident(name: str) -> str:
    """Whether the two sides of the split of that name are columns of prose that overlap in height."""
    return f"""
    {name}_r AS (SELECT f.doc_id, f.page, f.x < z.{name} AS lft, r, avg(y) AS y, sum(tokens) AS tokens FROM f JOIN z USING (doc_id, page) WHERE z.{name} IS NOT NULL GROUP BY ALL),
    {name}_s AS (SELECT doc_id, page, lft, count(*) AS n, max(y) AS top, min(y) AS bot, bool_or(tokens >= 4) AS prose FROM {name}_r GROUP BY ALL),
    {name}_c AS (SELECT a.doc_id, a.page, a.n >= 2 AND b.n >= 2 AND a.prose AND b.prose AND least(a.top - a.bot, b.top - b.bot) >= 12 AND least(a.top, b.top) - greatest(a.bot, b.bot) > 0
        AND least(a.top, b.top) - greatest(a.bot, b.bot) >= 0.3 * least(a.top - a.bot, b.top - b.bot) AS {name}_ok
        FROM {name}_s a JOIN {name}_s b ON a.doc_id = b.doc_id AND a.page = b.page AND a.lft AND NOT b.lft)"""


@query(f"""WITH {_SQL_ITEMS}, {_KINDS},
    cl AS (SELECT doc_id, page, k, r, sum(words2) >= 4 AS long FROM c GROUP BY ALL),
    cm AS (SELECT doc_id, page, k, avg(x) AS cx, count(*) AS n, sum(letters) AS mass, max(y) AS top, min(y) AS bot FROM c GROUP BY ALL),
    cs AS (SELECT *, mass / greatest(1, sum(mass) OVER (PARTITION BY doc_id, page)) AS share FROM cm JOIN (SELECT doc_id, page, k, count(*) FILTER (long) AS long FROM cl GROUP BY ALL) USING (doc_id, page, k)),
    tp AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY mass DESC, k) <= 2),
    dm AS (SELECT a.doc_id, a.page, (a.cx + b.cx) / 2 AS cut_at FROM tp a JOIN tp b ON a.doc_id = b.doc_id AND a.page = b.page AND a.k < b.k
        WHERE b.cx - a.cx >= 108 AND a.cx <= 270 AND b.cx >= 270 AND least(a.n, b.n) >= 3 AND least(a.mass, b.mass) >= 40 AND least(a.long, b.long) >= 2 AND least(a.share, b.share) >= 0.18
            AND least(a.top - a.bot, b.top - b.bot) >= 12 AND least(a.top, b.top) - greatest(a.bot, b.bot) > 0
            AND least(a.top, b.top) - greatest(a.bot, b.bot) >= 0.3 * least(a.top - a.bot, b.top - b.bot) AND a.share + b.share >= 0.55),
    rk AS (SELECT doc_id, page, bool_or((lm AND rm) OR (ov AND past)) AS risk FROM (SELECT doc_id, page, r, bool_or(lo AND words3 >= 2) AS lm, bool_or(ro AND words3 >= 2) AS rm, bool_or(wide) AS ov, bool_or(ro) AS past
        FROM f GROUP BY ALL) GROUP BY ALL),
    sd AS (SELECT doc_id, page, count(*) FILTER (lo AND lw >= 4) AS ll, count(*) FILTER (ro AND rw >= 4) AS rl FROM (SELECT doc_id, page, r, bool_or(lo) AS lo, bool_or(ro) AS ro,
        sum(words2) FILTER (lo) AS lw, sum(words2) FILTER (ro) AS rw FROM f GROUP BY ALL) GROUP BY ALL),
    ct AS (SELECT doc_id, page, bool_or(wide) AS distrust, count(*) FILTER (ro) AS rights, count(*) FILTER (lo AND prose) AS lp, count(*) FILTER (ro AND prose) AS rp FROM f GROUP BY ALL),
    pr AS (SELECT doc_id, page, count(*) AS kn, min(cx) AS x1, max(cx) AS x2 FROM (SELECT doc_id, page, col, avg(x) AS cx FROM f GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
    z0 AS (SELECT kd.doc_id, kd.page, kind, kind <> 'table' AND dm.cut_at IS NOT NULL AS two, dm.cut_at, kind <> 'table' AND
            ((kind <> 'table' AND dm.cut_at IS NOT NULL) OR risk OR (distrust AND rights >= 2 AND lp >= 2 AND ll >= 2 AND (rp >= 2 OR rl >= 2))) AS refuse,
            CASE WHEN kn = 2 AND x2 - x1 >= 108 AND x1 <= 270 AND x2 >= 270 THEN (x1 + x2) / 2 END AS pair_at
        FROM kd JOIN rk USING (doc_id, page) JOIN sd USING (doc_id, page) JOIN ct USING (doc_id, page) LEFT JOIN pr USING (doc_id, page) LEFT JOIN dm USING (doc_id, page)),
    z AS (SELECT *, CASE WHEN two THEN cut_at WHEN refuse THEN 300 END AS split_at FROM z0),
    hv AS (SELECT doc_id, page, count(DISTINCT r) FILTER (rt < 286) AS hl, count(DISTINCT r) FILTER (x > 314) AS hr FROM f GROUP BY ALL),
    sp AS (SELECT doc_id, page, max(x0) - min(x0) AS spread FROM (SELECT doc_id, page, r, min(x) AS x0 FROM f GROUP BY ALL) GROUP BY ALL), {_confident("split_at")}, {_confident("pair_at")}
    SELECT z.doc_id::VARCHAR AS source_id, z.page::INT AS page_number, kind, two AS two_dominant, refuse AS refuse_single,
        CASE WHEN kind = 'table' THEN 'uncertain' WHEN two THEN CASE WHEN coalesce(split_at_ok, false) THEN 'two-column' ELSE 'uncertain' END WHEN coalesce(pair_at_ok, false) THEN 'two-column'
            WHEN refuse OR (hl >= 2 AND hr >= 2 AND spread > 210) THEN 'uncertain' ELSE 'single-column' END AS reading_order
    FROM z JOIN hv USING (doc_id, page) JOIN sp USING (doc_id, page) LEFT JOIN split_at_c USING (doc_id, page) LEFT JOIN pair_at_c USING (doc_id, page)""")
def reading_orders(spark, sf_dir):
    """LAY-04, LAY-12: reading order of pages in one column, two, a grid, or with boxes over the middle."""
    return regions.reading_orders(page_items(spark, sf_dir)).drop("split_x")
