"""Page geometry as columns: visual lines, left-edge clusters, regions, gutters, grids and reading order.

Items are rows (source_id, page_number, item, text, x, y, width, height, page_width); x grows to the right, y upwards. Everything
is grouped by page. Two rules are folds in order of place, the grouping of items to lines (a line's y is
the mean of its items so far) and the merging of left edges (a cluster's x likewise): small functions over the items of a page.
What needs a page as a whole (regions, columns, reading order) collects its numbers, without texts, to one row by one shuffle; counts
over its items, lines and clusters are made of Arrow columns of many pages at once, and the rules on these counts are
columns. Null texts count as empty; empty items are on no line, blank ones in no cluster.
"""

from __future__ import annotations

import functools
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.session import text_batches

PAGE = ["source_id", "page_number"]
# fixed values: tolerances, buckets and shares of the layout rules
LINE_TOLERANCE, EDGE_BUCKET, GRID_BUCKET = 0.45, 36, 8
GUTTER, MIN_SEPARATION, MID_MARGIN, OVERFLOW_REACH, OVERFLOW_SHARE = 28, 0.18, 14, 20, 0.45
MIN_ITEMS, MIN_LETTERS, MIN_LINES, MIN_SPAN, MIN_OVERLAP, MIN_SHARE, MIN_TOP2 = 3, 40, 2, 12, 0.3, 0.18, 0.55
SHORT_TEXT, GRID_ITEMS, GRID_REPEATS, GRID_SHARE, PROSE_LINE = 12, 12, 3, 0.7, 4
EQUATION_SIGNS = "=∑∫√∞±×÷≤≥≠≈∈→←()[]{}^_"
#: White space: that of regular expressions, the separators of Unicode and the byte order mark.
SPACES = [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
#: What a code point is, those beyond 16 bits being none of these.
_SPACE, _LETTER, _DIGIT, _SIGN = 1, 2, 4, 8
_POINTS = np.zeros(1 << 16, np.uint8)
for _flag, _of in ((_SPACE, SPACES), (_LETTER, [*range(65, 91), *range(97, 123)]), (_DIGIT, [*range(48, 58)]), (_SIGN, [ord(c) for c in EQUATION_SIGNS])):
    _POINTS[_of] |= _flag
#: Characters without outer white space, letters, words (runs without white space) of two Latin letters in a row, all words, those of three letters; signs, digits, characters that are not blank.
_COUNTS = ("filled", "letters", "words", "tokens", "long_words", "signs", "digits", "chars")


def _count_points(texts: list[str]) -> np.ndarray:
    """One row of ``_COUNTS`` a text, by the classes of the code points of all texts at once."""
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    kind = _POINTS[np.where(points < 1 << 16, points, 0)]
    per_text = lambda mask: np.add.reduceat(mask, at[:-1], dtype=np.int64)
    solid, letter = kind & _SPACE == 0, kind & _LETTER != 0
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    starts, token = np.flatnonzero(start), np.cumsum(start) - 1
    two = letter[:-1] & letter[1:]

    def holds(run: np.ndarray) -> np.ndarray:
        found = np.zeros(len(starts), bool)
        found[token[: len(run)][run]] = True
        return np.bincount(np.searchsorted(at, starts[found], "right") - 1, minlength=len(texts))

    places = np.flatnonzero(solid)
    lo, hi = np.searchsorted(places, at[:-1]), np.searchsorted(places, at[1:])
    filled = np.zeros(len(texts), np.int64)
    some = hi > lo
    filled[some] = places[hi[some] - 1] - places[lo[some]] + 1
    return np.stack([filled, per_text(letter), holds(two), per_text(start), holds(two[:-1] & two[1:]), per_text(kind & _SIGN != 0), per_text(kind & _DIGIT != 0), per_text(solid)], axis=1)


def _counts(text: pa.Array) -> pa.Array:
    rows, some, size = [np.zeros((0, len(_COUNTS)), np.int64)], [], 0
    for t in text.to_pylist():
        some.append(t)
        size += len(t)
        if size >= 1 << 20:
            rows.append(_count_points(some))
            some, size = [], 0
    if some:
        rows.append(_count_points(some))
    out = np.concatenate(rows).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(out.T)], list(_COUNTS))


def item_features(items: DataFrame) -> DataFrame:
    """``items`` with right edge, ``_COUNTS`` of the text and the flags that the rules share."""
    text = F.coalesce("text", F.lit(""))
    height = F.coalesce("height", F.lit(0.0))
    guess = F.greatest(F.length(text), F.lit(1)) * F.greatest(height, F.lit(8.0)) * 0.5
    # not deterministic, so that no filter brings the counts about a second time
    counts = F.arrow_udf(_counts, "struct<" + ", ".join(f"{c}: int" for c in _COUNTS) + ">").asNondeterministic()
    out = items.withColumns({
        "text": text, "height": height, "right": F.col("x") + F.when(F.col("width") > 0, F.col("width")).otherwise(guess), "__c": counts(text),
    })
    out = out.withColumns({c: F.col(f"__c.{c}") for c in _COUNTS}).drop("__c")
    mid = F.col("page_width") / 2
    return out.withColumns({
        "prose": (F.col("long_words") >= 2) | (F.col("filled") >= 24), "multi": F.col("long_words") >= 2,
        "overflow": (F.col("page_width") > 0) & (F.col("x") < mid) & (F.col("right") > mid + OVERFLOW_REACH)
        & (F.coalesce("width", F.lit(0.0)) > F.col("page_width") * OVERFLOW_SHARE),
        "on_left": F.col("x") < mid - MID_MARGIN, "on_right": F.col("x") > mid + MID_MARGIN,
    })


def visual_lines(items: DataFrame, keys: list[str] = PAGE, carry: list[str] | None = None) -> DataFrame:
    """LAY-01: ``items`` that are not empty, with line (from 0, downwards), line_y and line_height, grouped within ``keys``.

    Of their columns the keys, item, x, y, height and ``carry`` come along (all, if that is None).

    From the top down, then from the left, an item joins the first line whose y lies within 0.45 of the greater height of both.
    """
    filled = items.filter(F.length("text") > 0)
    return _lines(filled if carry is None else filled.select(*dict.fromkeys([*keys, "item", "x", "y", "height", *carry])), keys)


def _fold(ys: np.ndarray, hs: np.ndarray) -> tuple[list[int], list[float], list[float]]:
    """Number, y and height of the line of each of a page's items, which come from the top down."""
    y, h, n, own, first = [], [], [], [], 0
    reach = max(hs, default=0.0) * LINE_TOLERANCE
    for it, high in zip(ys.tolist(), hs.tolist(), strict=True):
        # items only go down: a line that is out of any item's reach stays so
        while first < len(y) and y[first] - it > reach:
            first += 1
        for k in range(first, len(y)):
            if abs(y[k] - it) <= max(h[k], high) * LINE_TOLERANCE:
                y[k], h[k], n[k] = (y[k] * n[k] + it) / (n[k] + 1), max(h[k], high), n[k] + 1
                break
        else:
            k = len(y)
            y.append(it)
            h.append(high)
            n.append(1)
        own.append(k)
    # a line without a place comes first
    order = sorted(range(len(y)), key=lambda k: (y[k] == y[k], -y[k] if y[k] == y[k] else 0, k))
    at = {k: i for i, k in enumerate(order)}
    return [at[k] for k in own], [y[k] for k in own], [h[k] for k in own]


def _folds(ys: pd.Series, hs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_fold(y, h) for y, h in zip(ys, hs, strict=True)], columns=["line", "y", "h"])


def _lines(items: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`visual_lines` of items that are not empty. A page's items are collected once and carry their columns along."""
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(12.0).cast("double")
    put = F.struct((-F.col("y")).alias("down"), F.col("x").alias("from"), F.col("item").alias("no"), F.struct(*[F.col(c) for c in items.columns if c not in keys]).alias("it"), height.alias("h"))
    known = functools.reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in keys])
    page = items.filter(known).groupBy(*keys).agg(F.sort_array(F.collect_list(put)).alias("its"))
    fold = F.pandas_udf(_folds, "line array<int>, y array<double>, h array<double>")
    page = page.withColumn("fold", fold(F.transform("its", lambda i: i["it"]["y"].cast("double")), F.transform("its", lambda i: i["h"])))
    rows = page.select(*keys, F.explode(F.arrays_zip(F.transform("its", lambda i: i["it"]).alias("it"), F.col("fold.line").alias("line"), F.col("fold.y").alias("y"), F.col("fold.h").alias("h"))).alias("z"))
    own = [F.col(c) if c in keys else F.col(f"z.it.{c}").alias(c) for c in items.columns]
    return rows.select(*own, F.col("z.line").alias("line"), F.when(F.col("z.it.y").isNotNull(), F.col("z.y")).alias("line_y"), F.col("z.h").alias("line_height"))


def _pages(items: DataFrame) -> DataFrame:
    """(page, its): the numbers of each page's items; pages without a source or number are left out."""
    text_batches(items.sparkSession, 1000)
    double = lambda c: F.col(c).cast("double").alias(c)
    put = F.struct(F.col("item").cast("long").alias("item"), *map(double, ("x", "y", "width", "right", "height", "page_width")), *_COUNTS, F.length("text").alias("length"))
    known = items.filter(functools.reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in PAGE]))
    return item_features(known).select(*PAGE, put.alias("it")).groupBy(*PAGE).agg(F.collect_list("it").alias("its"))


class _Items:
    """The items of a batch of pages as columns, page by page in order of place; what is null is not a number."""

    def __init__(self, its: pa.ListArray):
        flat, self.pages = its.flatten(), len(its)
        page = np.repeat(np.arange(len(its)), its.value_lengths().to_numpy(zero_copy_only=False))
        of = {c.name: flat.field(c.name) for c in flat.type}
        known = {c: of[c].is_valid().to_numpy(zero_copy_only=False) for c in ("x", "y")}
        of = {c: v.to_numpy(zero_copy_only=False) for c, v in of.items()}
        order = np.lexsort((of["item"], of["x"], known["x"], -of["y"], known["y"], page))
        self.page = page[order]
        for c, v in of.items():
            setattr(self, c, v[order])
        self.width = np.where(np.isnan(self.width), 0.0, self.width)
        mid = self.page_width / 2
        self.on_left, self.on_right = self.x < mid - MID_MARGIN, self.x > mid + MID_MARGIN
        self.overflow = (self.page_width > 0) & (self.x < mid) & (self.right > mid + OVERFLOW_REACH) & (self.width > self.page_width * OVERFLOW_SHARE)
        self.solid, self.prose = self.filled > 0, (self.long_words >= 2) | (self.filled >= 24)

    def prose_or_all(self) -> np.ndarray:
        """A page's prose items; all its items that are not blank, if it has no prose."""
        some = np.zeros(self.pages, bool)
        some[self.page[self.solid & self.prose]] = True
        return self.solid & (self.prose | ~some[self.page])


class _Groups:
    """Sums and the like of ``values`` by the group of each item (-1: of none), for groups 0 to n - 1."""

    def __init__(self, of: np.ndarray, n: int):
        self.inside, self.n = of >= 0, n
        self.of = of[self.inside]

    def count(self, which: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.of if which is None else self.of[which[self.inside]], minlength=self.n)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, values[self.inside], minlength=self.n)

    def any(self, which: np.ndarray) -> np.ndarray:
        return self.count(which) > 0

    def least(self, values: np.ndarray) -> np.ndarray:
        """Not a number where there is none."""
        out = np.full(self.n, np.nan)
        np.fmin.at(out, self.of, values[self.inside].astype(float))
        return out

    def most(self, values: np.ndarray) -> np.ndarray:
        return -self.least(-values)


def _lined(items: _Items, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line of each item (numbered over all groups; -1: of no group), and the group and y of each line."""
    picked = np.flatnonzero(group >= 0)
    picked = picked[np.argsort(group[picked], kind="stable")]
    g, y, h = group[picked], items.y[picked], items.height[picked]
    h = np.where(h > 0, h, 12.0)
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist() if len(g) else []
    nos, ys, n = [], [], 0
    for s, e in zip(starts, [*starts[1:], len(g)], strict=False):
        own, at, _ = _fold(y[s:e], h[s:e])
        nos += [n + k for k in own]
        ys += at
        n += max(own) + 1
    line, of, at = np.full(len(group), -1), np.zeros(n, np.int64), np.zeros(n)
    line[picked], of[nos], at[nos] = nos, g, ys
    return line, of, at


def _clustered(items: _Items, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The left-edge cluster of each item of ``used`` (numbered over all pages; -1: of none), and page, number there and x of each cluster.

    Buckets of left edges are merged from left to right while their mean lies within 36 units of the cluster's so far.
    """
    used = np.flatnonzero(used & ~np.isnan(items.x))
    bucket = np.floor(items.x[used] / EDGE_BUCKET + 0.5)
    order = used[np.lexsort((bucket, items.page[used]))]
    page, bucket = items.page[order], np.floor(items.x[order] / EDGE_BUCKET + 0.5)
    starts = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (bucket[1:] != bucket[:-1])]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(order)])
    sums = np.add.reduceat(items.x[order], starts) if len(order) else np.zeros(0)
    out, own = [], []  # page, number, sum of x, items
    for p, x, n in zip(page[starts].tolist(), sums.tolist(), sizes.tolist(), strict=True):
        last = out[-1] if out and out[-1][0] == p else None
        if last and x / n - last[2] / last[3] <= EDGE_BUCKET:
            last[2], last[3] = last[2] + x, last[3] + n
        else:
            out.append([p, last[1] + 1 if last else 0, x, n])
        own.append(len(out) - 1)
    cluster = np.full(len(items.page), -1)
    cluster[order] = np.repeat(np.array(own, np.int64), sizes)
    of, no, x, n = (np.array([c[i] for c in out]) for i in range(4))
    return cluster, of.astype(np.int64), no.astype(np.int32), x / n


def _struct(**columns) -> pa.StructArray:
    """Of columns of one length; what is not a number is null."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, list(columns))


def _listed(page: np.ndarray, pages: int, rows: pa.StructArray) -> pa.ListArray:
    """``rows``, in order of their page, as one list a page."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(pages + 1)), pa.int32()), rows)


def _edge_facts(xs: pa.Array) -> pa.Array:
    """Cluster and its x of each item of a page's left edges."""
    page = np.repeat(np.arange(len(xs)), xs.value_lengths().to_numpy(zero_copy_only=False))
    at = SimpleNamespace(page=page, x=xs.flatten().to_numpy(zero_copy_only=False))
    cluster, _, no, x = _clustered(at, np.ones(len(page), bool))
    none = cluster < 0
    rows = _struct(cluster=pa.array(np.r_[no, 0][cluster].astype(np.int32), mask=none), x=pa.array(np.r_[x, 0.0][cluster], mask=none))
    return _listed(page, len(xs), rows)


def edge_clusters(items: DataFrame) -> DataFrame:
    """LAY-02: ``items`` (see :func:`item_features`) that are not blank, with cluster (from 0, to the right) and cluster_x, the mean left edge."""
    whole = F.struct(*[F.col(c) for c in items.columns if c not in PAGE])
    found = F.arrow_udf(_edge_facts, "array<struct<cluster: int, x: double>>").asNondeterministic()
    known = items.filter("filled > 0 AND source_id IS NOT NULL AND page_number IS NOT NULL").groupBy(*PAGE).agg(F.collect_list(whole).alias("its"))
    met = known.withColumn("c", found(F.transform("its", lambda i: i["x"].cast("double"))))
    rows = met.select(*PAGE, F.explode(F.arrays_zip("its", "c")).alias("z")).filter("z.c.cluster IS NOT NULL")
    return rows.select(*[F.col(c) if c in PAGE else F.col(f"z.its.{c}").alias(c) for c in items.columns], F.col("z.c.cluster").alias("cluster"), F.col("z.c.x").alias("cluster_x"))


GRID_FACTS = "items: bigint, lines: bigint, long_lines: bigint, letters: bigint, digits: bigint, signs: bigint, chars: bigint, tokens: bigint, short: bigint, recurring_x: bigint, recurring_y: bigint, stability: double"


def _grid_facts(its: pa.Array) -> pa.Array:
    """Counts over the lines of each page and the 8-unit histograms of its items that are not blank."""
    i = _Items(its)
    line, of, _ = _lined(i, np.where(i.length > 0, i.page, -1))
    lines, page = _Groups(of, i.pages), _Groups(np.where(i.length > 0, i.page, -1), i.pages)
    long_lines = lines.count(_Groups(line, len(of)).sum(i.words) >= PROSE_LINE)
    solid = _Groups(np.where(i.solid, i.page, -1), i.pages)

    def bins(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Page and items of each bin."""
        b = np.floor(v[i.solid] / GRID_BUCKET + 0.5)
        pairs, n = np.unique(np.stack([i.page[i.solid], np.where(np.isnan(b), np.inf, b)]), axis=1, return_counts=True)
        return pairs[0].astype(np.int64), n

    (px, nx), (py, ny) = bins(i.x), bins(i.y)
    by_x, by_y = _Groups(px, i.pages), _Groups(py, i.pages)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = by_x.sum(nx) / by_x.count()
        stability = np.sqrt(by_x.sum((nx - mean[px]) ** 2) / by_x.count()) / mean
    sums = {c: page.sum(getattr(i, c)).astype(np.int64) for c in ("letters", "digits", "signs", "chars")}
    return _struct(
        items=page.count(), lines=lines.count(), long_lines=long_lines, **sums, tokens=solid.count(), short=solid.count(i.filled <= SHORT_TEXT),
        recurring_x=by_x.count(nx >= GRID_REPEATS), recurring_y=by_y.count(ny >= GRID_REPEATS), stability=stability,
    )


def grid_features(items: DataFrame) -> DataFrame:
    """LAY-11, LAY-20: (page, items, lines, long_lines, short, alpha, numeric, equations, recurring_x, recurring_y, stability, dense, kind, hypothesis).

    kind: a dense grid is math if long prose lines dominate it, else a table. Shares are of characters that are not
    blank. A page without items that are not empty has no row.
    """
    return _grids(_pages(items)).drop("its")


def _grids(pages: DataFrame) -> DataFrame:
    """``pages`` of :func:`_pages` with the columns of :func:`grid_features`."""
    out = pages.withColumn("g", F.arrow_udf(_grid_facts, f"struct<{GRID_FACTS}>").asNondeterministic()("its")).select(*PAGE, "its", "g.*").filter("items > 0")
    short = F.when(F.col("tokens") > 0, F.col("short") / F.col("tokens")).otherwise(0.0)
    xs, ys, long_, chars = F.col("recurring_x"), F.col("recurring_y"), F.col("long_lines"), F.greatest(F.col("chars"), F.lit(1))
    dense = (F.col("tokens") >= GRID_ITEMS) & (xs >= 3) & (ys >= 3) & (short >= GRID_SHARE)
    alpha = F.col("letters") / chars
    math = ((long_ >= 8) & (alpha >= 0.4)) | ((long_ >= 5) & (long_ / F.col("lines") >= 0.28) & (alpha >= 0.35))
    kind = F.when(~dense, "none").when(math, "math").otherwise("table")
    loose = (xs >= 3) & (ys >= 3) & (short >= GRID_SHARE) & (long_ <= 1)
    # a dense grid always has a kind, so what is left is a loose one
    hypothesis = F.when(kind == "math", "likely-math").when(kind == "table", "likely-grid").when(loose, "likely-grid").otherwise("unknown")
    return out.select(
        *PAGE, "its", "items", "lines", "long_lines", short.alias("short"), alpha.alias("alpha"), (F.col("digits") / chars).alias("numeric"),
        (F.col("signs") / chars).alias("equations"), "recurring_x", "recurring_y",
        F.coalesce("stability", F.lit(0.0)).alias("stability"), dense.alias("dense"), kind.alias("kind"), hypothesis.alias("hypothesis"),
    )


REGION_FACTS = "region: int, x: double, items: bigint, prose_lines: bigint, y_span: double, avg_width: double, median_width: double, short_noise: boolean, letters: bigint, left: double, right: double, top: double, bottom: double"


def _region_facts(its: pa.Array) -> pa.Array:
    """The clusters of each page's prose items (of all items, if none is prose) by left edge, with the lines that are nearest."""
    i = _Items(its)
    cluster, of, no, x = _clustered(i, i.prose_or_all())
    g = _Groups(cluster, len(of))
    n, top, bottom, left = g.count(), g.most(i.y), g.least(i.y), g.least(i.x)
    # the middle item by width
    order = np.lexsort((i.item, i.width, cluster))[np.count_nonzero(cluster < 0) :]
    median = i.width[order][np.cumsum(n) - n + n // 2] if len(of) else np.zeros(0)
    line, line_page, _ = _lined(i, np.where(i.length > 0, i.page, -1))
    lines = _Groups(line, len(line_page))
    anchor, words = lines.least(i.x), lines.sum(i.words)
    # each line with each cluster of its page: a page has few, at most one each 36 units
    first, last = np.searchsorted(of, line_page), np.searchsorted(of, line_page, "right")
    many = last - first
    at = np.repeat(np.arange(len(line_page)), many)
    met = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
    away = np.lexsort((met, np.abs(x[met] - anchor[at]), at))
    nearest = met[away[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])]] if len(at) else np.zeros(0, np.int64)
    nearest = nearest[words[many > 0] >= 2]
    rows = _struct(
        region=no, x=x, items=n, prose_lines=np.bincount(nearest, minlength=len(of)), y_span=top - bottom, avg_width=g.sum(i.width) / n, median_width=median,
        short_noise=g.count(i.filled <= SHORT_TEXT) / n >= 0.7, letters=g.sum(i.letters).astype(np.int64), left=left, right=g.most(i.right), top=top, bottom=bottom,
    )
    return _listed(of, i.pages, rows)


def regions(items: DataFrame) -> DataFrame:
    """LAY-11: the candidate regions of each page, one row a left-edge cluster of its prose items (of all items, if none is prose).

    (page, region, kind, x, items, prose_lines, y_span, avg_width, median_width, gutter_to_next, short_noise, letters, share, left,
    right, top, bottom). A visual line belongs to the cluster nearest to its leftmost item; gutter_to_next is the distance from the
    right edge to the next region's left one (negative where they overlap, null for the last).
    """
    found = F.arrow_udf(_region_facts, f"array<struct<{REGION_FACTS}>>").asNondeterministic()
    page = _pages(items).select(*PAGE, found("its").alias("of"))
    total = F.greatest(F.aggregate("of", F.lit(0).cast("long"), lambda n, r: n + r["letters"]), F.lit(1))
    page = page.select(*PAGE, F.array_sort(F.transform("of", lambda r: F.struct(r["left"], r["region"], r.alias("r")))).alias("of"), total.alias("total"))
    after = F.transform("of", lambda r, i: F.struct(r["r"].alias("r"), F.try_element_at("of", i + 2)["r"]["left"].alias("next")))
    out = page.select(*PAGE, "total", F.explode(after).alias("z")).select(*PAGE, "total", "z.next", "z.r.*")
    return out.select(
        *PAGE, "region", F.when(F.col("letters") >= MIN_LETTERS, "prose").otherwise("unknown").alias("kind"), "x", "items",
        "prose_lines", "y_span", "avg_width", "median_width", (F.col("next") - F.col("right")).alias("gutter_to_next"),
        "short_noise", "letters", (F.col("letters") / F.col("total")).alias("share"), "left", "right", "top", "bottom",
    )


def gutter_crossings(items: DataFrame) -> DataFrame:
    """LAY-11: (page, line, items, left_x, right_x, mid, max_width, overflow, gap): the visual lines that cross the middle of their page.

    A line crosses if it has items on both sides of the middle, or an item too wide for one column that reaches over it, or
    two neighbours with a gap of 20 units around it. Pages without a width have none.
    """
    lined = visual_lines(item_features(items).filter("page_width > 0"), carry=["right", "width", "page_width", "overflow", "on_left", "on_right"])
    mid, order = F.col("page_width") / 2, Window.partitionBy(*PAGE, "line").orderBy("x", "item")
    after = F.lead("x").over(order)
    lined = lined.withColumn("gap", F.coalesce((F.col("right") <= mid) & (after >= mid) & (after - F.col("right") >= OVERFLOW_REACH), F.lit(False)))
    per = lined.groupBy(*PAGE, "line").agg(
        F.count("*").alias("items"), F.min("x").alias("left_x"), F.max("right").alias("right_x"), F.first(mid).alias("mid"),
        F.max(F.coalesce("width", F.lit(0.0))).alias("max_width"), F.max("overflow").alias("overflow"), F.max("gap").alias("gap"),
        F.max("on_left").alias("l"), F.max("on_right").alias("r"),
    )
    return per.filter("(l AND r) OR overflow OR gap").drop("l", "r")


def prose_columns(items: DataFrame) -> DataFrame:
    """LAY-12: (page, kind, clusters, share_top2, gutter, y_overlap, width_distrust, cross_risk, two_dominant, two_independent, refuse_single, split_x).

    The two clusters with most letters are columns if they stand far enough apart on both sides of the page, hold enough items,
    letters and lines of four words each, and overlap in height. Where items reach over the middle, a page is refused as
    a single column without two proven ones. A page of blank items has no row.
    """
    return _prose_columns(_pages(items)).drop("its", "f")


COLUMN_FACTS = (
    "page_width: double, solid: bigint, width_distrust: boolean, cross_risk: boolean, rights: bigint, left_prose: bigint, right_prose: bigint, left_lines: bigint, right_lines: bigint, spread: double,"
    " pairs: bigint, x1: double, x2: double, clusters: array<struct<mass: bigint, cluster: int, x: double, n: bigint, top: double, bottom: double, long: bigint>>"
)


def _column_facts(its: pa.Array) -> pa.Array:
    """What the rules on columns ask of each page's items that are not blank: sides, lines, clusters of prose, and the clusters of two items and more."""
    i = _Items(its)
    view = lambda which: np.where(i.solid & which, i.page, -1)
    whole = _Groups(view(True), i.pages)
    line, of, _ = _lined(i, view(True))
    lines, per_page = _Groups(line, len(of)), _Groups(of, i.pages)
    multi = i.long_words >= 2
    both = lines.any(i.on_left & multi) & lines.any(i.on_right & multi)
    risk = per_page.any(both | (lines.any(i.overflow) & lines.any(i.on_right)))
    starts = lines.least(i.x)

    def long_lines(group: np.ndarray, n: int) -> np.ndarray:
        line, of, _ = _lined(i, group)
        return _Groups(of, n).count(_Groups(line, len(of)).sum(i.words) >= PROSE_LINE)

    cluster, page, no, x = _clustered(i, i.prose_or_all())
    g = _Groups(cluster, len(page))
    clusters = _struct(
        mass=g.sum(i.letters).astype(np.int64), cluster=no, x=x, n=g.count(), top=g.most(i.y), bottom=g.least(i.y), long=long_lines(cluster, len(page)),
    )
    all_of, all_page, _, all_x = _clustered(i, i.solid)
    pairs = _Groups(np.where(_Groups(all_of, len(all_page)).count() >= 2, all_page, -1), i.pages)
    width = whole.most(i.page_width)
    without = np.isnan(width)
    flag = lambda v: pa.array(v, mask=without)
    return _struct(
        page_width=width, solid=whole.count(), width_distrust=flag(whole.any(i.overflow)), cross_risk=flag(risk), rights=whole.count(i.on_right),
        left_prose=whole.count(i.on_left & i.prose), right_prose=whole.count(i.on_right & i.prose), left_lines=long_lines(view(i.on_left), i.pages), right_lines=long_lines(view(i.on_right), i.pages),
        spread=per_page.most(starts) - per_page.least(starts), pairs=pairs.count(), x1=pairs.least(all_x), x2=pairs.most(all_x), clusters=_listed(page, i.pages, clusters),
    )


def _prose_columns(pages: DataFrame) -> DataFrame:
    """:func:`prose_columns` of :func:`_pages`, with their items (its) and counts (f)."""
    facts = F.arrow_udf(_column_facts, f"struct<{COLUMN_FACTS}>").asNondeterministic()
    out = _grids(pages).select(*PAGE, "its", "kind").withColumn("f", facts("its")).filter("f.solid > 0 AND size(f.clusters) > 0")
    total = F.greatest(F.aggregate("f.clusters", F.lit(0).cast("long"), lambda s, c: s + c["mass"]), F.lit(1))
    heavy = F.slice(F.array_sort(F.transform("f.clusters", lambda c: F.struct((-c["mass"]).alias("m"), c["cluster"], c.alias("c")))), 1, 2)
    put = lambda c: F.struct(c["x"], c["n"], c["mass"], c["top"], c["bottom"], c["long"], (c["mass"] / total).alias("share"))
    out = out.select(
        *PAGE, "its", "kind", "f", *[F.col(f"f.{c}").alias(c) for c in ("page_width", "width_distrust", "cross_risk", "rights", "left_prose", "right_prose", "left_lines", "right_lines")],
        F.size("f.clusters").cast("long").alias("clusters"), F.array_sort(F.transform(heavy, lambda h: put(h["c"]))).alias("two"),
    )
    pair = F.size("two") == 2
    a, b = F.col("two")[0], F.try_element_at("two", F.lit(2))
    width, no_table = F.col("page_width"), F.col("kind") != "table"
    span = lambda c: c["top"] - c["bottom"]
    overlap = F.least(a["top"], b["top"]) - F.greatest(a["bottom"], b["bottom"])
    strong = lambda c: (c["n"] >= MIN_ITEMS) & (c["mass"] >= MIN_LETTERS) & (c["long"] >= MIN_LINES) & (c["share"] >= MIN_SHARE) & (span(c) >= MIN_SPAN)
    dominant = (
        pair & no_table & (b["x"] - a["x"] >= F.greatest(F.lit(2.0 * GUTTER), width * MIN_SEPARATION)) & (a["x"] <= width * 0.45) & (b["x"] >= width * 0.45)
        & strong(a) & strong(b) & (overlap > 0) & (overlap >= MIN_OVERLAP * F.least(span(a), span(b))) & (a["share"] + b["share"] >= MIN_TOP2)
    )
    out = out.withColumn("two_dominant", F.coalesce(dominant, F.lit(False)))
    independent = F.col("two_dominant") | (
        no_table & F.col("width_distrust") & (F.col("rights") >= 2) & (F.col("left_prose") >= 2) & (F.col("left_lines") >= MIN_LINES)
        & ((F.col("right_prose") >= 2) | (F.col("right_lines") >= MIN_LINES))
    )
    refuse = no_table & (independent | F.col("cross_risk"))
    return out.select(
        *PAGE, "its", "f", "page_width", "kind", "clusters", F.aggregate("two", F.lit(0.0), lambda s, c: s + c["share"]).alias("share_top2"),
        F.when(pair, b["x"] - a["x"]).alias("gutter"), F.when(pair, overlap).otherwise(0.0).alias("y_overlap"), "width_distrust", "cross_risk", "two_dominant",
        independent.alias("two_independent"), refuse.alias("refuse_single"),
        F.when(F.col("two_dominant"), (a["x"] + b["x"]) / 2).when(refuse, width / 2).alias("split_x"),
    )


SIDES = tuple(f"{name}_{side}" for name in ("split", "pair", "mid") for side in "lr")
SIDE_FACTS = ", ".join(f"{v}: struct<lines: bigint, top: double, bottom: double, prose: boolean>" for v in SIDES)


def _side_facts(its: pa.Array, split_x: pa.Array, pair_split: pa.Array, page_width: pa.Array) -> pa.Array:
    """The lines of both sides of each page, for each way of cutting it: at either split, or around the middle. No line is no side."""
    i = _Items(its)
    at = lambda v: v.to_numpy(zero_copy_only=False).astype(float)[i.page]
    mid = at(page_width) / 2
    cuts = {name: (i.x < c, i.x >= c) for name, c in (("split", at(split_x)), ("pair", at(pair_split)))} | {"mid": (i.right < mid - GUTTER / 2, i.x > mid + GUTTER / 2)}
    out = {}
    for name, (lft, rgt) in cuts.items():
        line, of, y = _lined(i, np.where(i.solid & lft, 2 * i.page, np.where(i.solid & rgt, 2 * i.page + 1, -1)))
        views = _Groups(of, 2 * i.pages)
        n, top, bottom, prose = views.count(), views.most(y), views.least(y), views.any(_Groups(line, len(of)).sum(i.tokens) >= PROSE_LINE)
        for k, side in enumerate("lr"):
            out[f"{name}_{side}"] = _struct(lines=n[k::2], top=top[k::2], bottom=bottom[k::2], prose=prose[k::2])
    return _struct(**out)


def reading_orders(items: DataFrame) -> DataFrame:
    """LAY-04: (page, kind, two_dominant, refuse_single, reading_order, split_x): single-column, two-column or uncertain.

    Tables are uncertain. Columns by :func:`prose_columns`, or by the only two clusters of two items and more, count as two if both have lines
    of prose and overlap; a page that is refused as one column, or whose lines start in both halves, is uncertain.
    """
    page = _prose_columns(_pages(items))
    x1, x2, width = F.col("f.x1"), F.col("f.x2"), F.col("page_width")
    paired = (F.col("f.pairs") == 2) & (x2 - x1 >= F.greatest(F.lit(2.0 * GUTTER), width * MIN_SEPARATION)) & (x1 <= width * 0.45) & (x2 >= width * 0.45)
    page = page.select(*PAGE, "its", "page_width", "kind", "two_dominant", "refuse_single", "split_x", F.col("f.spread").alias("spread"), F.when(paired, (x1 + x2) / 2).alias("pair_split"))
    sides = F.arrow_udf(_side_facts, f"struct<{SIDE_FACTS}>").asNondeterministic()
    page = page.withColumn("v", sides("its", "split_x", "pair_split", "page_width"))
    get = lambda k: F.col(f"v.{k}")

    def confident(name: str) -> Column:
        a, b = get(f"{name}_l"), get(f"{name}_r")
        overlap = F.least(a["top"], b["top"]) - F.greatest(a["bottom"], b["bottom"])
        short = F.least(a["top"] - a["bottom"], b["top"] - b["bottom"])
        good = (a["lines"] >= MIN_LINES) & (b["lines"] >= MIN_LINES) & a["prose"] & b["prose"] & (short >= MIN_SPAN) & (overlap > 0) & (overlap >= MIN_OVERLAP * short)
        return F.coalesce(good, F.lit(False))

    halved = F.coalesce((get("mid_l")["lines"] >= 2) & (get("mid_r")["lines"] >= 2) & (F.col("spread") > F.col("page_width") * 0.35), F.lit(False))
    by_pair = F.col("pair_split").isNotNull() & confident("pair")
    order = (
        F.when(F.col("kind") == "table", "uncertain").when(F.col("two_dominant"), F.when(confident("split"), "two-column").otherwise("uncertain"))
        .when(by_pair, "two-column").when(F.col("refuse_single") | halved, "uncertain").otherwise("single-column")
    )
    split = F.when(order == "two-column", F.when(F.col("two_dominant"), F.col("split_x")).otherwise(F.col("pair_split")))
    return page.select(*PAGE, "kind", "two_dominant", "refuse_single", order.alias("reading_order"), split.alias("split_x"))
