"""Page layout: visual lines, columns, grids, repeated bands, page text with an offset map, blocks, validators.

Order-dependent grouping of a page's items is a small sequential task, done page by page in Arrow batches
(``page_layout``); whatever compares pages or documents is relational.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------
LINE_TOLERANCE, EDGE_BUCKET, GRID_BUCKET = 0.45, 36, 8
GRID_MIN, GRID_REPEAT, GRID_SHORT, GRID_SHARE = 12, 3, 12, 0.7
GRID_MATH = "[=+∑∫√≤≥±×÷^]"
BAND = 72.0
SPACES = re.compile(r"\s+")
LIST_MARKER = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
CAPTION = re.compile(r"^\s*(?:figure|fig\.|table|chart)\s*\d", re.I)
SECTION = re.compile(r"^\s*(?:\d+(?:\.\d+)*\.?\s+[A-Z]|(?:abstract|introduction|conclusion|references|appendix)\b)", re.I)
LIMITS = {
    "bytes": 12 << 20, "pages": 80, "chars": 250_000, "chunks": 200, "context_bytes": 40 << 20, "context_pages": 400, "context_chars": 1_500_000,
    "context_chunks": 800, "context_files": 24,
}
# ---------------------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Item:
    no: int
    text: str
    x: float
    y: float
    width: float
    height: float

    @property
    def size(self) -> float:
        return self.height if self.height > 0 else 12.0


@dataclass
class Line:
    y: float
    height: float
    items: list[Item] = field(default_factory=list)

    @cached_property
    def text(self) -> str:
        """Read once the line has all its items."""
        return SPACES.sub(" ", " ".join([i.text for i in self.items])).strip()

    @cached_property
    def left(self) -> float:
        return min(i.x for i in self.items)

    @property
    def right(self) -> float:
        return max(i.x + i.width for i in self.items)


def visual_lines(items: list[Item]) -> list[Line]:
    """LAY-01: items, from the top, join the first line whose running mean height is near; lines from the top down."""
    lines: list[Line] = []
    for item in sorted((i for i in items if i.text), key=lambda i: (-i.y, i.x)):
        line = next((k for k in lines if abs(k.y - item.y) <= max(k.height, item.size) * LINE_TOLERANCE), None)
        if line is None:
            lines.append(line := Line(item.y, item.size))
        else:
            line.y += (item.y - line.y) / (len(line.items) + 1)
            line.height = max(line.height, item.size)
        line.items.append(item)
    for line in lines:
        line.items.sort(key=lambda i: i.x)
    return sorted(lines, key=lambda k: -k.y)


def _round(v: float) -> int:
    """Halves up, as the engine's rounding does."""
    return int(v + 0.5) if v >= 0 else -int(-v + 0.5 - 1e-12)


def edge_clusters(items: list[Item]) -> list[list[Item]]:
    """LAY-02: items by left edge in buckets of 36 units; buckets whose means are that near are one cluster."""
    buckets: dict[int, list[Item]] = {}
    for i in items:
        if i.text.strip():
            buckets.setdefault(_round(i.x / EDGE_BUCKET), []).append(i)
    mean = lambda c: sum(i.x for i in c) / len(c)
    out: list[list[Item]] = []
    for _, bucket in sorted(buckets.items()):
        if out and mean(bucket) - mean(out[-1]) <= EDGE_BUCKET:
            out[-1] = out[-1] + bucket
        else:
            out.append(bucket)
    return out


def is_grid(items: list[Item]) -> bool:
    """LAY-03: many short items whose places repeat in both directions."""
    if len(items) < GRID_MIN:
        return False
    real = [i for i in items if i.text.strip()]
    if len(real) < GRID_MIN:
        return False
    repeats = lambda values: sum(n >= GRID_REPEAT for n in Counter(_round(v / GRID_BUCKET) for v in values).values())
    short = sum(len(i.text.strip()) <= GRID_SHORT for i in real) / len(real)
    return repeats(i.x for i in real) >= 3 and repeats(i.y for i in real) >= 3 and short >= GRID_SHARE


def grid_kind(items: list[Item]) -> str:
    """LAY-20: none, table or math, by the symbols of a grid's items."""
    if not is_grid(items):
        return "none"
    texts = [i.text.strip() for i in items if i.text.strip()]
    math = sum(bool(re.search(GRID_MATH, t)) or len(t) <= 2 and t.isalpha() for t in texts) / len(texts)
    return "math" if math >= 0.5 else "table"


def columns(items: list[Item], width: float) -> tuple[str, list[Line]]:
    """LAY-04, LAY-12: (reading order, lines in that order).

    Two clusters of left edges that each hold a fair share of the letters, stand apart by a gutter and run
    beside each other make two columns; where a line reaches over the gap the order is uncertain.
    """
    lines = visual_lines(items)
    if is_grid(items):
        return "uncertain", lines
    clusters = edge_clusters(items)
    if len(clusters) < 2:
        return "single-column", lines
    letters = lambda c: sum(sum(ch.isalpha() for ch in i.text) for i in c)
    big = sorted(clusters, key=letters, reverse=True)[:2]
    total = letters(items) or 1
    if all(letters(c) / total >= 0.18 and len(c) >= 2 for c in big):
        left, right = sorted(big, key=lambda c: min(i.x for i in c))
        gap = min(i.x for i in right) - min(i.x for i in left)
        beside = min(max(i.y for i in left), max(i.y for i in right)) - max(min(i.y for i in left), min(i.y for i in right))
        if gap >= max(56.0, 0.18 * width) and beside > 0:
            split = min(i.x for i in right)
            a = [i for i in items if i.x < split - 1e-9]
            b = [i for i in items if i.x >= split - 1e-9]
            crossing = sum(i.x + i.width > split for i in a)
            ordered = visual_lines(a) + visual_lines(b)
            return ("two-column" if crossing == 0 and len(visual_lines(a)) >= 2 and len(visual_lines(b)) >= 2 else "uncertain"), ordered
    return "single-column", lines


def band(line: Line, height: float) -> str:
    """Top or bottom 72 units of a page, or body."""
    return "top" if line.y >= height - BAND else "bottom" if line.y <= BAND else "body"


def page_text(lines: list[Line]) -> tuple[str, list[tuple]]:
    """LAY-05, CHK-14: text and its map: (kind, item, source start, source end, start, end); a word cut by a hyphen at a
    line's end is joined if the next line goes on in lower case, other breaks are a newline, items a space apart."""
    text, segments = "", []

    def add(kind: str, piece: str, item: int = -1, start: int = 0) -> None:
        nonlocal text
        if piece:
            segments.append((kind, item, start, start + len(piece), len(text), len(text) + len(piece)))
            text += piece

    for no, line in enumerate(lines):
        follows = lines[no + 1].items[0].text if no + 1 < len(lines) else ""
        for k, item in enumerate(line.items):
            if k and text and not text[-1].isspace() and not item.text[:1].isspace():
                add("inserted", " ")
            last = k == len(line.items) - 1
            cut = last and re.search(r"[A-Za-z]-\Z", item.text) and re.match("[a-z]", follows)
            add("source", item.text[:-1] if cut else item.text, item.no)
            if last and follows and not cut:
                add("inserted", "\n")
    return text, segments


def map_errors(text: str, items: dict[int, str], segments: list[tuple]) -> list[str]:
    """LAY-13: what is wrong with a page's map; nothing if every character is covered once and equals its source."""
    errors, at = [], 0
    for kind, item, s0, s1, n0, n1 in sorted(segments, key=lambda s: s[4]):
        if n0 != at or n1 <= n0:
            errors.append(f"gap, overlap or empty segment at {n0}")
        at, piece = n1, text[n0:n1]
        if kind == "inserted":
            errors += [] if piece in (" ", "\n") else [f"inserted text at {n0}"]
        elif item not in items:
            errors.append(f"missing item {item}")
        elif items[item][s0:s1] != piece:
            errors.append(f"item {item} differs")
    return errors + ([] if at == len(text) else ["the end is not covered"])


def source_ranges(segments: list[tuple], start: int, end: int) -> list[tuple[int, int, int]]:
    """SCL-12: (item, from, to) of the source characters behind [start, end) of a page's text."""
    out = []
    for kind, item, s0, _, n0, n1 in segments:
        a, b = max(start, n0), min(end, n1)
        if kind == "source" and a < b:
            out.append((item, s0 + a - n0, s0 + b - n0))
    return out


def source_text(items: dict[int, str], ranges: list[tuple[int, int, int]]) -> str:
    """SCL-11: the text of item ranges, joined by spaces."""
    return " ".join(items[i][a:b] for i, a, b in ranges)


def blocks(lines: list[Line], width: float, furniture: set[str] = frozenset(), grid: str = "none") -> list[tuple[str, list[int]]]:
    """LAY-09, LAY-17, LAY-18: (kind, line numbers): furniture, captions, lists with their heading, headings, paragraphs; a table's lines are one block."""
    kind: dict[int, str] = {}
    groups: list[tuple[str, list[int]]] = []
    words = lambda t: len(t.split())
    gap = lambda a, b: a.y - b.y

    def put(k: str, nos: list[int]) -> None:
        groups.append((k, nos))
        kind.update(dict.fromkeys(nos, k))

    for i, line in enumerate(lines):
        if line.text in furniture:
            put("furniture", [i])
    is_caption = lambda x: bool(CAPTION.match(x.text)) and words(x.text) >= 2 and len(x.text) >= 10
    for i, line in enumerate(lines):
        if i not in kind and is_caption(line):
            put("caption", [i])
    if grid != "none":
        put(grid, [i for i in range(len(lines)) if i not in kind])
        return sorted((g for g in groups if g[1]), key=lambda g: g[1][0])
    is_marker = lambda x: bool(LIST_MARKER.match(x.text)) and len(LIST_MARKER.sub("", x.text).strip()) >= 2
    i = 0
    while i < len(lines):
        if i in kind or not is_marker(lines[i]):
            i += 1
            continue
        first, run, j = lines[i], [i], i + 1
        while j < len(lines) and j not in kind:
            x, above = lines[j], lines[j - 1]
            marked = is_marker(x) and abs(x.left - first.left) <= 14 and gap(above, x) <= 2.2 * x.height
            goes_on = not is_marker(x) and 6 <= x.left - first.left <= 44 and gap(above, x) <= 1.8 * x.height
            if not (marked or goes_on):
                break
            run.append(j)
            j += 1
        head = i - 1
        if head >= 0 and head not in kind and re.search(r":\s*\Z", lines[head].text) and 4 <= len(lines[head].text) <= 80 and gap(lines[head], first) <= 1.8 * lines[head].height:
            run.insert(0, head)
        put("list", run)
        i = j

    def is_heading(i: int) -> bool:
        x, above = lines[i], lines[i - 1] if i else None
        if not 4 <= len(x.text) <= 88 or words(x.text) > 10:
            return False
        if SECTION.match(x.text) and words(x.text) <= 8:
            return True
        after = i + 1 < len(lines) and words(lines[i + 1].text) >= 3
        return above is not None and x.height >= 1.25 * above.height and gap(above, x) > 1.45 * above.height and after and words(x.text) <= 8

    for i in range(len(lines)):
        if i not in kind and is_heading(i):
            put("heading", [i])

    def joins(a: Line, b: Line) -> bool:
        mid, top = width / 2, max(a.height, b.height)
        apart = width > 0 and ((a.left < mid - 14 and b.left > mid + 14) or (b.left < mid - 14 and a.left > mid + 14))
        near = gap(a, b) <= 1.65 * top and abs(a.height - b.height) <= 0.55 * top
        return not apart and near and (abs(b.left - a.left) <= 10 or 0 < b.left - a.left <= 22)

    run: list[int] = []
    for i in range(len(lines) + 1):
        if run and (i == len(lines) or i in kind or not joins(lines[run[-1]], lines[i])):
            put("paragraph", run)
            run = []
        if i < len(lines) and i not in kind:
            run = [*run, i]
    return sorted(groups, key=lambda g: g[1][0])


#: What a byte is: white space, a letter, a digit, a capital, the first byte of a character.
_SPACE, _LETTER, _DIGIT, _CAPITAL, _FIRST = 1, 2, 4, 8, 16
_BYTES = np.array([
    (_SPACE if b == 32 or 9 <= b <= 13 else 0) | (_LETTER if chr(b & ~32) in string.ascii_uppercase and 65 <= b < 128 else 0) | (_DIGIT if 48 <= b <= 57 else 0)
    | (_CAPITAL if 65 <= b <= 90 else 0) | (_FIRST if b & 0xC0 != 0x80 else 0) for b in range(256)], dtype=np.uint8)
_COUNTS = ("tokens", "solid", "words", "letters", "digits", "short", "capitals")


def _count_bytes(texts: list[str]) -> np.ndarray:
    """One row of ``_COUNTS`` a text, by the classes of the bytes of all texts at once; tokens are what stands between white space."""
    parts = [t.encode() + b"\n" for t in texts]
    kind = _BYTES[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    per_text = lambda mask: np.add.reduceat(mask, at, dtype=np.int64)
    solid, letter, first = kind & _SPACE == 0, kind & _LETTER != 0, kind & _FIRST != 0
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    starts, token = np.flatnonzero(start), np.cumsum(start, dtype=np.int32) - 1
    length = np.bincount(token[solid & first], minlength=len(starts))
    pair = np.zeros(len(starts), dtype=bool)
    pair[token[:-1][letter[:-1] & letter[1:]]] = True
    of_tokens = lambda mask: np.bincount(np.searchsorted(at, starts[mask], "right") - 1, minlength=len(parts))
    return np.stack([per_text(start), per_text(solid & first), of_tokens(pair), per_text(letter), per_text(kind & _DIGIT != 0), of_tokens(length <= 2), per_text(start & (kind & _CAPITAL != 0))], axis=1)


def _text_counts(text: pd.Series) -> pd.DataFrame:
    rows, some, size = [], [], 0
    for t in text:
        some.append(t)
        size += len(t)
        if size >= 1 << 20:
            rows.append(_count_bytes(some))
            some, size = [], 0
    if some:
        rows.append(_count_bytes(some))
    return pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, len(_COUNTS)), dtype=np.int64), columns=list(_COUNTS))


def line_features(text: Column) -> Column:
    """LAY-10: words, shares of letters, digits, punctuation and short words, mean length, and the prose score in [0, 1]; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    c = F.pandas_udf(_text_counts, ", ".join(f"{c} long" for c in _COUNTS))(text)
    n, chars = F.greatest(c["tokens"], F.lit(1)), F.greatest(c["solid"], F.lit(1))
    words, alpha = c["words"], c["letters"] / chars
    short, length = c["short"] / n, c["solid"] / n
    one = F.lit(1.0)
    prose = 0.35 * F.least(one, words / 8) + 0.25 * alpha + (0.2 * (1 - short) + 0.2 * F.least(one, length / 5))
    return F.struct(
        words.alias("words"), alpha.alias("alpha"), (c["digits"] / chars).alias("numeric"),
        (F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}_ \x09-\x0D]+", "")) / chars).alias("punctuation"), short.alias("short"), length.alias("length"),
        (c["capitals"] / n).alias("capitalised"), F.greatest(F.lit(0.0), F.least(one, prose)).alias("prose"),
    )


def grid_kinds(items: DataFrame) -> DataFrame:
    """LAY-03, LAY-20 for any number of pages: (source_id, page_number, kind) of items (source_id, page_number, text, x, y).

    Counts alone are grouped, so a page of any number of items is no array; a page whose items are all blank has no row.
    """
    page, text = ["source_id", "page_number"], F.trim("text")
    bin_of = lambda c: F.floor(F.col(c) / GRID_BUCKET + 0.5)
    math = text.rlike(GRID_MATH) | text.rlike(r"^\p{L}{1,2}$")
    real = items.filter(text != "").select(
        *page, F.explode(F.array(F.struct(F.lit("x").alias("axis"), bin_of("x").alias("bin")), F.struct(F.lit("y").alias("axis"), bin_of("y").alias("bin")))).alias("at"),
        (F.length(text) <= GRID_SHORT).cast("long").alias("short"), math.cast("long").alias("math"))
    bins = real.groupBy(*page, "at").agg(F.count("*").alias("n"), F.sum("short").alias("short"), F.sum("math").alias("math"))
    on = lambda axis: F.col("at.axis") == axis
    total = lambda c: F.sum(F.when(on("x"), F.col(c)))
    repeats = lambda axis: F.count_if(on(axis) & (F.col("n") >= GRID_REPEAT))
    per = bins.groupBy(*page).agg(total("n").alias("n"), total("short").alias("short"), total("math").alias("math"), repeats("x").alias("xs"), repeats("y").alias("ys"))
    grid = (F.col("n") >= GRID_MIN) & (F.col("xs") >= 3) & (F.col("ys") >= 3) & (F.col("short") / F.col("n") >= GRID_SHARE)
    return per.select(*page, F.when(~grid, "none").when(F.col("math") / F.col("n") >= 0.5, "math").otherwise("table").alias("kind"))


LAYOUT_SCHEMA = {
    "text": "string", "segments": "array<struct<kind:string,item:int,source_start:int,source_end:int,norm_start:int,norm_end:int>>",
    "lines": "array<struct<text:string,y:double,left:double,height:double,band:string>>", "blocks": "array<struct<kind:string,lines:array<int>>>",
}
_ARROW = {
    "segments": [("kind", pa.string()), ("item", pa.int32()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("norm_start", pa.int32()), ("norm_end", pa.int32())],
    "lines": [("text", pa.string()), ("y", pa.float64()), ("left", pa.float64()), ("height", pa.float64()), ("band", pa.string())],
    "blocks": [("kind", pa.string()), ("lines", pa.list_(pa.int32()))],
}


def _lists(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of structs, built column by column."""
    flat = list(zip(*[r for row in rows for r in row], strict=True)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, fields, strict=True)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


def page_layout(pages: DataFrame, parts: tuple[str, ...] = tuple(LAYOUT_SCHEMA)) -> DataFrame:
    """LAY-01..05, 08, 09: one row a page of (source_id, page_number, width, height, items array<struct<str,x,y,width,height>>).

    ``parts`` names the columns after reading_order that are wanted; the others are neither worked out nor returned. Items come and
    results go as Arrow columns, so a page costs its rules and not the making of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = dict(zip(b.schema.names, b.columns, strict=True))
            flat = of["items"].flatten()
            text, *places = (flat.field(c).to_pylist() for c in ("str", "x", "y", "width", "height"))
            orders, found, at = [], {c: [] for c in parts}, 0
            for n, width, height in zip(of["items"].value_lengths().to_pylist(), of["width"].to_pylist(), of["height"].to_pylist(), strict=True):
                to = at + (n or 0)
                items = [Item(i, t or "", *p) for i, (t, *p) in enumerate(zip(text[at:to], *(c[at:to] for c in places), strict=True))]
                at = to
                order, lines = columns(items, width)
                orders.append(order)
                if "text" in found or "segments" in found:
                    said, segments = page_text(lines) if order != "uncertain" else ("", [])
                    for c, v in (("text", said), ("segments", segments)):
                        if c in found:
                            found[c].append(v)
                if "lines" in found:
                    found["lines"].append([(k.text, k.y, k.left, k.height, band(k, height)) for k in lines])
                if "blocks" in found:
                    found["blocks"].append(blocks(lines, width, grid=grid_kind(items)))
            out = [_lists(v, _ARROW[c]) if c in _ARROW else pa.array(v, pa.string()) for c, v in found.items()]
            yield pa.RecordBatch.from_arrays([of["source_id"], of["page_number"], pa.array(orders, pa.string()), *out], ["source_id", "page_number", "reading_order", *parts])

    number = F.col("items").cast("array<struct<str:string,x:double,y:double,width:double,height:double>>")
    rows = pages.select(F.col("source_id").cast("string"), F.col("page_number").cast("int"), F.col("width").cast("double"), F.col("height").cast("double"), number.alias("items"))
    return rows.mapInArrow(run, "source_id string, page_number int, reading_order string, " + ", ".join(f"{c} {LAYOUT_SCHEMA[c]}" for c in parts))


def repeated_bands(layout: DataFrame) -> DataFrame:
    """LAY-06: (source_id, band, text) of top and bottom lines on at least half of a document's pages, and on two."""
    pages = layout.groupBy("source_id").agg(F.count_distinct("page_number").alias("pages"))
    rows = layout.select("source_id", "page_number", F.explode("lines").alias("l")).filter("l.band != 'body' and l.text != ''")
    n = rows.groupBy("source_id", F.col("l.band").alias("band"), F.col("l.text").alias("text")).agg(F.count_distinct("page_number").alias("n"))
    return n.join(pages, "source_id").filter("n >= 2 and n >= 0.5 * pages").select("source_id", "band", "text")


def furniture(layout: DataFrame, hint: str = "free of charge|confidential|all rights reserved|copyright") -> DataFrame:
    """LAY-07: (source_id, text) of lines on three pages or more: half of them, or fewer with a hint and a steady place."""
    pages = layout.groupBy("source_id").agg(F.count_distinct("page_number").alias("total"))
    rows = layout.select("source_id", "page_number", F.explode("lines").alias("l")).filter("l.text != ''")
    g = rows.groupBy("source_id", F.col("l.text").alias("text")).agg(F.count_distinct("page_number").alias("pages"), (F.max("l.y") - F.min("l.y")).alias("spread"))
    g = g.join(pages, "source_id").withColumns({"share": F.col("pages") / F.col("total"), "hint": F.lower("text").rlike(hint)})
    rule = (F.col("share") >= 0.5) | (F.col("hint") & (F.col("spread") < 12) & (F.col("pages") >= 8)) | ((F.col("share") >= 0.4) & F.col("hint") & (F.col("spread") < 48))
    return g.filter((F.col("pages") >= 3) & rule).select("source_id", "text")


def map_faults(text: Column, segments: Column) -> Column:
    """LAY-13, LAY-16: where, in one page's map, a segment does not begin where the one before it ends, or the map does not end with the text.

    ``segments`` in any order; a page's map is an array of its row, so pages are not taken apart.
    """
    s = F.array_sort(F.transform(segments, lambda x: F.struct(x["norm_start"].alias("a"), x["norm_end"].alias("z"))))
    before = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["z"]))
    last = F.size(s) - 1
    bad = lambda x, i: (x["a"] != F.get(before, i)) | (x["z"] <= x["a"]) | ((i == last) & (x["z"] != F.length(text)))
    marks = F.transform(s, lambda x, i: F.when(bad(x, i), x["a"]))
    return F.filter(marks, lambda x: x.isNotNull())


def mapping_violations(layout: DataFrame) -> DataFrame:
    """LAY-13, LAY-16: (source_id, page_number, at) of each of :func:`map_faults`."""
    return layout.select("source_id", "page_number", F.explode(map_faults(F.col("text"), F.col("segments"))).alias("at"))


def readiness(size: Column, pages: Column, chars: Column) -> Column:
    """SRC-19, LAY-14: refused over a limit, scanned without characters, else ready."""
    over = (size > LIMITS["bytes"]) | (pages > LIMITS["pages"]) | (chars > LIMITS["chars"])
    return F.when(over, "refused").when(chars == 0, "scanned").otherwise("ready")


def chunk_units(sizes: Column, cap: int = 1200) -> Column:
    """LAY-21: how many chunks blocks of these sizes make."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + F.ceil(x / cap))


def split_to_cap(text: str, cap: int = 1200) -> list[tuple[int, int]]:
    """CHK-08: pieces of at most ``cap`` characters, cut after the last space (from the ninth character on)."""
    out, start = [], 0
    while start < len(text):
        end = len(text)
        if end - start > cap:
            space = text.rfind(" ", start + 8, start + cap)
            end = space + 1 if space >= 0 else start + cap
        if text[start:end].strip():
            out.append((start, end))
        start = end
    return out


def document_chunks(layout: DataFrame, cap: int = 1200) -> DataFrame:
    """CHK-06, CHK-12: (source_id, page_number, start_offset, end_offset, text) of every page's paragraphs, packed into sentences up to ``cap``; pages are not crossed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples(index=False):
                start, at = 0, 0
                for m in re.finditer(r"[.!?](?=\s|\Z)\s*|\Z", p.text or ""):
                    if m.end() - start > cap and at > start:
                        out += [(p.source_id, p.page_number, start + a, start + z, p.text[start + a : start + z]) for a, z in split_to_cap(p.text[start:at], cap)]
                        start = at
                    at = m.end()
                out += [(p.source_id, p.page_number, start + a, start + z, p.text[start + a : start + z]) for a, z in split_to_cap((p.text or "")[start:at], cap)]
            yield pd.DataFrame(out, columns=["source_id", "page_number", "start_offset", "end_offset", "text"])

    return layout.select("source_id", "page_number", "text").mapInPandas(run, "source_id string, page_number int, start_offset int, end_offset int, text string")


def box(transform: Column, width: Column, height: Column, viewport: Column) -> Column:
    """LAY-15: bounding box of an item's four corners under the viewport's affine map (arrays of six)."""
    x, y = transform[4], transform[5]
    px = lambda a, b: viewport[0] * a + viewport[2] * b + viewport[4]
    py = lambda a, b: viewport[1] * a + viewport[3] * b + viewport[5]
    corners = [(x, y), (x + width, y), (x, y + height), (x + width, y + height)]
    xs, ys = [px(a, b) for a, b in corners], [py(a, b) for a, b in corners]
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("top"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("bottom"))
