import random

import pytest

from tesselon.operators import chunking, layout

ITEM = "array<struct<str:string,x:double,y:double,width:double,height:double>>"


def item(no, text, x, y, h=10.0):
    return layout.Item(no, text, x, y, len(text) * 5.0, h)


def test_lines_tolerate_small_shifts_and_sort():
    lines = layout.visual_lines([item(0, "world", 60, 700.5), item(1, "hello", 10, 702), item(2, "below", 10, 680), item(3, "", 0, 0)])
    assert [k.text for k in lines] == ["hello world", "below"]


def test_two_columns_read_left_first():
    items = [item(i, f"left words number {i}", 40, 700 - 14 * i) for i in range(5)] + [item(10 + i, f"right words number {i}", 320, 700 - 14 * i) for i in range(5)]
    order, lines = layout.columns(items, 600)
    assert order == "two-column" and [k.text.split()[0] for k in lines] == ["left"] * 5 + ["right"] * 5
    wide = items + [layout.Item(20, "a line across the whole page of it", 40, 500, 500, 10)]
    assert layout.columns(wide, 600)[0] == "uncertain"
    assert layout.columns(items[:5], 600)[0] == "single-column"


def test_grid_is_uncertain():
    items = [item(5 * r + c, str(r * c), 40 + 80 * c, 700 - 20 * r) for r in range(5) for c in range(5)]
    assert layout.is_grid(items) and layout.columns(items, 600)[0] == "uncertain" and layout.grid_kind(items) == "table"


def test_grid_kinds_of_tables_and_of_single_pages_agree(spark):
    rng, rows = random.Random(4), []
    for page in range(60):
        words = [["7", "12.5", "long words of a line"], ["x", "a=b", "y"], ["12", " ", "x", "n/a"]][page % 3]
        for i in range(rng.randrange(6, 30)):
            rows.append(("d", page, i, rng.choice(words), 40.0 * rng.randrange(4) + rng.random(), 20.0 * rng.randrange(4)))
    want = {}
    for page in range(60):
        items = [layout.Item(i, t, x, y, 10.0, 10.0) for _, p, i, t, x, y in rows if p == page]
        want[page] = layout.grid_kind(items)
    got = layout.grid_kinds(spark.createDataFrame(rows, "source_id string, page_number int, no int, text string, x double, y double"))
    assert {r["page_number"]: r["kind"] for r in got.collect()} == want and set(want.values()) == {"none", "table", "math"}


def test_line_features_of_odd_texts(spark):
    df = spark.createDataFrame([("",), ("  \n ",), ("a",), ("Two Words, 12!",), (None,)], "t string")
    got = [r[0] for r in df.select(layout.line_features(df.t)).collect()]
    assert [r["words"] for r in got[:4]] == [0, 0, 0, 2] and got[0]["prose"] == got[1]["prose"] == 0.2 and got[4] == got[0]
    assert abs(got[3]["punctuation"] - 2 / 12) < 1e-9 and got[3]["capitalised"] == 2 / 3 and got[3]["numeric"] == 2 / 12


def test_page_text_joins_hyphens_and_maps_back():
    lines = layout.visual_lines([item(0, "The mea-", 10, 700), item(1, "sured value", 10, 686), item(2, "ends.", 80, 686), item(3, "Next-", 10, 672), item(4, "Line", 10, 658)])
    text, segments = layout.page_text(lines)
    assert text == "The measured value ends.\nNext-\nLine"
    items = {i.no: i.text for k in lines for i in k.items}
    assert layout.map_errors(text, items, segments) == []
    at = text.index("measured")
    ranges = layout.source_ranges(segments, at, at + 8)
    assert ranges == [(0, 4, 7), (1, 0, 5)] and layout.source_text(items, ranges) == "mea sured"
    assert layout.map_errors(text + "x", items, segments) and layout.map_errors(text, {}, segments)


def test_blocks():
    rows = [("1 Introduction", 10, 700, 14), ("This paragraph has words", 10, 680, 10), ("and goes on here.", 10, 668, 10), ("Things to do:", 10, 640, 10), ("- first thing", 10, 628, 10),
            ("more of it", 24, 616, 10), ("- second thing", 10, 604, 10), ("Figure 1 A picture of it", 10, 560, 10), ("Page 3 of 9", 10, 20, 10)]
    lines = [layout.Line(y, h, [item(i, t, x, y, h)]) for i, (t, x, y, h) in enumerate(rows)]
    assert layout.blocks(lines, 600, {"Page 3 of 9"}) == [("heading", [0]), ("paragraph", [1, 2]), ("list", [3, 4, 5, 6]), ("caption", [7]), ("furniture", [8])]
    assert ("table", list(range(7))) in layout.blocks(lines, 600, grid="table") or layout.blocks(lines, 600, grid="table")[0][0] == "table"


def test_split_to_cap_covers_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  ") for _ in range(rng.randrange(120)))
        parts = layout.split_to_cap(text, 20)
        assert all(b - a <= 20 for a, b in parts) and "".join(text[a:b] for a, b in parts).replace(" ", "") == text.replace(" ", "")
    assert layout.split_to_cap("x" * 50, 20) == [(0, 20), (20, 40), (40, 50)]


def test_pages_bands_furniture_and_chunks(spark):
    rows = []
    for p in range(1, 5):
        items = [("Running head", 10.0, 760.0, 60.0, 10.0), (f"Body text of page {p}. It has two sentences.", 10.0, 400.0, 200.0, 10.0), (f"page {p}", 10.0, 20.0, 40.0, 10.0)]
        rows.append(("d1", p, 600.0, 800.0, items))
    rows.append(("d2", 1, 600.0, 800.0, []))
    pages = spark.createDataFrame(rows, f"source_id string, page_number int, width double, height double, items {ITEM}")
    out = layout.page_layout(pages).cache()
    assert out.count() == 5 and layout.mapping_violations(out).collect() == []
    assert [(r["band"], r["text"]) for r in layout.repeated_bands(out).collect()] == [("top", "Running head")]
    assert [r["text"] for r in layout.furniture(out).collect()] == ["Running head"]
    text = {(r["source_id"], r["page_number"]): r["text"] for r in out.collect()}
    for r in layout.document_chunks(out, 30).collect():
        assert text[(r["source_id"], r["page_number"])][r["start_offset"] : r["end_offset"]] == r["text"] and len(r["text"]) <= 30


def test_subtract_ranges_against_slow_form(spark):
    rng = random.Random(2)
    spans, cuts, want = [], [], set()
    for i in range(60):
        a = rng.randrange(50)
        b = a + rng.randrange(1, 40)
        own = [(c, c + rng.randrange(0, 12)) for c in (rng.randrange(90) for _ in range(rng.randrange(6)))]
        spans.append((i, a, b))
        cuts += [(i, *c) for c in own]
        live = [p for p in range(a, b) if not any(x <= p < y for x, y in own)]
        runs = []
        for p in live:
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        want |= {(i, *r) for r in map(tuple, runs)}
    s = spark.createDataFrame(spans, "id long, start long, end long")
    c = spark.createDataFrame(cuts, "id long, start long, end long")
    assert {tuple(r) for r in chunking.subtract_ranges(s, c).collect()} == want


@pytest.mark.parametrize("sizes, cap, want", [([5, 5, 5], 10, [0, 0, 1]), ([20, 1, 1], 10, [0, 1, 1]), ([], 10, [])])
def test_greedy_packing(spark, sizes, cap, want):
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(chunking.pack_greedy(df.s, cap)).first()[0] == want
