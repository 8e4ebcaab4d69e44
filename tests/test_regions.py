"""Page geometry against a slow form that walks one page's items in plain Python."""

import random
import re

import pytest

from tesselon.operators import regions as rg

SCHEMA = "source_id string, page_number int, item int, text string, x double, y double, width double, height double, page_width double, line string"
WORDS = ["the", "of", "region", "layout", "a", "x", "=", "12", "été", "measured", "columns", " "]


def right(i):
    return i["x"] + (i["width"] if (i["width"] or 0) > 0 else max(len(i["text"]), 1) * max(i["height"], 8) * 0.5)


def words(t, n):
    return len([w for w in t.split() if re.search("[A-Za-z]{%d}" % n, w)])


def letters(its):
    return sum(len(re.findall("[A-Za-z]", i["text"])) for i in its)


def is_prose(i):
    return words(i["text"], 3) >= 2 or len(i["text"].strip()) >= 24


def slow_lines(its):
    out = []
    for i in sorted((i for i in its if i["text"]), key=lambda i: (-i["y"], i["x"], i["item"])):
        h = i["height"] if i["height"] > 0 else 12
        k = next((k for k in out if abs(k["y"] - i["y"]) <= max(k["h"], h) * 0.45), None)
        if k:
            k["y"], k["h"] = (k["y"] * len(k["its"]) + i["y"]) / (len(k["its"]) + 1), max(k["h"], h)
            k["its"].append(i)
        else:
            out.append({"y": i["y"], "h": h, "its": [i]})
    return sorted(out, key=lambda k: -k["y"])


def line_words(k):
    return sum(words(i["text"], 2) for i in k["its"])


def slow_clusters(its):
    buckets = {}
    for i in its:
        if i["text"].strip():
            buckets.setdefault(int((i["x"] / 36 + 0.5) // 1), []).append(i)
    mean = lambda xs: sum(i["x"] for i in xs) / len(xs)
    out = []
    for _, b in sorted(buckets.items()):
        if out and mean(b) - mean(out[-1]) <= 36:
            out[-1] += b
        else:
            out.append(list(b))
    return [(mean(c), c) for c in out]


def chosen(its):
    return [i for i in its if i["text"].strip() and is_prose(i)] or [i for i in its if i["text"].strip()]


def slow_kind(its):
    real = [i for i in its if i["text"].strip()]
    bins = lambda c: {k: sum(int((i[c] / 8 + 0.5) // 1) == k for i in real) for k in {int((i[c] / 8 + 0.5) // 1) for i in real}}
    many = lambda c: sum(n >= 3 for n in bins(c).values())
    if len(real) < 12 or many("x") < 3 or many("y") < 3 or sum(len(i["text"].strip()) <= 12 for i in real) / len(real) < 0.7:
        return "none"
    lines = slow_lines(its)
    long_, alpha = sum(line_words(k) >= 4 for k in lines), letters(its) / max(1, sum(len("".join(i["text"].split())) for i in its))
    return "math" if (long_ >= 8 and alpha >= 0.4) or (long_ >= 5 and long_ / len(lines) >= 0.28 and alpha >= 0.35) else "table"


def over(i, w):
    return w > 0 and i["x"] < w / 2 and right(i) > w / 2 + 20 and (i["width"] or 0) > w * 0.45


def slow_columns(its, w):
    mid, kind, source = w / 2, slow_kind(its), chosen(its)
    total = max(letters(source), 1)
    rows = []
    for x, c in slow_clusters(source):
        ys = [i["y"] for i in c]
        rows.append({"x": x, "n": len(c), "mass": letters(c), "share": letters(c) / total, "top": max(ys), "bot": min(ys), "long": sum(line_words(k) >= 4 for k in slow_lines(c))})
    two = sorted(sorted(rows, key=lambda r: -r["mass"])[:2], key=lambda r: r["x"])
    dominant = False
    if len(two) == 2:
        a, b = two
        lap, spans = min(a["top"], b["top"]) - max(a["bot"], b["bot"]), [r["top"] - r["bot"] for r in two]
        dominant = (kind != "table" and b["x"] - a["x"] >= max(56, w * 0.18) and a["x"] <= w * 0.45 <= b["x"] and min(spans) >= 12 and lap > 0 and lap >= 0.3 * min(spans)
                    and all(r["n"] >= 3 and r["mass"] >= 40 and r["long"] >= 2 and r["share"] >= 0.18 for r in two) and a["share"] + b["share"] >= 0.55)
    real = [i for i in its if i["text"].strip()]
    lo, ro = [i for i in real if i["x"] < mid - 14], [i for i in real if i["x"] > mid + 14]
    risk = False
    for k in slow_lines(its):
        multi = lambda side: any(words(i["text"], 3) >= 2 for i in k["its"] if side(i))  # noqa: B023, E731
        risk |= multi(lambda i: i["x"] < mid - 14) and multi(lambda i: i["x"] > mid + 14)
        risk |= any(over(i, w) for i in k["its"]) and any(i["x"] > mid + 14 and i["text"].strip() for i in k["its"])
    n_long = lambda xs: sum(line_words(k) >= 4 for k in slow_lines(xs))
    wide = any(over(i, w) for i in real)
    alone = dominant or (kind != "table" and wide and len(ro) >= 2 and sum(map(is_prose, lo)) >= 2 and n_long(lo) >= 2 and (sum(map(is_prose, ro)) >= 2 or n_long(ro) >= 2))
    refuse = kind != "table" and (alone or risk)
    split = (two[0]["x"] + two[1]["x"]) / 2 if dominant else mid if refuse else None
    return kind, len(rows), wide, risk, dominant, alone, refuse, split


def slow_order(its, w):
    kind, _, _, _, dominant, _, refuse, split = slow_columns(its, w)

    def good(at):
        l, r = (slow_lines([i for i in its if i["text"].strip() and (i["x"] < at) == side]) for side in (True, False))
        if len(l) < 2 or len(r) < 2 or not all(any(sum(len(i["text"].split()) for i in k["its"]) >= 4 for k in s) for s in (l, r)):
            return False
        spans, lap = [s[0]["y"] - s[-1]["y"] for s in (l, r)], min(l[0]["y"], r[0]["y"]) - max(l[-1]["y"], r[-1]["y"])
        return min(spans) >= 12 and lap > 0 and lap >= 0.3 * min(spans)

    if kind == "table":
        return "uncertain"
    if dominant:
        return "two-column" if good(split) else "uncertain"
    big = [x for x, c in slow_clusters(its) if len(c) >= 2]
    if len(big) == 2 and big[1] - big[0] >= max(56, w * 0.18) and big[0] <= w * 0.45 <= big[1] and good(sum(big) / 2):
        return "two-column"
    real = [i for i in its if i["text"].strip()]
    l, r = (slow_lines([i for i in real if t(i)]) for t in (lambda i: right(i) < w / 2 - 14, lambda i: i["x"] > w / 2 + 14))
    starts = [min(i["x"] for i in k["its"]) for k in slow_lines(real)]
    return "uncertain" if refuse or (len(l) >= 2 and len(r) >= 2 and max(starts) - min(starts) > w * 0.35) else "single-column"


def page(seed):
    rnd = random.Random(seed)
    style, out = rnd.choice(["one", "two", "grid", "wide", "any", "math"]), []
    for i in range(rnd.randint(1, 45)):
        t = rnd.choice(WORDS[:4]) if style == "math" else " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8 if style != "grid" else 1)))
        x, y = {"one": (40 + rnd.randint(0, 9), 760 - 14 * i), "two": (40 + 290 * (i % 2) + rnd.randint(0, 30), 760 - 14 * (i // 2) + rnd.choice([0, 3.5])),
                "grid": (40 + 110 * (i % 4), 760 - 14 * (i // 4)), "wide": (40 + 290 * (i % 2), 760 - 14 * (i // 2)),
                "math": (40 + 80 * (i % 5), 760 - 14 * (i // 5)), "any": (rnd.randint(0, 560), rnd.randint(0, 60))}[style]
        out.append({"item": i, "text": "" if rnd.random() < 0.03 else t, "x": float(x), "y": float(y), "width": float(rnd.choice([0, 60, 100, 300 if style == "wide" else 90])),
                    "height": rnd.choice([10.0, 10.0, 14.0, 0.0])})
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    pages = {("d", n): page(n) for n in range(60)}
    rows = [(s, n, i["item"], i["text"], i["x"], i["y"], i["width"], i["height"], 600.0, "clash") for (s, n), its in pages.items() for i in its]
    return pages, spark.createDataFrame(rows, SCHEMA).drop("line").cache()


def test_lines(corpus):
    pages, items = corpus
    got = {(r["page_number"], r["item"]): (r["line"], round(r["line_y"], 6), r["line_height"]) for r in rg.visual_lines(items).collect()}
    assert got == {(n, i["item"]): (no, round(k["y"], 6), k["h"]) for (_, n), its in pages.items() for no, k in enumerate(slow_lines(its)) for i in k["its"]}


def test_regions(corpus):
    pages, items = corpus
    got = {(r["page_number"], r["region"]): (round(r["x"], 6), r["items"], r["prose_lines"], r["median_width"], r["letters"], r["kind"], r["short_noise"], r["gutter_to_next"]) for r in rg.regions(items).collect()}
    want = {}
    for (_, n), its in pages.items():
        cs = slow_clusters(chosen(its))
        own = [0] * len(cs)
        for k in slow_lines(its):
            if cs and line_words(k) >= 2:
                own[min(range(len(cs)), key=lambda c: (abs(cs[c][0] - min(i["x"] for i in k["its"])), c))] += 1  # noqa: B023
        lefts = sorted((min(i["x"] for i in c), j) for j, (_, c) in enumerate(cs))
        after = {j: lefts[p + 1][0] - max(map(right, cs[j][1])) if p + 1 < len(lefts) else None for p, (_, j) in enumerate(lefts)}
        for j, (x, c) in enumerate(cs):
            want[n, j] = (round(x, 6), len(c), own[j], sorted(i["width"] for i in c)[len(c) // 2], letters(c), "prose" if letters(c) >= 40 else "unknown",
                          sum(len(i["text"].strip()) <= 12 for i in c) / len(c) >= 0.7, after[j])
    assert got == want


def test_gutters_and_grids(corpus):
    pages, items = corpus
    want = {}
    for (_, n), its in pages.items():
        for no, k in enumerate(slow_lines(its)):
            o = sorted(k["its"], key=lambda i: (i["x"], i["item"]))
            wide, gap = any(over(i, 600) for i in o), any(right(a) <= 300 <= b["x"] and b["x"] - right(a) >= 20 for a, b in zip(o, o[1:], strict=False))
            if wide or gap or (any(i["x"] < 286 for i in o) and any(i["x"] > 314 for i in o)):
                want[n, no] = (len(o), o[0]["x"], max(map(right, o)), wide, gap)
    assert {(r["page_number"], r["line"]): (r["items"], r["left_x"], r["right_x"], r["overflow"], r["gap"]) for r in rg.gutter_crossings(items).collect()} == want
    kinds = {r["page_number"]: r["kind"] for r in rg.grid_features(items).collect()}
    assert kinds == {n: slow_kind(its) for (_, n), its in pages.items() if any(i["text"] for i in its)} and set(kinds.values()) == {"none", "table", "math"}


def test_columns_and_reading_order(corpus):
    pages, items = corpus
    real = {n: its for (_, n), its in pages.items() if any(i["text"].strip() for i in its)}
    got = {r["page_number"]: (r["kind"], r["clusters"], r["width_distrust"], r["cross_risk"], r["two_dominant"], r["two_independent"], r["refuse_single"], r["split_x"]) for r in rg.prose_columns(items).collect()}
    want = {n: slow_columns(its, 600.0) for n, its in real.items()}
    close = lambda t: (*t[:-1], t[-1] and round(t[-1], 6))
    assert {n: close(t) for n, t in got.items()} == {n: close(t) for n, t in want.items()}
    order = {r["page_number"]: r["reading_order"] for r in rg.reading_orders(items).collect()}
    assert order == {n: slow_order(its, 600.0) for n, its in real.items()} and set(order.values()) == {"single-column", "two-column", "uncertain"}


def test_nothing_and_nulls(spark):
    rows = [("d", 1, 0, None, 1.0, 1.0, None, None, 600.0, ""), ("d", 2, 0, "  ", 1.0, 1.0, 5.0, 5.0, 600.0, ""), (None, 3, 0, "some words here and more", 1.0, 1.0, None, None, 600.0, "")]
    items = spark.createDataFrame(rows, SCHEMA).drop("line")
    for f in (rg.regions, rg.gutter_crossings, rg.grid_features, rg.prose_columns, rg.reading_orders):
        assert f(items.limit(0)).collect() == []
        f(items).collect()


def test_counts_by_code_points_are_those_of_the_patterns():
    space = "[\\t-\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    rnd = random.Random(7)
    pool = ["a", "B", "z", "\u00e9", "9", "0", "=", "\u2211", "{", "_", "-", "\U0001F600", " ", "\t", "\n", "\u00a0", "\u2003", "\u2028", "\u3000", "\ufeff", "\u200b"]
    texts = ["", " ", "abc", "\n", *("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(300))]
    for t, got in zip(texts, rg._count_points(texts).tolist(), strict=True):
        ws = [w for w in re.split(f"{space}+", t) if w]
        run = lambda n: sum(bool(re.search("[A-Za-z]{%d}" % n, w)) for w in ws)  # noqa: B023, E731
        count = lambda p: len(re.findall(p, t))  # noqa: B023, E731
        trimmed = re.sub(f"^{space}+|{space}+$", "", t)
        assert got == [len(trimmed), count("[A-Za-z]"), run(2), len(ws), run(3), count(r"[=∑∫√∞±×÷≤≥≠≈∈→←()\[\]{}^_]"), count("[0-9]"), len("".join(ws))]


def test_a_page_is_put_together_once(corpus):
    _, items = corpus
    for f in (rg.regions, rg.grid_features, rg.prose_columns, rg.reading_orders):
        plan = f(items)._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[-1]
        assert final.count("Exchange") == 1 and "Join" not in final and "Window" not in final


def test_edge_clusters_over_rows(corpus):
    pages, items = corpus
    got = {(r["page_number"], r["item"]): (r["cluster"], round(r["cluster_x"], 6)) for r in rg.edge_clusters(rg.item_features(items)).collect()}
    assert got == {(n, i["item"]): (no, round(x, 6)) for (_, n), its in pages.items() for no, (x, c) in enumerate(slow_clusters(its)) for i in c}
