import random

from tesselon.llm import decontaminate


def slow(docs, items, k=5, t=0.8):
    def grams(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    out = set()
    for d, text in docs:
        g = grams(text)
        for i, item in items:
            s = grams(item)
            if s and len(s & g) / len(s) >= t:
                out.add((d, i, len(s & g), len(s)))
    return out


def run(spark, docs, items, **o):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "1 as item_id", "'x' as shingle")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    return [(r["doc_id"], r["item_id"], r["matched"], r["item_shingles"]) for r in decontaminate.contained_items(d, i, **o).collect()]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 4, 5, 6, 9, 12, 30, 60])))) for i in range(40)] + [(90, ""), (91, None)]
    docs = []
    for d in range(150):
        w = say(rng.choice([0, 3, 20, 300, 3000]))
        if rng.random() < 0.6 and w:
            item = items[rng.randrange(40)][1].upper().split()
            for _ in range(rng.randrange(3)):  # edits near the threshold
                item[rng.randrange(len(item))] = "edit"
            at = rng.randrange(len(w))
            w = w[:at] + item + w[at:] if rng.random() < 0.8 else item
        docs.append((d, "\n ".join(w)))
    docs += [(500, None), (501, ""), (None, items[8][1]), (3, items[9][1])]
    got = run(spark, docs, items)
    assert sorted(map(str, got)) == sorted(map(str, slow(docs, items))) and len(got) > 20


def test_repeated_rows_give_one_pair_and_empty_tables_none(spark):
    item = " ".join(f"a{i}" for i in range(20))
    assert run(spark, [(1, item), (1, item)], [(7, item), (7, item)]) == [(1, 7, 16, 16)]
    assert run(spark, [], [(7, item)]) == [] and run(spark, [(1, item)], []) == []


def test_scattered_pieces_count(spark):
    w = [f"b{i}" for i in range(60)]
    doc = " ".join(w[:30]) + " " + " ".join(f"x{i}" for i in range(5000)) + " " + " ".join(w[30:])
    assert run(spark, [(1, doc)], [(2, " ".join(w))]) == [(1, 2, 52, 56)]


def test_drop_keeps_clean_rows_and_columns(spark):
    item = " ".join(f"c{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "clean text", "s"), (2, "x " + item, "s"), (None, item, "s"), (None, None, "s")], "doc_id long, text string, source string")
    out = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "clean text"]


def test_drop_judges_rows_of_one_id_by_their_texts(spark):
    item = " ".join(f"c{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "clean text"), (1, item), (1, "x " + item), (2, "clean text"), (None, item), (None, "clean")], "doc_id long, text string")
    out = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", "clean text"), ("2", "clean text"), ("None", "clean")]


def test_wide_item_tables_take_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    item = " ".join(f"d{i}" for i in range(20))
    assert run(spark, [(1, item)], [(7, item)]) == [(1, 7, 16, 16)]


def test_each_partition_has_its_own_bound_and_prefixes_lose_nothing(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 8, 12, 20, 40, 90, 200, 400] * 3)]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(400)]
        for i in rng.sample(range(len(items)), 3):
            w += items[i][1].split()
        docs.append((d, " ".join(w)))
    want = sorted(map(str, slow(docs, items)))
    for bits in (1, 8, 16):
        monkeypatch.setattr(decontaminate, "PREFIX_BITS", bits)
        assert sorted(map(str, run(spark, docs, items))) == want
    assert len(want) > 100


def test_registered_query_against_brute_force(spark, sf_dir):
    from tesselon.llm.queries import op1_decontaminate, table

    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"], r["matched"], r["item_shingles"]) for r in op1_decontaminate(spark, sf_dir).collect()}
    assert got == slow(docs, items) and got
