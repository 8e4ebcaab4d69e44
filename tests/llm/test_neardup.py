import itertools
import random

import corpus_pipeline as cp
from tesselon.llm import neardup
from tesselon.llm.queries import table


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(texts):
    """Smallest doc_id of each component over all pairs at a five-word Jaccard of 0.8; texts without words are one."""
    sets, root = {d: grams(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {top(d) for d in texts}


def stage(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in dict(cp.STAGES)["simhash_near_dedup"](spark, df, "").collect() if r["doc_id"] is not None)


def test_documents_that_share_a_repeated_passage_stay(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    rows = []
    for line, times, own in ((41, 200, 60), (40, 50, 120), (20, 30, 200), (30, 20, 300)):
        shared = words(line) * times
        rows += [(len(rows) + i, " ".join(shared + words(own))) for i in range(6)]
    assert set(stage(spark, rows)) == slow_kept(dict(rows)) == {d for d, _ in rows}


def test_stage_against_brute_force_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = [r["doc_id"] for r in neardup.drop_near_copies(docs).collect()]
    assert sorted(got) == sorted(slow_kept(texts)) and len(got) < len(texts)


def test_rows_without_words_or_id_and_repeated_ids(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    rows = [(4, None), (3, " \n"), (7, t), (7, t), (7, u), (9, t.upper()), (None, t), (8, "one two"), (6, "One  two")]
    assert stage(spark, rows) == [3, 6, 7, 7]
    assert neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id is null").count() == 1
    assert stage(spark, rows[:0]) == []


def test_chunks_of_a_class_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "CLASS_CHUNK", (7, 7))
    monkeypatch.setattr(neardup, "CHUNK", 9)
    assert set(stage(spark, rows)) == slow_kept(dict(rows))


def test_copies_with_scattered_edits_go(spark):
    rng = random.Random(3)
    rows = []
    for n, edits in ((300, 6), (1000, 20)):
        for _ in range(40):
            w = [f"w{rng.randrange(100_000)}" for _ in range(n)]
            copy = list(w)
            for i in rng.sample(range(n), edits):
                copy[i] = f"e{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(copy))]
    want = slow_kept(dict(rows))
    assert set(stage(spark, rows)) == want and len(want) < 0.8 * len(rows)


def test_texts_that_share_a_node_by_chance_are_told_apart(spark):
    rows = [(1, 11, 5, 50), (2, 12, 5, 50), (3, 13, 5, 51), (4, 14, 6, 60)]
    signed = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, rk long, node long, more long, size int")
    apart, nodes = neardup.told_apart(signed)
    node = {r["doc_id"]: r["node"] for r in apart.collect()}
    assert node[1] == node[2] != node[3] and node[4] == 6 and len(set(node.values())) == 3
    assert {(r["node"], r["rk"], r["size"]) for r in nodes.collect()} == {(node[1], 11, 9), (node[3], 13, 9), (6, 14, 9)}
    same, nodes = neardup.told_apart(signed.filter("doc_id != 3"))
    assert {r["node"] for r in same.collect()} == {r["node"] for r in nodes.collect()} == {5, 6}
