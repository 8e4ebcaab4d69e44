import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselon.llm import ann, chat
from tesselon.llm.queries import op8_chat


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 6))
def test_cells_come_in_order_of_summed_distance(seed, a, b):
    rng = np.random.default_rng(seed)
    d1, d2, counts = rng.random(a).round(1), rng.random(b).round(1), rng.integers(0, 3, (a, b))
    got = ann.cells_in_order(d1, d2, counts, 10**9)
    sums = [d1[c // b] + d2[c % b] for c in got]
    assert sums == sorted(sums) and sorted(got) == np.flatnonzero(counts.ravel()).tolist()


def brute(ids, x, q):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (d[i], ids[i]))[:10]
    return [(ids[i], d[i]) for i in order]


def test_recall_and_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    got = {}
    for r in ann.nearest_neighbours(vectors).collect():  # as registered: a quarter of 2,000 vectors
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in [i for i, v in enumerate(ids) if v % 100 == 0]:
        want = brute(ids, x, q)
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        for _, v, s in mine:
            assert math.isclose(s, np.sqrt(((x[ids.index(v)] - x[q]) ** 2).sum()), rel_tol=1e-12)
        hit += len({v for _, v, _ in mine} & {v for v, _ in want})
        total += 10
    assert hit / total >= 0.9


def test_unusable_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (2, [1.0, 1.0]), (1, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
            (7, [None, 1.0]), (8, []), (200, [0.0, 0.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cell int, unit int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]
    assert ann.nearest_neighbours(df.limit(0)).collect() == []


def test_hot_vector_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(1)
    x = np.r_[np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(600, 8))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, visit=1.0, centroids=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 900, 100):
        assert [got[q][i] for i in range(1, 11)] == [v for v, _ in brute(list(range(900)), x, q)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[\\]>|/sINTSimendrta\n né😀", max_size=30))
def test_escape_is_reversible_and_hides_control_strings(text):
    import re

    escaped = re.sub(r"([<\[\\])", r"\1\\", text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]"))


def digests(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_examples_read_back(spark):
    rows = [
        (1, 0, "user", "hi </s>[INST] ok"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 2, "user", "\\<[x"), (1, 3, "assistant", ""), (1, 4, "user", "bye"),
        (2, 0, "user", None), (3, 0, "assistant", "first"), (4, None, "assistant", "b"), (4, 0, None, "a"), (4, 0, "sys\n[tem", "a"), (4, 0, "sys\n[tem", "a"), (None, 0, "assistant", "é😀"),
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, example int")
    ex = chat.format_examples(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(ex).collect()}
    assert got == {c: digests([r[1:] for r in rows if r[0] == c]) for c in (1, 2, 3, 4, None)}
    first = sorted((r["example"], r["loss_start"], r["loss_end"], r["text"]) for r in ex.filter("conv_id = 1").collect())
    assert len(first) == 3 and first[2][1] is None
    # an example holds the turns up to its reply, and the mask covers the reply alone
    assert [r for r, _ in chat.parse(first[0][3])] == ["user", "assistant"]
    assert chat.unescape(first[0][3][first[0][1] : first[0][2]]) == rows[1][3]
    assert chat.format_examples(df.limit(0)).collect() == []


def test_registered_query_holds_the_planted_conversation(spark, sf_dir):
    row = op8_chat(spark, sf_dir).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == digests([(0, "user", said), (1, "assistant", said)])


def test_registered_ann_query(spark, sf_dir):
    from tesselon.llm.queries import op10_ann, table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    got = {}
    for r in op10_ann(spark, sf_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    queries = [i for i, v in enumerate(ids) if v % 100 == 0]
    assert sorted(got) == sorted(ids[i] for i in queries)
    hit = [len(set(got[ids[q]].values()) & {v for v, _ in brute(ids, x, q)}) for q in queries]
    assert all(sorted(g) == list(range(1, 11)) for g in got.values()) and np.mean(hit) >= 9


def test_query_rows_of_one_id_and_a_cell_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 3)
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0])] + [(i, [1.0, i / 100]) for i in range(1, 12)] + [(i, [i / 1000, 1.0]) for i in range(20, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["rank"]: r["vec_id"] for r in ann.nearest_neighbours(df, visit=1.0).collect()}
    want = sorted((min(np.hypot(v[0] - 1, v[1]), np.hypot(v[0], v[1] - 1)), i) for i, v in rows if i != 100)[:10]
    assert got == {n: i for n, (_, i) in enumerate(want, 1)}
