"""The second level of the language model: words inside a class, their training, and the sums of the partitions."""

import numpy as np

from tesselon.llm import lm
from tesselon.session import materialize

SCHEMA = "doc_id long, text string"


def vocab(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return lm.vocabulary(materialize(lm.word_counts(docs), "t"))


def same_class_words(n):
    """Words of one class: they end in the same three letters."""
    return [f"{chr(97 + i // 26)}{chr(97 + i % 26)}qxy" for i in range(n)]


def test_slots_and_shares_are_normalised(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 3)
    monkeypatch.setattr(lm, "NEURAL", 40)
    monkeypatch.setattr(lm, "CLASSES", 3 + lm.SUFFIXES)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)]
    v = vocab(spark, [" ".join(rng.choice(words, 200, p=np.arange(80, 0, -1) / 3240)) for _ in range(10)])
    assert (v.slot >= 0).sum() == 40 and sorted(v.slot[v.slot >= 0]) == list(range(40)) and v.slot[-1] == -1
    assert all(v.first[k] <= s < v.first[k + 1] for k, s in zip(v.klass, v.slot, strict=True) if s >= 0)
    own = lm.ClassWords(v, rng.normal(size=(40, lm.DIM)))
    k_of = np.array([k for k, s in sorted(zip(v.klass, v.slot, strict=True), key=lambda x: x[1]) if s >= 0])
    q = np.repeat(rng.normal(size=(1, lm.DIM)), 40, 0).astype(np.float32)
    share = np.exp(own.log_share(q, np.arange(40), k_of))
    assert np.allclose(np.bincount(k_of, share)[np.unique(k_of)], 1, atol=1e-4)
    # without vectors a word's part is its frequency
    flat = lm.ClassWords(v)
    assert np.allclose(np.exp(flat.log_share(q, np.arange(40), k_of)), v.members / np.bincount(k_of, v.members)[k_of], atol=1e-5)


def test_words_of_one_class_are_told_apart_by_their_context(spark):
    a, b = same_class_words(2)
    fill = " ".join(f"top{i}" for i in range(lm.TOP)) + " "
    texts = [fill * 3] * 5 + [(f"top1 top1 {a} " * 60 + f"top2 top2 {b} " * 60).strip()] * 20
    v = vocab(spark, texts)
    ia, ib = v.index[a.encode()], v.index[b.encode()]
    assert v.klass[ia] == v.klass[ib] or min(ia, ib) < lm.TOP
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    ref = spark.sparkContext.broadcast(v)
    model, words = lm.train(docs.repartition(3), ref)
    if min(ia, ib) >= lm.TOP:
        k = np.array([v.klass[ia]] * 4)
        c1, c2 = (int(v.klass[v.index[t]]) for t in (b"top1", b"top2"))
        q = lm.context_vectors(model, np.array([c1, c1, c2, c2]), np.array([c1, c1, c2, c2]))
        x = words.log_share(q, np.array([v.slot[ia], v.slot[ib]] * 2), k)
        assert x[0] > x[1] and x[3] > x[2]


def test_sums_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "_FAN_IN", 3)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 100, (20, 2, 5)).astype(np.float32)
    rows = [(p, b, bytearray(x[p, b].tobytes())) for p in range(20) for b in range(2)]
    got = lm._summed(spark.createDataFrame(rows, "part long, block int, x binary"), 20)
    assert np.array_equal(got, x.sum(0).ravel())
    assert len(lm._summed(spark.createDataFrame([], "part long, block int, x binary"), 20)) == 0


def test_scores_do_not_depend_on_the_block_of_texts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir.replace('0.01', '0.001')}/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs.coalesce(1)).collect()}
    # the same partitions, so the same model; every text in a block of its own against many in one
    cut = docs.coalesce(1).filter("doc_id % 10 = 3")
    assert len(one) == docs.count() and cut.count() > 0
    assert all(s <= 0 for s in one.values())
