import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tesselon.llm import language, lm, quality, toxicity
from tesselon.llm.labelled import labelled_sample
from tesselon.llm.queries import op3_quality, op4_lm_score, op5_language, op6_toxicity, table

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "¡!! 123"), (None, "the of and"), (5, "same text"), (5, "same text"), (6, "word " * 200_000)]
ODD_SCHEMA = "doc_id long, text string"


def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", "'zz' as lang", "1.0 as score", "2 as y", "3 as predicted", "'s' as rare")


def held(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n == 0


def labels(spark, sf_dir):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, sf_dir, "labels").collect()}


# --- quality ---------------------------------------------------------------------------------------------
def slow_features(text):
    """Features of the passages of one text, word by word."""
    w = text.encode().split()
    out = []
    for i in range(0, len(w), quality.PASSAGE):
        p = w[i : i + quality.PASSAGE]
        n = len(p)
        out.append((np.log1p(np.mean([len(x) for x in p])), np.log1p(n), np.mean([a == b for a, b in zip(p[1:], p, strict=False)] + [0]) if n else 0,
                    len(set(p)) / n, np.mean([len(x) <= 3 for x in p]), np.mean([65 <= x[0] <= 90 for x in p])))
    return np.array(out)


def test_features_equal_slow_form():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Ab", "ab", "c\nd", "é,", "12", "%%%"], n)) for n in (1, 63, 64, 65, 500)]
    piece, x = quality.features([t.encode() for t in texts])
    k = len(quality._CLASSES) + 1
    for i, t in enumerate(texts):
        mine, slow = x[piece == i], slow_features(t)
        assert np.allclose(mine[:, [k, k + 1, k + 4, k + 5, k + 6]], slow[:, [0, 1, 3, 4, 5]])
        n = np.array([min(64, len(t.split()) - j) for j in range(0, len(t.split()), 64)])
        assert np.allclose(mine[:, k + 2] * n, slow[:, 2] * n, atol=1.01)


def test_scores_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(3, quality.N_FEATURES)) for _ in range(30)]
    model = quality.fit(bags, rng.integers(0, 2, 30).astype(float), rounds=5)
    texts = ["a b c", "", None, "x " * 3000, "é" * 50]
    alone = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts), alone) and all(0 <= s <= 1 for s in alone)
    assert [b"".join(h for n, hs in [*quality.pieces(["ab " * 900_000])] for h in hs)] == [b"ab " * 900_000]


def test_gradients(monkeypatch):
    """Attention learns which passage matters: one marked passage among noise decides the label."""
    rng = np.random.default_rng(3)
    bags, y = [], []
    for i in range(300):
        b = rng.normal(size=(int(rng.integers(2, 20)), quality.N_FEATURES))
        b[:, 0] = 0
        if i % 2:
            b[rng.integers(len(b)), 0] = 5
        bags.append(b)
        y.append(float(i % 2))
    model = quality.fit(bags, np.array(y))
    p = []
    for b in bags:
        h, e = model.encode(b)
        a = np.exp(e) / np.exp(e).sum()
        p.append((a @ h) @ model.p["c"] + model.p["d"][0] > 0)
    assert np.mean(np.array(p) == np.array(y)) > 0.95


def test_quality_held_out(spark, sf_dir):
    y = labels(spark, sf_dir)
    got = op3_quality(spark, sf_dir).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len(got) == table(spark, sf_dir, "documents").count()
    test = [(r["predicted"], y[r["doc_id"]][0]) for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(test) > 40 and np.mean([a == b for a, b in test]) > 0.93


def test_quality_odd_rows_and_no_labels(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd(spark), none)
    assert {r["score"] for r in quality.score(odd(spark), model).collect()} == {0.5}
    docs = table(spark, sf_dir, "documents")
    got = quality.score(odd(spark), quality.train(docs, table(spark, sf_dir, "labels"), max_rows=100)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert quality.score(odd(spark).limit(0), model).collect() == []


# --- toxicity --------------------------------------------------------------------------------------------
def test_toxicity_finds_toxic_and_spares_clean_documents_it_has_not_seen(spark, sf_dir):
    big = sf_dir.replace("0.01", "0.1")
    y = {d: t for d, (_, t) in labels(spark, big).items()}
    docs, known = table(spark, big, "documents"), table(spark, big, "labels")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, known.filter("doc_id % 2 = 0"))).collect()}
    pairs = [(got[d]["toxic"], t) for d, t in y.items() if d % 2]
    assert len(pairs) > 1500 and np.mean([a for a, b in pairs if not b]) < 0.006
    assert np.mean([a for a, b in pairs if b]) > 0.8
    assert all(0 <= r["severity"] <= 3 for r in got.values())


def test_toxicity_query(spark, sf_dir):
    y = labels(spark, sf_dir)
    got = {r["doc_id"]: r for r in op6_toxicity(spark, sf_dir).collect()}
    pairs = [(got[d]["toxic"], t) for d, (_, t) in y.items()]
    assert len(got) == table(spark, sf_dir, "documents").count() and sum(1 for a, b in pairs if b == 0 and a == 1) <= 2


def test_thresholds_are_ordered_and_severity_rises():
    bad = ["idiot", "moron", "scum", "trash", "loser"]
    rows = [("plain words here " + " ".join(bad[: i % 6]), int(i % 6 > 0)) for i in range(300)]
    m = toxicity.fit(rows)
    assert (np.diff(m.thresholds) >= 0).all()
    s = [m.exceed(m.evidence("plain words here " + " ".join(bad[:k]))).sum() for k in range(6)]
    assert s == sorted(s) and m.exceed(m.evidence("plain words"))[0] < 0.5 < m.exceed(m.evidence("plain idiot"))[0]


def test_toxicity_grade_follows_the_decision(spark):
    bad = ["idiot", "idiot moron", "idiot moron scum filth"]
    m = toxicity.fit([(b + f" word{i}", 1) for i in range(30) for b in bad] + [(f"fine day word{i}", 0) for i in range(90)])
    docs = spark.createDataFrame(list(enumerate([*bad, "fine day", "", None])), "doc_id long, text string")
    got = [r for r in toxicity.score(docs, m).orderBy("doc_id").collect()]
    assert [r["toxic"] for r in got] == [1, 1, 1, 0, 0, 0]
    assert [r["grade"] for r in got] == [1, 2, 3, 0, 0, 0]


def test_labelled_sample_is_bounded_whatever_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["text"], r["y"]) for r in labelled_sample(docs, labels, "toxic", 10).collect()}
    assert set(got) == {1, 2, 3} and got[2] == ("a", 1) and got[3] == ("", 0) and got[1][1] == 1
    assert labelled_sample(docs, labels, "toxic", 10).count() == 3 and labelled_sample(docs, labels, "toxic", 2).count() == 2


def test_toxicity_trains_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(none, labels)
    assert [r["toxic"] for r in toxicity.score(odd(spark), m).collect()] == [0] * len(ODD)


def test_toxicity_odd_rows(spark):
    for rows in ([], [("a", 0)], [("a", 1)]):
        m = toxicity.fit(rows)
        assert m.exceed(m.evidence(None)).tolist() == [0, 0, 0] and not m.rejects(m.evidence("x"))
    m = toxicity.fit([("idiot", 1), ("fine", 0)] * 20)
    got = toxicity.score(odd(spark), m).collect()
    assert len(got) == len(ODD) and toxicity.drop_toxic(odd(spark), m).count() == len(ODD)
    assert toxicity.score(odd(spark).limit(0), m).collect() == []


# --- language --------------------------------------------------------------------------------------------
def test_language_held_out(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    got = op5_language(spark, sf_dir).collect()
    test = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(test) > 100 and np.mean(test) > 0.97
    assert all(r["held_out"] == held(r["doc_id"], 5) and 0 <= r["score"] <= 1 for r in got)


def test_trigrams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "Ça va, and 12 words ÉÉ — " * 50
    whole = language.trigrams(text)
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language, "_PIECE", piece)
        assert all((a == b).all() for a, b in zip(language.trigrams(text), whole, strict=True))
    raw, n = language._OTHER.sub(b" ", f" {text} ".lower().encode()), Counter()
    for i in range(len(raw) - 2):
        n[(raw[i] * 7919 + raw[i + 1] * 263 + raw[i + 2] * 31) % language.BUCKETS] += 1
    assert dict(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == n
    assert len(language.trigrams("")[0]) == 0 and len(language.trigrams("12 !")[0]) == 0


def test_mixture_proportions_and_set():
    rng = np.random.default_rng(4)
    a, b, c = (["".join(rng.choice(list(x), 5)) for _ in range(400)] for x in ("abcde", "fghij", "klmno"))
    counts = np.zeros((3, language.BUCKETS))
    for i, w in enumerate((a, b, c)):
        at, n = language.trigrams(" ".join(w))
        counts[i, at] += n
    m = language.Mixture(["A", "B", "C"], counts)
    one = m.infer(" ".join(a[:100]))
    two = m.infer(" ".join(a[:150] + b[:50]))
    assert set(one) == {"A"} and set(two) == {"A", "B"} and two["A"] == pytest.approx(0.75, abs=0.05)
    assert m.infer("123 !!") == {} and language.Mixture([], counts[:0]).infer("abc") == {}


def test_language_odd_rows(spark, sf_dir):
    m = language.train(table(spark, sf_dir, "documents"), max_rows=50)
    got = {r["doc_id"]: r for r in language.identify(odd(spark), m).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 4)) and got[None]["lang_pred"] == "en"
    assert language.identify(odd(spark).limit(0), m).collect() == []
    assert not language.has_letter("²³ ½ 12 _-") and language.has_letter("² é") and not language.has_letter("")
    assert language.train(odd(spark).filter("lang is null")).names == []


# --- language model --------------------------------------------------------------------------------------
def slow_base(docs, folds=10):
    toks = {i: lm.tokens(t) for i, (_, t) in enumerate(docs)}
    c = Counter(w for i, (d, _) in enumerate(docs) if not held(d, folds) for w in toks[i])
    n, v = sum(c.values()), len(c)
    return [(d, len(toks[i]), sum(1 for w in toks[i] if c[w]), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[i])) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("hot", [300_000, 150])
def test_base_score_equals_slow_form_with_any_hot_table(spark, hot):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"W{int(x)}é" for x in rng.zipf(1.4, int(rng.integers(0, 80))) if x < 10**6)) for i in range(80)] + ODD[:7]
    df = spark.createDataFrame(docs, ODD_SCHEMA).selectExpr("*", "'q' as w", "1 as n", "2 as tf")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.lm_scores(df, hot=hot).collect())
    assert got == sorted((str(d), n, k, t, round(s, 6)) for d, n, k, t, s in slow_base(docs))


def test_class_probabilities_are_normalised():
    noise = np.random.default_rng(6).random(lm.CLASSES)
    model = lm.LogBilinear(noise / noise.sum())
    s1, s2, z = model.tables()
    for i, j in ((0, 0), (5, 400), (511, 3)):
        assert np.exp(s1[i] + s2[j] - z[i, j]).sum() == pytest.approx(1)


def test_training_learns_a_context():
    rng = np.random.default_rng(7)
    k = np.zeros(40_000, np.int64)
    k[1::2] = rng.integers(1, 40, 20_000)
    k[2::2] = k[1:-1:2] + 100  # a class tells the next one
    noise = np.bincount(k, minlength=lm.CLASSES) + 0.5
    model = lm.LogBilinear(noise / noise.sum())
    state = np.full(len(model.flat), 1e-6, np.float32)
    before = model.tables()
    for _ in range(20):
        model.train(k[1:-1], k[:-2], k[2:], state, rng)
    after = model.tables()
    score = lambda t: np.mean(t[0][k[1:-1], k[2:]] + t[1][k[:-2], k[2:]] - t[2][k[1:-1], k[:-2]])
    assert score(after) > score(before) + 0.5


def test_word_masses_of_classes_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 50} c{i} the") for i in range(900)], ODD_SCHEMA)
    from tesselon.session import materialize

    counts = materialize(lm.word_counts(docs), "t")
    v = lm.vocabulary(counts)
    mass = Counter()
    for r in counts.collect():
        w = bytes(r["w"])
        i = v.index[w]
        mass[int(v.klass[i])] += r["n"] + lm.ADD if v.klass[i] >= lm.TOP else r["n"]
    for k, m in mass.items():
        total = v.class_count[k] + (lm.ADD * (v.class_words[k] + 1) - lm.ADD if k >= lm.TOP else 0)
        assert m == pytest.approx(total)
    assert v.total == 900 * 5 and v.distinct == 7 + 50 + 900 + 2


def test_model_beats_base_on_held_out(spark, sf_dir):
    got = op4_lm_score(spark, sf_dir).collect()
    test = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert all(r["held_out"] == held(r["doc_id"], 10) for r in got)


def test_lm_without_training_rows(spark):
    ids = [i for i in range(500) if held(i, 10)][:5]
    got = lm.lm_scores(spark.createDataFrame([(i, "a b") for i in ids], ODD_SCHEMA)).collect()
    assert len(got) == 5 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in got)
    assert lm.lm_scores(spark.createDataFrame([], ODD_SCHEMA)).collect() == []
