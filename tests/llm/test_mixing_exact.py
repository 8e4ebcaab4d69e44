"""The exact draws of the splitting tree at any size, row identity, and the registered mixing query."""

from collections import Counter
from math import comb

import numpy as np
import pytest

from tesselon.llm import mixing
from tesselon.llm.queries import op2_mix, table


@pytest.mark.parametrize(("good", "bad", "n"), [(5, 7, 6), (40, 3, 20), (1, 1000, 500), (300, 700, 10)])
def test_large_sampler_has_the_hypergeometric_law(good, bad, n):
    rng, runs = np.random.default_rng(5), 4000
    got = Counter(mixing._large_hypergeometric(rng, good, bad, n) for _ in range(runs))
    want = {x: runs * comb(good, x) * comb(bad, n - x) / comb(good + bad, n) for x in range(max(0, n - bad), min(good, n) + 1)}
    assert sum(got.values()) == runs and set(got) <= set(want)
    bins = [x for x, w in want.items() if w >= 5]
    rest = runs - sum(want[x] for x in bins)
    chi = sum((got[x] - want[x]) ** 2 / want[x] for x in bins)
    chi += (runs - sum(got[x] for x in bins) - rest) ** 2 / max(rest, 5)
    assert chi < len(bins) + 5 * (2 * (len(bins) + 1)) ** 0.5


def test_log_factorials_and_moments_beyond_the_generator():
    for k in (0, 1, 5, 1023):
        assert float(mixing._log_factorial(k)) == pytest.approx(float(np.sum(np.log(np.arange(1, k + 1)))), rel=1e-12, abs=1e-12)
    exact = sum(np.log(np.longdouble(i)) for i in range(1, 5001))
    assert float(mixing._log_factorial(5000)) == pytest.approx(float(exact), rel=1e-14)
    rng, g, b, n = np.random.default_rng(6), 10**11, 3 * 10**11, 2 * 10**11
    x = np.array([mixing._large_hypergeometric(rng, g, b, n) for _ in range(400)], float)
    mean, var = n * g / (g + b), n * g * b * (g + b - n) / (g + b) ** 2 / (g + b - 1)
    assert abs(x.mean() - mean) < 4 * (var / 400) ** 0.5 and 0.75 < x.var() / var < 1.3
    parts = mixing.split_quotas([10**12, 3, 5 * 10**11], 16, rng)
    assert np.array(parts).sum(0).tolist() == [10**12, 3, 5 * 10**11]


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    rows = [(1, "a", "x y z", f"t{i}") for i in range(5)] + [(2, "b", "u v", "t"), (None, "b", None, "t"), (None, "b", None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, doc string")
    out = mixing.mixed_documents(df.repartition(3))
    # 17 words: source a has 15 of them and is held to a third of the weights, b to three times its 2 words
    got = Counter(r["doc"] for r in out.filter("source = 'a'").collect())
    assert out.columns == df.columns and set(got) <= {f"t{i}" for i in range(5)} and max(got.values()) == 1
    assert sum(len(r["text"].split()) for r in out.filter("source = 'a'").collect()) == 17 - 6
    assert out.filter("source = 'b'").count() == 3


def test_clashing_columns_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(1, "a", "w1 w2 w3", 9, 8, "k", 4)] * 100 + [(2, "a", "v " * 50, 9, 8, "k", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size long, copy int, __key string, n_chars int")
    got = mixing.taken_per_document(mixing.plan_mix(df)).collect()
    assert len(got) == 101 and sum(r["taken"] for r in got) == 350 and all(r["taken"] == r["size"] for r in got)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == 101


def test_written_shards_hold_the_mix_in_order(spark, tmp_path):
    rows = [(i, "ab"[i % 2], " ".join(f"w{j}" for j in range(50 + i))) for i in range(30)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shards=4, block_words=16)
    path = str(tmp_path / "mix")
    mixing.write_mix(mixed, path)
    back = spark.read.parquet(path)
    key = lambda df: sorted((r["shard"], r["order_key"], r["text"]) for r in df.collect())
    assert key(back) == key(mixed)
    for s in range(4):
        orders = [r["order_key"] for r in spark.read.parquet(f"{path}/shard={s}").collect()]
        assert orders == sorted(orders)


def test_registered_query_against_the_rule(spark, sf_dir):
    got = op2_mix(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(docs)
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    want = mixing.targets(dict(total))
    taken, dealt = Counter(), np.zeros(16, np.int64)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (total[s], pytest.approx(want[s])) and r["taken"] <= 3 * r["size"]
        assert sum(r["shard_words"]) == r["taken"]
        taken[s] += r["taken"]
        dealt += r["shard_words"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in total)
    # shards get equal numbers of blocks, so words are equal up to the blocks' sizes
    assert dealt.min() > 0.8 * dealt.max()
