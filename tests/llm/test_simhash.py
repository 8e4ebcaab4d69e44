import random

import numpy as np
import xxhash
from pyspark.sql import Row

from tesselon.llm import simhash
from tesselon.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_equals_slow_form():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rng.choice(["A", "bé", "C\n", "d\t", "É", "xyz"]) for _ in range(n))
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(" \n") == 0


def test_long_text_is_read_whole():
    rng = random.Random(9)
    t = " ".join(str(rng.randrange(10**6)) for _ in range(70_000))
    assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_components_equal_brute_force_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(2)
    base = [" ".join(str(rng.randrange(40)) for _ in range(rng.choice([2, 5, 60, 200]))) for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(rng.randrange(4)):
            w = t.split()
            if rng.random() < 0.7 and len(w) > 5:
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += ["", None, "  ", "one", "one", "one two"]
    ids = list(range(100, 100 + len(texts)))
    ids[-1], ids[3] = None, ids[4]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.simhash_components(df).collect())
    fps = [slow_fingerprint(t) for t in texts]
    want = sorted((str(i), f"{f:016x}", str(c)) for i, f, c in zip(ids, fps, slow_components(ids, fps), strict=True))
    assert got == want


def test_links_lose_no_component_whatever_the_bucket_and_chunk(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:  # chains and dense clusters
        for _ in range(25):
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").cache()
    want = slow_components(signed, fps)
    for chunk in (16, 4096):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, 3, chunk)).collect()}
        assert [roots.get(s, s) for s in signed] == want


def test_block_choices_keep_links():
    assert [simhash.blocks_for(n, 3) for n in (10, 10**6, 10**8, 10**10)] == [1, 1, 2, 3]
    for m in (1, 2, 3):
        assert len(simhash.bucket_keys(3, m)) == {1: 4, 2: 10, 3: 20}[m]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(df).collect() == []
    assert simhash.keep_one_per_group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_per_group(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(5, t, "a"), (2, t, "b"), (9, t + " more", "c"), (7, "something else here now", "d"), (7, "something else here now", "e"), (None, t, "f")]
    got = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    kept = sorted((str(r["doc_id"]), r["source"]) for r in got.collect())
    assert [k for k, _ in kept] == ["2", "7", "None"]


def test_components_on_hard_graphs(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loops = [(5000, 5000), (None, 3)]
    df = spark.createDataFrame([Row(a=a, b=b) for a, b in path + star + loops], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(df.limit(0)).collect() == []


def test_several_fingerprints_find_more_near_copies_and_no_strangers(spark):
    rng = random.Random(7)
    rows, family = [], {}
    for f in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(250)]
        for c in range(2):
            rows.append((len(rows), " ".join(w)))
            family[len(rows) - 1] = f
            w = list(w)
            w[rng.randrange(250)] = "edit"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for k in (1, 4):
        got = simhash.simhash_components(df, prints=k).collect()
        assert all(family[r["doc_id"]] == family[r["component_id"]] for r in got)
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{slow_fingerprint(t):016x}" for d, t in rows}
        found[k] = sum(r["component_id"] != r["doc_id"] for r in got)
    assert found[4] > found[1] and found[4] >= 54
    assert simhash.keep_one_per_group(df, prints=4).count() == len(rows) - found[4]
