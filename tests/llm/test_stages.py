"""Every stage of the pipeline on what its predecessor kept, against brute force; near copies by five-word Jaccard at 0.8."""

from collections import Counter

import corpus_pipeline as cp
import numpy as np
from test_neardup import grams, slow_kept

from tesselon.llm import mixing, toxicity
from tesselon.llm.queries import op9_shard, table


def test_stages_in_turn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, steps = docs.columns, dict(cp.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = steps["toxicity"](spark, docs, sf_dir).cache()
    verdict = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and kept == {d for d, t in verdict.items() if not t} and 0 < len(kept) < len(rows)

    single = steps["simhash_near_dedup"](spark, clean, sf_dir).cache()
    ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == columns and ids == slow_kept({d: rows[d] for d in kept}) and len(ids) < len(kept)

    safe = steps["benchmark_decontamination"](spark, single, sf_dir).cache()
    items = [g for r in table(spark, sf_dir, "benchmark").collect() if (g := grams(r["text"]))]
    dirty = {d for d in ids for g in [grams(rows[d])] if any(len(i & g) >= 0.8 * len(i) for i in items)}
    safe_ids = {r["doc_id"] for r in safe.collect()}
    assert safe.columns == columns and safe_ids == ids - dirty and dirty

    mixed = steps["mixing"](spark, safe, sf_dir).cache()
    words, source, size = Counter(), {}, Counter()
    for r in safe.collect():
        source[r["doc_id"]] = r["source"]
        size[r["source"]] += len((r["text"] or "").split())
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
        assert (rows[r["doc_id"]] or "").split()[: len(r["text"].split())] == r["text"].split()
    want, got = mixing.targets(dict(size)), Counter()
    for d, n in words.items():
        assert n <= 3 * len(rows[d].split())
        got[source[d]] += n
    assert mixed.columns == columns and all(abs(got[s] - want[s]) <= 1 for s in want)

    out = steps["sharding"](spark, mixed, sf_dir).collect()
    per = Counter(r["shard"] for r in out)
    assert len(out) == mixed.count() and max(per.values()) - min(per.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_mixed_rows_come_by_shard_and_in_shuffled_order(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"w{i} " * 20) for i in range(200)], "doc_id long, source string, text string")
    plan = mixing.plan_mix(docs, block_words=1 << 40)
    place = {}
    for r in plan.collect():
        for d in r["draws"]:
            place.setdefault(r["doc_id"], set()).add((d["shard"], d["order_key"]))
    parts = mixing.mixed_documents(docs).rdd.map(lambda r: r["doc_id"]).glom().collect()
    for part in parts:
        # a document drawn once has one place; those of a partition rise
        places = [next(iter(place[d])) for d in part if len(place[d]) == 1]
        assert places == sorted(places)
    assert sorted({s for p in place.values() for s, _ in p}) == list(range(16))


def test_stages_take_empty_and_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 50_000, "en", None, 250_000), (3, "a b c", None, "s", 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema if name != "sharding" else f"{schema}, shard int, slot long")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and (docs.count() > 0) == bool(rows)


def test_registered_sharding_keeps_its_law(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = op9_shard(spark, sf_dir).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {d: len((t or "").encode()) + 1 for d, t in docs.items()} and len(got) == len(docs)
    per = np.bincount([r["shard"] for r in got], minlength=16)
    assert per.max() - per.min() <= 1 and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))


def test_registered_simhash_against_brute_force(spark, sf_dir):
    from tesselon.llm import simhash
    from tesselon.llm.queries import op7_simhash

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    fp = {d: simhash.fingerprint(t) for d, t in docs.items()}
    values = np.array([fp[d] for d in sorted(fp)], np.uint64)
    ids, root = sorted(fp), {}
    for i, d in enumerate(ids):
        if d in root:
            continue
        stack, root[d] = [i], d
        while stack:
            x = stack.pop()
            for j in np.flatnonzero(np.bitwise_count(values ^ values[x]) <= 3):
                if ids[j] not in root:
                    root[ids[j]] = d
                    stack.append(int(j))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op7_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{fp[d]:016x}", root[d]) for d in ids}
