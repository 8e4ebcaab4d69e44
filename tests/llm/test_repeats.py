import hashlib

import numpy as np
import pytest

from tesselon.llm import repeats
from tesselon.llm.queries import op11_suffix_dedup

SCHEMA = "doc_id long, text string, block long, data string, spans int"


def slow(rows, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, digest of the rest) by a table of all windows."""
    first, big = {}, 1 << 63
    texts = [(big if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, t in texts:
        for p in range(len(t) - window + 1):
            first[t[p : p + window]] = min(k, first.get(t[p : p + window], big + 1))
    out = []
    for k, i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < k:
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((-1 if i is None else i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def met(spark, rows, window=50):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], sum(e - s for s, e in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in repeats.remove_repeats(df, window).collect()
    )


def corpus(seed, docs=120):
    rng = np.random.default_rng(seed)
    word = ["é", "ab", "word", "some", "long", "texts", "x" * 30, "\n"]
    passage = " ".join(rng.choice(word, 60))
    near = list(rng.choice(word, 80))
    rows = []
    for i in rng.permutation(docs):
        own = " ".join(rng.choice(word[:-2], 30)) + str(rng.integers(1 << 40))
        kind = i % 4
        if kind == 0:
            own = own[: int(rng.integers(60))] + passage + own
        elif kind == 1:
            mine = near.copy()
            mine[int(rng.integers(80))] = "changed"
            own = " ".join(mine)
        elif kind == 2:
            own = own + passage[int(rng.integers(30)) : int(rng.integers(60, 150))] + own
        rows.append((int(i), own))
    return rows


@pytest.mark.parametrize("block,frequent,run", [(4 << 20, 2000, 128), (700, 2000, 128), (5000, 5, 9), (900, 0, 3)])
def test_against_brute_force(spark, monkeypatch, block, frequent, run):
    # small blocks, so that strings meet across blocks and a document is several pieces; and anchors frequent from few documents on
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "STRING_WINDOWS", run)
    rows = corpus(block + frequent)
    assert met(spark, rows) == slow(rows)


def test_edges(spark, monkeypatch):
    a = "the first fifty bytes of this text are repeated in others, é to é, and some are not"
    rows = [(None, a), (None, a), (None, None), (1, ""), (2, None), (3, a), (3, a), (3, a + "tail"), (4, a), (5, "z" * 300), (6, "z" * 49), (7, "y" * 20 + "z" * 50),
            (7, "x" * 50), (8, "x" * 51), (9, "x" * 49), (-5, a[10:]), (10, "ab" * 500 + a), (11, "ab" * 400)]
    want = slow(rows)
    assert met(spark, rows) == want
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 64)
    assert met(spark, rows) == want
    assert met(spark, rows, window=10) == slow(rows, 10) and met(spark, rows, window=3) == slow(rows, 3)
    assert met(spark, []) == [] and met(spark, [(1, None)]) == slow([(1, None)])


def test_one_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1 << 16)
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 300_000)))
    rows = [(2, text), (1, text[100_000:100_500] + "!" + text[:60]), (3, text[150_000:260_000])]
    assert met(spark, rows) == slow(rows)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11_suffix_dedup(spark, sf).collect()) == slow(rows)


def test_tables_of_blocks_are_forgotten(spark):
    met(spark, [(1, "some text")])
    assert repeats.forget_blocks(spark) > 0 and repeats.forget_blocks(spark) == 0
