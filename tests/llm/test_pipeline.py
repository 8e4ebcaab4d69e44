"""The pipeline as a whole; test_stages.py holds each stage against brute force."""

from collections import Counter

import corpus_pipeline as cp
from tesselon.llm.queries import QUERIES


def test_stages_call_the_dealt_operators():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_run_gives_the_same_rows_again(spark):
    sf = "/root/testdata/sf0.001"
    a, b = (Counter((r["doc_id"], r["n_chars"]) for r in cp.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a
