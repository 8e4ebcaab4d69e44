"""The corpus pipeline: five stages over ``documents``, each of them one operator of ``tesselon.llm``.

Every stage gets the Parquet that its predecessor wrote. All but the last return the columns of
``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import decontaminate, mixing, neardup, sharding, toxicity
from tesselon.session import shared_dir, text_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones of ``docs``, rejects go."""
    text_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    SimHash links and bands of min-hashes name the candidates. Of these, near-duplicates are texts whose distinct
    five-word shingles have a Jaccard similarity of 0.8 at least.
    """
    text_batches(spark)
    return neardup.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each document as often as drawn, by the splitting tree's shard and in its shuffled order."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot in it."""
    return sharding.shard_documents(docs, 16)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: A trained model takes part, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    import uuid

    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for no, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{no}-{name}")
        docs = spark.read.parquet(f"{base}/{no}-{name}")
    return docs
