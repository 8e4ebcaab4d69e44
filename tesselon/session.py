"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tesselon") -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    # Python workers import this package from wherever the driver was started
    paths = [str(Path(__file__).resolve().parent.parent), *filter(None, [os.environ.get("PYTHONPATH")])]
    os.environ["PYTHONPATH"] = os.pathsep.join(paths)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where none is named and the master is this machine alone (tests) is a local one made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="tesselon-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tesselon-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what lies before, and the
    planner knows the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows at a time go to a Python worker from here on; a smaller setting stays.

    For jobs whose rows carry whole texts: the default of 10,000 rows holds tens of megabytes in each
    worker and in the executor's buffers, several times over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spread_small(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its input is so small that it comes in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, texts: list[str], piece: int = 16 << 20) -> DataFrame:
    """``df`` dealt out by ``key`` into pieces of about ``piece`` characters of ``texts``, however large it is.

    What is then grouped by the key and more stays in its task, and what a task holds does not grow with the table.
    """
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // piece)), key)


def sweep(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when its results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
