"""The registry of queries and what the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders and endings that stand in for a source tree: a document's path is made of its number.
FOLDERS = [
    "src/services", "docs", "tests", "lib/api", "container-lambdas/ingest", "node_modules/x", "apps/web/routes", ".github/workflows",
    "contracts", "src/a/b/c/d/e/f/g/h", "",
]
ENDINGS = [".ts", ".md", ".test.ts", ".docx", ".json", ".py", ".min.js", ".yml", "/package-lock.json", ".png", ""]


def tree_path(doc_id: str = "doc_id"):
    """A path like ``docs/doc17.md``; folder and ending change at different paces, so all combinations occur."""
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    i = F.col(doc_id)
    folder, ending = pick(FOLDERS, i), pick(ENDINGS, F.floor(i / 11))
    return F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), F.lit("doc"), i.cast("string"), ending)


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: The same in SQL, as an expression of doc_id.
TREE_PATH = (
    f"(CASE {_LIST(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] WHEN '' THEN '' ELSE {_LIST(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/' END"
    f" || 'doc' || doc_id || {_LIST(ENDINGS)}[(doc_id // 11) % {len(ENDINGS)} + 1])"
)
