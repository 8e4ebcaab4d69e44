"""Tenant scope, exclusion patterns and path selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import text as tx

# --- fixed values ---------------------------------------------------------------------------------------
MAX_FILE, MAX_OFFICE, MAX_JSON = 150_000, 4_000_000, 12_000
MAX_FILES, MAX_BYTES = 500, 8_000_000
_SCORE_RULES = [
    (r"(^|/)(src|lib|internal|pkg|cmd|app|apps|services|service|api|server|core|backend|domain|handlers|usecase)(/|$)", 10),
    (r"\.(ts|tsx|go|py|java|rs|kt)$", 6), (r"\.(docx|xlsx|csv|ppt|pptx)$", 8), (r"\.(js|jsx|rb|cs)$", 3),
    (r"(adr|architecture|rfc|design-doc)", 7), (r"(^|/)docs/.*\.md$", 4),
    (r"\.(spec|test|e2e)\.|(^|/)(__tests__|testdata|fixtures|mocks|stories|e2e)(/|$)", -10),
    (r"(^|/)(migrations|fixtures|snapshots|__snapshots__)(/|$)", -6),
    (r"(jenkins|_scm_|github/workflows|environment-mapping|site-packages|dist-packages|deno-deck-venv)", -40),
    (r"(^|/)__init__\.py$", -5), (r"\.json$", -2),
]
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "md": "md", "mdx": "md"}
# ---------------------------------------------------------------------------------------------------------


@dataclass
class Scope:
    workspace_id: str
    space_id: str | None = None
    context_ids: list[str] = field(default_factory=list)
    source_ids: list[str] = field(default_factory=list)


def in_scope(scope: Scope) -> Column:
    """FLT-05: workspace, space and context tags pass if null or right; a source must be listed if any are."""
    tag = lambda c, ok: F.col(c).isNull() | ok
    rule = tag("workspace_id", F.col("workspace_id") == scope.workspace_id)
    if scope.space_id is not None:
        rule = rule & tag("space_id", F.col("space_id") == scope.space_id)
    if scope.context_ids:
        rule = rule & tag("context_id", F.col("context_id").isin(scope.context_ids))
    if scope.source_ids:
        rule = rule & F.col("source_id").isin(scope.source_ids)
    return rule


def assert_scope(chunks: DataFrame, scope: Scope) -> DataFrame:
    """FLT-06: the same rows; one out of scope fails the job when it is read."""
    message = F.concat(F.lit("out of scope: chunk "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("?")))
    return chunks.filter(F.when(in_scope(scope), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def tag_scope(chunks: DataFrame, workspace_id: str, space_id: str, context_id: str) -> DataFrame:
    """FLT-07: workspace and space set, context only where it is null."""
    return chunks.withColumns({
        "workspace_id": F.lit(workspace_id), "space_id": F.lit(space_id), "context_id": F.coalesce("context_id", F.lit(context_id))
    })


def glob_regex(pattern: str) -> str:
    """FLT-04: ``**`` any characters, ``*`` and ``?`` none of them a slash."""
    import re

    parts = re.split(r"(\*\*|\*|\?)", pattern)
    meaning = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(p, re.escape(p)) for p in parts) + r"\z"


def excluded(path: Column, patterns: list[str]) -> Column:
    """FLT-03: whether a glob matches, or a plain pattern is the path or a suffix of it after a slash."""
    out = F.lit(False)
    for p in dict.fromkeys(x.strip().strip("/") for x in patterns):
        if not p:
            continue
        out = out | (path.rlike(glob_regex(p)) if "*" in p or "?" in p else (path == p) | path.endswith(f"/{p}"))
    return out


def excluded_counts(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """FLT-08: (total, excluded, all_excluded) over distinct paths."""
    out = paths.select("path").distinct().agg(F.count("*").alias("total"), F.count_if(excluded(F.col("path"), patterns)).alias("excluded"))
    return out.withColumn("all_excluded", (F.col("total") > 0) & (F.col("total") == F.col("excluded")))


def distinct_patterns(patterns: Column) -> Column:
    """SET-04: patterns without outer white space and slashes, empty ones and repeats left out, first places kept."""
    bare = F.transform(patterns, lambda p: F.regexp_replace(F.trim(p), "^/+|/+$", ""))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


def toggle(patterns: Column, path: Column) -> Column:
    """SET-09: the path taken out if it is there, else put at the end."""
    return F.when(F.array_contains(patterns, path), F.array_except(patterns, F.array(path))).otherwise(F.array_append(patterns, path))


def path_score(path: Column) -> Column:
    """SRC-08: sum of the weights of the patterns that a path meets, and of its depth."""
    p = F.lower(path)
    s = F.lit(0)
    for pattern, w in _SCORE_RULES:
        s = s + F.when(tx.matches(p, pattern), w).otherwise(0)
    s = s + F.when(tx.matches(p, r"\.(yml|yaml)$") & ~tx.matches(p, r"(^|/)(src|docs)/"), -8).otherwise(0)
    depth = F.size(F.split(p, "/"))
    return s + F.when(depth <= 4, 2).when(depth > 8, -2).otherwise(0)


def language_of(path: Column) -> Column:
    """STR-30: language by extension; the extension itself where it has none, txt without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(ext == "", "txt").otherwise(F.coalesce(F.try_element_at(known, ext), ext))


def skip_reason(path: Column, size: Column) -> Column:
    """SRC-03, SRC-04: why a file is left out, null if it isn't."""
    p = F.lower(path)
    office, json = tx.matches(p, r"\.(docx|xlsx|csv|ppt|pptx)$"), tx.matches(p, r"\.json$")
    return (
        F.when(tx.matches(p, r"(^|/)(node_modules|vendor|dist|build|target|\.git|\.next|\.venv|venv|__pycache__)/"), "vendor and build folders")
        .when(tx.matches(p, r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|composer\.lock|poetry\.lock)$"), "lockfiles")
        .when(tx.matches(p, r"\.(png|jpe?g|gif|webp|ico|svg|mp[34]|mov|wav|zip|gz|tar|jar|exe|dll|so|woff2?|ttf|pdf)$"), "binaries and media")
        .when(json & (size > MAX_JSON), "large JSON")
        .when((office & (size > MAX_OFFICE)) | (~office & (size > MAX_FILE)), "files over the size limit")
    )


def looks_like_text(content: Column) -> Column:
    """SRC-09: no NUL and under 8 % control characters in the first 800."""
    head = F.substring(content, 1, 800)
    weird = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0E-\x1F]", ""))
    return ~head.contains("\x00") & (weird / F.greatest(F.length(head), F.lit(1)) < 0.08)


def prune(files: DataFrame, least: int = 2) -> DataFrame:
    """SRC-07: files whose path scores ``least`` or more, with the score."""
    return files.withColumn("score", path_score(F.col("path"))).filter(F.col("score") >= least)


def select_files(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """SRC-05, SRC-06: per pack, files by score (then path) while they fit; one too large is skipped, later ones go on.

    The running total skips what does not fit, which no window sum can say: a pack's files pass in order, and what
    is carried from one to the next are two numbers, so a pack of any size is read as a stream.
    """
    kind = files.schema["pack_id"].dataType
    rows = files.select("pack_id", "path", F.col("size").cast("long").alias("size"), path_score(F.col("path")).alias("score"))
    rows = rows.repartition("pack_id").sortWithinPartitions("pack_id", F.desc("score"), "path")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, n, total, first = None, 0, 0, True
        for b in batches:
            out = []
            for p, path, size in zip(b["pack"].tolist(), b["path"], b["size"].tolist(), strict=True):
                if first or p != pack:
                    pack, n, total, first = p, 0, 0, False
                if n < max_files and total + size <= max_bytes:
                    out.append((p, n, path))
                    n, total = n + 1, total + size
            yield pd.DataFrame(out, columns=["pack", "place", "path"])

    # keys travel as text: a null among numbers would make floats of them
    named = rows.filter("size is not null").select(F.col("pack_id").cast("string").alias("pack"), "path", "size")
    return named.mapInPandas(keep, "pack string, place int, path string").select(F.col("pack").cast(kind).alias("pack_id"), "place", "path")


def preferred_file(files: DataFrame) -> DataFrame:
    """SRT-08: of each pack the path with the highest score, ties by path."""
    w = Window.partitionBy("pack_id").orderBy(F.desc(path_score(F.col("path"))), "path")
    return files.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
