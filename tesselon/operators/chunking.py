"""Chunking: line windows, commit chunks, interval cuts, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_LINES, WINDOW_STEP = 28, 22


def line_windows(files: DataFrame, path: str = "path", content: str = "content", size: int = WINDOW_LINES, step: int = WINDOW_STEP) -> DataFrame:
    """CHK-01, CHK-15, WIN-08: windows of ``size`` lines every ``step`` lines, up to the first that reaches the end.

    Adds chunk_id, kind, start_line, end_line, start_offset (characters), chunk_no, text to the other
    columns; one trailing newline is dropped first. A null content is one empty line.
    """
    body = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\n\z", "")
    rows = files.withColumn("__lines", F.split(body, "\n")).drop(content)
    n = F.size("__lines")
    # a window is needed if it is the first or the one before it ended short of the last line
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    # characters of every step's lines, each counted once, and before each step those of all before it
    chars = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice("__lines", i * step + 1, F.lit(step)), F.lit(0), lambda a, x: a + F.length(x) + 1))
    nothing = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("before"))
    ahead = F.aggregate(F.when(last > 0, chars).otherwise(F.array(F.lit(0))), nothing, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["before"], a["s"]).alias("before")))
    rows = rows.withColumn("__before", ahead["before"])
    window = lambda i: F.struct(i.alias("no"), F.slice("__lines", i * step + 1, F.lit(size)).alias("part"), F.get("__before", i).alias("before"))
    # a window's row carries its own lines alone
    rows = rows.withColumn("__w", F.explode(F.transform(F.sequence(F.lit(0), last), window))).drop("__lines", "__before")
    start = F.col("__w.no") * step
    rows = rows.withColumns({
        "chunk_no": F.col("__w.no"), "kind": F.lit("code"), "start_line": start + 1, "end_line": start + F.size("__w.part"),
        "start_offset": F.col("__w.before"), "text": F.array_join("__w.part", "\n"),
    }).drop("__w")
    return rows.withColumn("chunk_id", F.concat_ws(":", F.col(path).cast("string"), F.concat_ws("-", "start_line", "end_line")))


def commit_chunks(commits: DataFrame) -> DataFrame:
    """CHK-02: one chunk of kind ``why`` a commit, its message and files as text."""
    files = F.array_join(F.coalesce("files", F.array().cast("array<string>")), "\n")
    return commits.select(
        "pack_id", F.concat(F.lit("commit:"), "sha").alias("chunk_id"), F.lit("why").alias("kind"),
        F.concat(F.lit("commits/"), "sha").alias("path"), "sha", "author", "date", "message", "pr",
        F.concat_ws("\n", "message", files).alias("text"),
    )


def sentence_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """CHK-07: a row a sentence with its number; other columns stay."""
    from tesselon.functions.text import sentences

    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(sentences(F.col(text))).alias("sentence_no", "sentence"))


def subtract_ranges(spans: DataFrame, banned: DataFrame, key: str = "id") -> DataFrame:
    """CHK-10: the parts [start, end) of each span that no banned range of the same key covers.

    Gaps and islands: banned ranges are clipped, merged by a running maximum, and the gaps between them kept.
    """
    b = banned.select(key, F.col("start").alias("b0"), F.col("end").alias("b1")).filter("b1 > b0")
    own = spans.select(key, "start", "end").filter("end > start").distinct()
    cuts = own.join(b, key).filter((F.col("b0") < F.col("end")) & (F.col("b1") > F.col("start"))).select(
        key, "start", "end", F.greatest("b0", "start").alias("c0"), F.least("b1", "end").alias("c1")
    )
    # the span's own edges are cuts of no length
    edge = own.select(key, "start", "end", F.col("start").alias("c0"), F.col("start").alias("c1")).union(
        own.select(key, "start", "end", F.col("end").alias("c0"), F.col("end").alias("c1"))
    )
    w = Window.partitionBy(key, "start", "end").orderBy("c0", "c1")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = cuts.union(edge).withColumn("from", reach).withColumn("to", F.lead("c0").over(w))
    return out.filter("to > from").select(key, F.col("from").alias("start"), F.col("to").alias("end")).distinct()


def overlaps(start: Column, end: Column, banned: Column) -> Column:
    """CHK-11: whether [start, end) meets any range of an array of (start, end)."""
    return F.exists(banned, lambda r: (r["start"] < end) & (r["end"] > start))


def pack_greedy(sizes: Column, cap: int) -> Column:
    """CHK-09: group numbers of adjacent items packed up to ``cap``; a fold that starts anew on overflow."""
    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["g"] >= 0) & (acc["used"] + x <= cap)
        g = F.when(fits, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(
            g.alias("g"), F.when(fits, acc["used"] + x).otherwise(x.cast("long")).alias("used"),
            F.concat(acc["out"], F.array(g)).alias("out"),
        )

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def chunk_mismatches(chunks: DataFrame, sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """CHK-13: chunks whose text isn't what their source holds at their offset."""
    s = sources.select(F.col(path).alias("__p"), F.col(content).alias("__c"))
    found = chunks.join(s, F.col(path) == F.col("__p"), "left")
    at = F.substring("__c", F.col("start_offset") + 1, F.length("text"))
    return found.filter(~at.eqNullSafe(F.col("text"))).drop("__p", "__c")


def clean_prefix(c: Column) -> Column:
    """CHK-16: lower-cased path prefix of letters, digits, dots, dashes and underscores; runs of others one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
