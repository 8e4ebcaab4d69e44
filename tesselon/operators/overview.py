"""ANS-08, SRT-12: what a pack of files is, said from its entry files, its framework and its directories.

All of it is grouped by pack: entry files are a top-k window, the framework is the first pattern of the first file that shows
one, directories and the components under them are counts. Texts are read for the candidates and for the first files of a pack alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import say
from tesselon.operators.contract import prose

# --- fixed values ---------------------------------------------------------------------------------------
ENTRY_FILES, FRAMEWORK_FILES, DIRECTORIES, CAPABILITIES, THIN = 6, 60, 4, 4, 60
FRAMEWORKS = [
    (r"(?i)\bFastAPI\s*\(|\bfrom\s+fastapi\b", "FastAPI"), (r"(?i)\bFlask\s*\(|\bfrom\s+flask\b", "Flask"),
    (r"(?i)\bdjango\.(?:conf|urls|db)\b|DJANGO_SETTINGS_MODULE", "Django"), (r"""(?i)\bexpress\s*\(\)|require\(["']express["']\)|from\s+["']express["']""", "Express"),
    (r"@nestjs\/", "NestJS"), (r"\bSpringApplication\b|@SpringBootApplication\b", "Spring Boot"), (r"\bnext\/(?:app|document|server)\b", "Next.js"),
    (r"\buse\s+axum\b|\bactix_web\b", "Rust web"), (r"\bgin\.(?:New|Default)\(\)|net\/http", "Go service"),
]
ENTRY_RULES = [(r"(^|/)readme\.[a-z]+$", 8), (r"(architecture|adr)", 5), (r"(^|/)(src|api|app|server|cmd)/", 3), (r"\.(json|yml|yaml|lock)$", -6)]
MAIN_FILE, README = r"(^|/)(main|app|index|server|api|router)\.[a-z]+$", r"(^|/)readme\.[a-z]+$"
NOT_A_PART = r"(?i)^(__pycache__|tests?|node_modules)$"
GENERIC = r"(?i)^(src|lib|libs|app|apps|docs?|tests?|scripts?|public|static|assets|styles|utils|config|types|build|dist|vendor|node_modules|migrations)$"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
# ---------------------------------------------------------------------------------------------------------


def entry_rank(path: Column) -> Column:
    """How much a path looks like the place where a pack says what it is; a main file counts near the root only."""
    low = F.lower(path)
    depth = F.size(F.split(low, "/"))
    score = F.when(low.rlike(MAIN_FILE) & (depth <= 2), 10).otherwise(0) + F.when(depth > 3, -4).otherwise(0)
    return score + sum((F.when(low.rlike(p), n).otherwise(0) for p, n in ENTRY_RULES), F.lit(0))


def entry_files(files: DataFrame) -> DataFrame:
    """SRT-12: (pack_id, path, place): of each pack the six files with the best rank (ties by path), then its readmes."""
    best = Window.partitionBy("pack_id").orderBy(F.desc(entry_rank(F.col("path"))), "path")
    top = files.select("pack_id", "path").withColumn("rn", F.row_number().over(best))
    kept = top.filter((F.col("rn") <= ENTRY_FILES) | F.lower("path").rlike(README))
    group = F.when(F.col("rn") <= ENTRY_FILES, F.col("rn"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.asc_nulls_last(group), "path"))).drop("rn")


def frameworks(files: DataFrame) -> DataFrame:
    """(pack_id, framework): the first pattern found in the first file, of a pack's first sixty by path, that shows any."""
    order = Window.partitionBy("pack_id").orderBy("path")
    first = files.select("pack_id", "path").withColumn("no", F.row_number().over(order)).filter(F.col("no") <= FRAMEWORK_FILES)
    named = F.coalesce(*[F.when(F.col("content").rlike(p), name) for p, name in FRAMEWORKS])
    met = first.join(files.select("pack_id", "path", named.alias("framework")).filter("framework is not null"), ["pack_id", "path"])
    return met.groupBy("pack_id").agg(F.min_by("framework", "no").alias("framework"))


def parts(files: DataFrame) -> DataFrame:
    """(pack_id, dir, n): of the four largest top directories the one with most named components under it, two at least, whose name can be spoken.

    Directories that begin with a dot are tooling; ties of size go by name.
    """
    path = F.col("path")
    top = files.filter(path.contains("/") & ~path.startswith(".")).select("pack_id", path, F.substring_index(path, "/", 1).alias("dir"))
    large = top.groupBy("pack_id", "dir").agg(F.count("*").alias("files"))
    large = large.withColumn("rn", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.desc("files"), "dir"))).filter(F.col("rn") <= DIRECTORIES)
    below = top.withColumn("s", F.split(path, "/")).filter(F.size("s") >= 3).select("pack_id", "dir", F.element_at("s", 2).alias("part"))
    below = below.filter((F.col("part") != "") & ~F.col("part").rlike(NOT_A_PART)).groupBy("pack_id", "dir").agg(F.count_distinct("part").alias("n"))
    good = below.join(large, ["pack_id", "dir"]).filter((F.col("n") >= 2) & ~F.col("dir").rlike(GENERIC) & F.col("dir").endswith("s"))
    main = Window.partitionBy("pack_id").orderBy(F.desc("n"), "rn")
    return good.withColumn("m", F.row_number().over(main)).filter("m = 1").select("pack_id", "dir", "n")


def architecture_cards(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """ANS-08: (pack_id, path, framework, dir, components, say) of each pack that says anywhere what it does.

    ``files`` are (pack_id, path, content), ``names`` (pack_id, name); without a name the pack's id is said. The purpose is the description of the first
    entry file that has one; a thin one (under 60 characters) is followed by up to four of the file's capabilities, if it lists two. Null
    contents say nothing; a pack without a purpose has no row.
    """
    candidates = entry_files(files)
    texts = files.join(candidates.select("pack_id", "path"), ["pack_id", "path"], "left_semi").withColumn("content", F.coalesce("content", F.lit("")))
    # prose() knows paths alone, so the pack is put before its path
    one = F.concat_ws("\x00", F.to_json(F.struct("pack_id")), "path")
    told = prose(texts.select(one.alias("path"), "content"))
    ids = texts.select(one.alias("id"), "pack_id", "path")
    told = told.withColumnRenamed("path", "id").join(ids, "id").filter("description is not null")
    first = told.join(candidates, ["pack_id", "path"]).groupBy("pack_id").agg(F.min_by(F.struct("path", "description", "capabilities"), "place").alias("t"))
    out = first.join(frameworks(files), "pack_id", "left").join(parts(files), "pack_id", "left")
    out = out.withColumn("name", F.col("pack_id").cast("string")) if names is None else out.join(names.select("pack_id", "name"), "pack_id", "left")
    caps = F.slice(F.coalesce("t.capabilities", F.array().cast("array<string>")), 1, CAPABILITIES)
    purpose = F.regexp_replace(F.col("t.description"), r"[.!?\s]+\z", "")
    listed = (F.size(caps) >= 2) & (F.length("t.description") < THIN)
    number = F.coalesce(F.try_element_at(F.array(*map(F.lit, NUMBERS)), F.col("n").cast("int")), F.col("n").cast("string"))
    split_ = F.concat(F.lit(" Work is split across "), number, F.lit(" "), F.trim(F.regexp_replace("dir", "[-_]+", " ")), F.lit("."))
    said = F.concat(
        F.coalesce("name", F.col("pack_id").cast("string")), F.lit(" is a "), F.coalesce(F.concat("framework", F.lit(" ")), F.lit("")), F.lit("service — "), purpose,
        F.when(listed, F.concat(F.lit(": "), say.list_phrase(caps))).otherwise(""), F.lit("."), F.coalesce(split_, F.lit("")),
    )
    return out.select("pack_id", "t.path", "framework", "dir", F.coalesce("n", F.lit(0)).alias("components"), said.alias("say"))
