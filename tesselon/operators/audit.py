"""Claims: admission, contradiction pairs, span integrity, word and number support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions import text as tx
from tesselon.functions.scalars import line_of
from tesselon.operators.joins import chunked_join, rank_in_bits, rarest_but_one
from tesselon.session import materialize

# --- fixed values ---------------------------------------------------------------------------------------
_QUANTITY = r"\b(\d+(?:[.,]\d+)?\s*(?:k|m|ms|s|%|rps|rpm|qps)?|q[1-4]|20\d{2})\b"
_DATE = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
_DECIDED = r"\bwe (?:decided|chose|agreed|set|shipped|committed)\b"
_CONTRACT = r"\bthe (?:contract|spec|sla|agreement) says\b"
_PERFORMANCE = r"\bslas?\b|\b(rps|qps|rpm|throughput|latency|p99|p95|capped|retries|attempts)\b"
GLUE = (
    "about above after again against along already also although always among another anything around because become becomes been before behind "
    "being below beneath beside between beyond both cannot could different does doing done during each either enough entire even every except "
    "further given gives hence here however immediately include included includes including inside instead into itself just keeps later least less "
    "letting like made make makes making many meant might more most much must neither never next none normally nothing often once only onto other "
    "others otherwise over overall particular perhaps rather really same several shall should similar simply since some someone something sometimes "
    "still such take taken takes than that their them themselves then there therefore these they thing things this those though through throughout "
    "thus together toward towards under until upon used uses using usually various very well were what when whenever where whether which while whole "
    "whose will with within without would your manages plus split work service across commit one two three four five six seven eight nine"
).split()
NEGATED = r"\bnever\b|\bnot\b|\bwithout\b|\b(cannot|can't|won't|doesn't|don't|isn't|aren't|wasn't|weren't|nor|none|nothing)\b"
# ---------------------------------------------------------------------------------------------------------


def looks_like_claim(c: Column) -> Column:
    """STR-34: a statement with a quantity, date, decision, contract or performance term."""
    t = tx.clean_caption(c)
    return (F.length(t) >= 8) & tx.matches(t, "|".join([_QUANTITY, _DATE, _DECIDED, _CONTRACT, _PERFORMANCE]), True)


def _features(claims: DataFrame, suffix: str, within: str | None) -> DataFrame:
    n = F.col(f"norm_{suffix}")
    group = F.col(within) if within else F.lit(0)
    out = claims.select(*[F.col(c).alias(f"{c}_{suffix}") for c in ("id", "speaker")], group.alias("g"), tx.claim_normalize(F.col("text")).alias(f"norm_{suffix}"))
    out = out.withColumns({f"kw_{suffix}": tx.claim_keywords(n), f"neg_{suffix}": tx.claim_negated(n), f"qty_{suffix}": tx.claim_quantities(n)})
    return out.withColumns({
        f"time_{suffix}": tx.schedule_words(F.col(f"kw_{suffix}")),
        f"sched_{suffix}": F.arrays_overlap(F.col(f"kw_{suffix}"), tx.strings(tx.SCHEDULE)),
        f"speaker_{suffix}": F.lower(f"speaker_{suffix}"),
    })


def contradiction_pairs(current: DataFrame, history: DataFrame, within: str | None = None, rows: int | None = None) -> DataFrame:
    """JOIN-07: (id, related_id) of claims and supported past claims that cannot both stand, of one ``within`` group if given.

    Two lines are related by their speaker and a shared keyword, by two shared keywords, or by schedule words in both. Each way is a key
    of its own: speaker and word; a word that is not a line's most frequent one (of two shared words one always is
    not); the schedule. Keys carry what opposes lines (negation, quantities, antonyms, times) as a few numbers, so pairs that cannot be
    opposed never leave the join, and hot keys are cut into pairs of chunks of ``rows``. The texts' features meet the
    pairs that are left, and the rule is checked on these.
    """
    a, b = _features(current, "a", within), _features(history.filter(F.col("status") == "supported"), "b", within)
    a, b = materialize(a, "claims"), materialize(b, "past-claims")

    both = a.select(F.explode("kw_a").alias("w")).unionByName(b.select(F.explode("kw_b").alias("w")))
    counts = materialize(both.groupBy("w").agg(F.count("*").alias("n")), "claim-words")

    def keyed(df: DataFrame, s: str) -> DataFrame:
        c = lambda k: F.col(f"{k}_{s}")
        has = lambda w: F.array_contains(c("kw"), w)
        marks = df.select(
            "g", c("id"), c("speaker"), c("kw"), c("sched"), c("neg").alias(f"not_{s}"),
            F.when(F.size(c("qty")) > 0, F.xxhash64(F.sort_array(c("qty")))).alias(f"qh_{s}"), F.xxhash64(F.sort_array(c("time"))).alias(f"th_{s}"),
            rank_in_bits([has(x) for x, _ in tx.ANTONYMS]).alias(f"x_{s}"), rank_in_bits([has(y) for _, y in tx.ANTONYMS]).alias(f"y_{s}"))
        mark = ["g", f"id_{s}", f"not_{s}", f"qh_{s}", f"th_{s}", f"x_{s}", f"y_{s}"]
        words = marks.select(*mark, f"speaker_{s}", F.explode(f"kw_{s}").alias("w"))
        spoken = words.filter(f"speaker_{s} is not null").select(*mark, F.concat(F.lit("s:"), "w", F.lit(":"), f"speaker_{s}").alias("k"))
        shared = rarest_but_one(words.drop(f"speaker_{s}"), ["g", f"id_{s}"], counts).select(*mark, F.concat(F.lit("w:"), "w").alias("k"))
        planned = marks.filter(f"sched_{s}").select(*mark, F.lit("#schedule").alias("k"))
        return materialize(spoken.unionByName(shared).unionByName(planned), "claim-keys")

    l, r = (lambda c: F.col(f"l.{c}_a")), (lambda c: F.col(f"r.{c}_b"))  # noqa: E741
    differ = (
        (l("not") != r("not")) | F.coalesce(l("qh") != r("qh"), F.lit(False))
        | (l("x").bitwiseAND(r("y")) != 0) | (l("y").bitwiseAND(r("x")) != 0) | ((F.col("l.k") == "#schedule") & (l("th") != r("th")))
    )
    found = chunked_join(keyed(a, "a"), keyed(b, "b"), ["g", "k"], (l("id") != r("id")) & differ, rows).select("g", "id_a", "id_b").distinct()
    pairs = found.join(a, ["g", "id_a"]).join(b, ["g", "id_b"])
    related = (
        (F.col("speaker_a") == F.col("speaker_b")) | (F.size(F.array_intersect("kw_a", "kw_b")) >= 2)
        | (F.col("sched_a") & F.col("sched_b"))
    )
    side = lambda s: {k: F.col(f"{k}_{s}") for k in ("kw", "neg", "qty", "time")}
    opposed = pairs.filter(related & tx.says_opposite(side("a"), side("b")))
    return opposed.select(F.col("id_a").alias("id"), F.col("id_b").alias("related_id")).distinct()


def mark_contradicted(current: DataFrame, history: DataFrame, within: str | None = None) -> DataFrame:
    """JOIN-07, STM-16: ``current`` with status ``contradicted`` and the sorted related ids where there are any.

    ``within`` (a meeting, a tenant) bounds what a line is held against; without it every line meets all that share a word.
    """
    found = contradiction_pairs(current, history, within).groupBy("id").agg(F.sort_array(F.collect_set("related_id")).alias("related_ids"))
    out = current.join(found, "id", "left")
    return out.withColumn("status", F.when(F.col("related_ids").isNotNull(), "contradicted").otherwise(F.col("status")))


def span_failure(span_hash: Column, start: Column, end: Column, text: Column, start_line: Column, content: Column, content_hash: Column) -> Column:
    """SCL-09: the first failure of a cited span: STALE, OUT_OF_BOUNDS, TEXT_MISMATCH, LINE_MISMATCH; null if sound."""
    return (
        F.when(~span_hash.eqNullSafe(content_hash), "STALE")
        .when((start < 0) | (end > F.length(content)) | (start >= end), "OUT_OF_BOUNDS")
        .when(F.substring(content, start + 1, end - start) != text, "TEXT_MISMATCH")
        .when(line_of(content, start) != start_line, "LINE_MISMATCH")
    )


def content_tokens(say: Column, glue: list[str] = GLUE) -> Column:
    """STR-37: distinct words of four characters or more, outer punctuation cut, without glue words."""
    trimmed = F.transform(F.split(F.lower(say), r"\s+"), lambda w: F.regexp_replace(w, "^[^a-z0-9_]+|[^a-z0-9_]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda w: (F.length(w) >= 4) & ~(w.isin(list(glue)) if glue else F.lit(False))))


def missing_words(say: Column, corpus: Column, glue: list[str] = GLUE) -> Column:
    """STR-37: content words of a line that the evidence does not contain; empty means support."""
    low = F.lower(corpus)
    return F.filter(content_tokens(say, glue), lambda w: ~low.contains(w))


def numbers_supported(say: Column, anchored: Column, corpus: Column) -> Column:
    """STR-39: every number of the line stands in the anchored passage (in the corpus if that has none)."""
    nums = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    pool = F.when(F.size(nums(anchored)) > 0, nums(anchored)).otherwise(nums(corpus))
    return F.size(F.array_except(nums(say), pool)) == 0


def extractive(say: Column, corpus: Column) -> Column:
    """STR-40: the line, twelve characters or more, is a substring once white space and case are level."""
    level = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    return (F.length(level(say)) >= 12) & level(corpus).contains(level(say))


def ordered_tokens(tokens: Column, corpus: Column) -> Column:
    """STR-40: the tokens occur in the corpus one after the other."""
    def step(pos: Column, t: Column) -> Column:
        at = F.call_function("locate", t, corpus, pos + 1)
        return F.when(pos < 0, pos).when(at == 0, F.lit(-1)).otherwise(at - 1 + F.length(t))

    return F.aggregate(tokens, F.lit(0), step) >= 0


def negation_flags(c: Column) -> dict[str, Column]:
    """STR-38: never, not, without and any negation at all."""
    low = F.lower(c)
    return {k: tx.matches(low, rf"\b{k}\b") for k in ("never", "not", "without")} | {"any": tx.matches(low, NEGATED)}


def citation_numbers(c: Column) -> Column:
    """STR-27, JOIN-13: numbers of [n] markers, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_citations(c: Column) -> Column:
    """STR-27."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\[\d+\]", ""), r"\s+", " "))
