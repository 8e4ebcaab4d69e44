"""Answers to a batch of questions: subject terms, best sentence, verification, tiered routing.

Everything is keyed by query_id, so a workload of any number of questions is one plan. A model call is a
seam: any function from (query_id, prompt) rows to (query_id, say) rows; the default says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import text as tx
from tesselon.functions.dialogue import evidence_fits_shape
from tesselon.functions.scalars import share
from tesselon.functions.verify import semantic_faults
from tesselon.operators import audit
from tesselon.operators.retrieval import TEST_PATH, sized
from tesselon.session import dealt, materialize

# --- fixed values ---------------------------------------------------------------------------------------
FAST_PATH_SCORE, FAIL_FAST_SCORE = 4.0, 2.0
OFF_TOPIC = r"\b(weather|stock price|world series|capital of france|bake sourdough)\b"
PROMPT_CHUNKS, PROMPT_PER_FILE, PROMPT_CHARS = 8, 4, 1200
NOT_A_SUBJECT = (
    "what when where which how why who whose does do did doing done is are was were be been being have has had having "
    "the a an this that these those and or but for from with into about after before then there here it its our we you "
    "your they them their to of in on at by as can could should would will might must work works working worked happen "
    "happens happening handle handles handled handling use used uses using own owns owned owning make makes making made "
    "get gets getting got go goes going know knows mean means all any thing things stuff again though anymore actually "
    "really basically essentially literally honestly seriously even just also okay alright well right sorry yeah maybe guess"
).split()
OPENERS = [
    "so", "ok", "okay", "alright", "all right", "well", "right", "now", "anyway", "anyways", "basically", "essentially",
    "honestly", "actually", "seriously", "look", "listen", "see", "yeah", "yep", "yes", "um", "umm", "uh", "uhh", "er",
    "erm", "hmm", "hmmm", "wait", "hold on", "and", "but", "then", "plus", "also", "i guess", "you know", "i mean",
    "quick question", "one question", "let me ask",
]
FOLLOW_UP = r"^(?:and |or |so )?(?:(?:can you |could you )?(?:tell me more|say more|go on|explain(?: that| more)?|continue)|why(?:\s+\S+){0,2}|how does that(?: work)?|how so|what about that)\s*$"
# ---------------------------------------------------------------------------------------------------------


def content_words(q: Column) -> Column:
    """STR-10: distinct words of over two characters that can name a subject."""
    return F.array_distinct(F.filter(F.split(F.lower(q), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(NOT_A_SUBJECT)))


def strip_openers(q: Column, passes: int = 6) -> Column:
    """STR-11: up to six discourse openers at the start go, as long as three words or more stay."""
    pattern = tx.edges(rf"(?i)^\s*(?:{'|'.join(OPENERS)})\b[\s,;:—–-]*")
    out = F.trim(q)
    for _ in range(passes):
        less = F.regexp_replace(out, pattern, "")
        out = F.when(F.size(tx.nonempty(F.split(less, r"\s+"))) >= 3, less).otherwise(out)
    return out


def is_short_follow_up(q: Column) -> Column:
    """STR-12: a stock phrase, or under four content words and under seven words."""
    bare = F.trim(F.regexp_replace(F.trim(q), r"[?.!]+\z", ""))
    few = (F.size(content_words(q)) < 4) & (F.size(tx.nonempty(F.split(F.trim(q), r"\s+"))) < 7)
    return tx.matches(bare, FOLLOW_UP, True) | few


def expand_query(q: Column, previous: Column) -> Column:
    """STR-12: a short follow-up is searched with the question before it."""
    return F.when(is_short_follow_up(q) & previous.isNotNull(), F.concat_ws(" ", previous, q)).otherwise(q)


def mentions(hay: Column, term: Column) -> Column:
    """STR-17: the term, or, from six characters on, all but its last three (five at least)."""
    prefix = F.substring(term, F.lit(1), F.greatest(F.lit(5), F.length(term) - 3))
    return hay.contains(term) | ((F.length(term) >= 6) & hay.contains(prefix))


def term_file_frequency(terms: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-33: (term, df): files whose path or content mentions the term.

    The vocabulary's distinct words (not files) are tested for the substring, then joined to the files that hold them.
    """
    hay = F.lower(F.concat_ws("\n", "path", "content"))
    word = lambda df, *cols: df.select(*cols, F.explode(F.array_distinct(F.split("hay", "[^a-z0-9]+"))).alias("w")).filter("w != ''")
    texts = files.select("path", hay.alias("hay"))
    vocabulary = word(texts).distinct()
    wanted = materialize(terms.select("term").distinct(), "wanted-terms")
    # a word that mentions a term holds its first five characters (all, if shorter) somewhere; the terms are the small side and go to the words
    keys = sized(wanted.select("term", F.substring("term", 1, 5).alias("g")))
    lengths = sorted(r["n"] for r in wanted.select(F.least(F.lit(5), F.length("term")).alias("n")).distinct().collect())  # five at most
    # a match without length at every place: no place is looked for from the start of the word
    runs = [F.regexp_extract_all("w", F.lit(f"(?=(.{{{k}}}))"), F.lit(1)) for k in lengths if k > 0] or [F.array().cast("array<string>")]
    grams = vocabulary.select("w", F.explode(F.concat(*runs)).alias("g"))
    pairs = grams.join(keys, "g").filter(mentions(F.col("w"), F.col("term"))).select("term", "w").distinct()
    # all of a file is in one task, so its terms are made distinct there and counts alone are shuffled
    met = word(dealt(texts.filter(F.col("path").isNotNull()), "path", ["hay"]), "path").join(sized(pairs), "w").select("path", "term").distinct()
    found = met.groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(found, "term", "left").na.fill(0, ["df"])


def subject_terms(queries: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-34, AGG-35: (query_id, term, df) of the terms that carry a question: known ones, in at most half of the files
    if any are, and of these those up to the lower median frequency."""
    terms = queries.select("query_id", F.explode(content_words(F.col("text"))).alias("term"))
    n = files.select("path").distinct().count()
    known = terms.join(term_file_frequency(terms, files), "term").filter("df > 0")
    by = Window.partitionBy("query_id")
    known = known.withColumn("rare", F.col("df") <= n / 2).withColumn("any_rare", F.max(F.col("rare").cast("int")).over(by))
    pool = known.filter(F.col("rare") | (F.col("any_rare") == 0))
    pool = pool.withColumns({"rn": F.row_number().over(by.orderBy("df", "term")), "k": F.count("*").over(by)})
    median = F.max(F.when(F.col("rn") == F.floor((F.col("k") - 1) / 2) + 1, F.col("df"))).over(by)
    return pool.withColumn("median", median).filter("df <= median").select("query_id", "term", "df")


def covers_question(queries: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-36: (query_id, covered): fewer unknown than known content words."""
    terms = queries.select("query_id", F.explode(content_words(F.col("text"))).alias("term")).join(
        term_file_frequency(queries.select(F.explode(content_words(F.col("text"))).alias("term")), files), "term")
    return terms.groupBy("query_id").agg((F.count_if(F.col("df") == 0) < F.count_if(F.col("df") > 0)).alias("covered"))


def sentence_candidates(hits: DataFrame) -> DataFrame:
    """Sentences and lines of over twelve characters of every hit, with their place."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 12)
    gates = [c for c in ("span_failure", "current") if c in hits.columns]
    return hits.select("query_id", "rank", "chunk_id", "path", "source_id", "score", *gates, F.col("text").alias("body"), F.posexplode(parts).alias("place", "say"))


def with_integrity(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """SCL-09, SCL-10, JOIN-10: ``hits`` (source_id, span_hash, start, start_line, text) as evidence: ``span_failure`` says how a span differs
    from the source as it is now (source_id, content, content_hash), ``current`` whether the source is there at all."""
    s = sources.select(F.col("source_id").alias("__s"), F.col("content").alias("__c"), F.col("content_hash").alias("__h"))
    j = hits.join(s, F.col("source_id") == F.col("__s"), "left")
    failure = audit.span_failure(F.col("span_hash"), F.col("start"), F.col("start") + F.length("text"), F.col("text"), F.col("start_line"), F.col("__c"), F.col("__h"))
    return j.withColumns({"current": F.col("__s").isNotNull(), "span_failure": F.when(F.col("__s").isNotNull(), failure)}).drop("__s", "__c", "__h")


def best_sentences(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """SRT-09, STR-28: per query and hit the sentence with the most words of the question; the first wins a tie."""
    terms = queries.select("query_id", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) > 2).alias("terms"))
    s = sentence_candidates(hits).join(terms, "query_id")
    n = F.size(F.filter("terms", lambda t: F.lower("say").contains(t)))
    return s.groupBy("query_id", "chunk_id").agg(F.max_by("say", F.struct(n, -F.col("place"))).alias("say"))


def local_claims(queries: DataFrame, hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """ANS-04, SRT-10, ANS-11, ANS-12: every candidate sentence with its score and, where it fails, its reject code.

    Score: three times the question's words in the path plus those in the sentence, one more in the first
    chunk of a file, six less in a test file. A candidate must name a subject of its question, come from a passage
    that fits the question's shape (ANS-06), and be supported by it word by word and number by number. Where
    hits went through :func:`with_integrity`, a span that is not what its source holds now is rejected (ANS-05).
    """
    q = queries.select("query_id", content_words(F.col("text")).alias("terms"), tx.question_shape(F.col("text")).alias("shape"))
    subject = subjects.groupBy("query_id").agg(F.collect_set("term").alias("subject"))
    c = sentence_candidates(hits).join(q, "query_id").join(subject, "query_id", "left")
    count = lambda hay, ts: F.size(F.filter(F.coalesce(F.col(ts), F.array().cast("array<string>")), lambda t: mentions(hay, t)))
    low, path = F.lower("say"), F.lower("path")
    c = c.withColumn("claim_score", count(path, "terms") * 3 + count(low, "terms") + F.when(F.col("place") == 0, 1).otherwise(0) - F.when(tx.matches(path, TEST_PATH), 6).otherwise(0))
    sound = F.lit(None).cast("string")
    if "current" in hits.columns:
        sound = F.when(~F.col("current"), "STALE_SOURCE")
    if "span_failure" in hits.columns:
        sound = F.coalesce(sound, F.col("span_failure"))
    reject = (
        F.when(sound.isNotNull(), sound).when(F.size(tx.nonempty(F.split("say", r"\s+"))) < 4, "TOO_SHORT").when(count(low, "subject") + count(path, "subject") == 0, "NO_SUBJECT_COVERAGE")
        .when(F.col("claim_score") <= 0, "LOW_OVERLAP").when(~evidence_fits_shape(F.col("body"), F.col("shape"), F.lit(False)), "SHAPE_MISMATCH").when(F.size(audit.missing_words(F.col("say"), F.col("body"))) > 0, "UNSUPPORTED_WORD")
        .when(~audit.numbers_supported(F.col("say"), F.col("body"), F.col("body")), "UNSUPPORTED_NUMBER")
    )
    return c.withColumn("reject", reject).drop("terms", "subject", "shape")


def verify_meaning(lines: DataFrame, corpus: str) -> DataFrame:
    """STR-42: ``lines`` (with say) that also hold clause by clause in their evidence; for few candidates, after ranking."""
    return lines.filter(F.size(semantic_faults(F.col("say"), audit.content_tokens(F.col("say")), F.col(corpus))) == 0)


def local_cards(claims: DataFrame) -> DataFrame:
    """ANS-03: per query the best admitted sentence; ties by hit rank, then place."""
    w = Window.partitionBy("query_id").orderBy(F.desc("claim_score"), "rank", "place")
    ok = claims.filter(F.col("reject").isNull()).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return ok.select("query_id", "say", "chunk_id", "path", "source_id", "claim_score")


def multi_source_cards(claims: DataFrame) -> DataFrame:
    """ANS-09, WIN-07: queries whose hits span sources: the best admitted sentence of each source's first hit, two at least, joined in order of rank."""
    first = Window.partitionBy("query_id", "source_id").orderBy("rank")
    top = claims.filter("source_id is not null").withColumn("hit", F.dense_rank().over(first)).filter("hit = 1 and reject is null")
    best = Window.partitionBy("query_id", "source_id").orderBy(F.desc("claim_score"), "place")
    one = top.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    cards = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "say", "chunk_id", "source_id"))).alias("p"))
    return cards.filter(F.size("p") >= 2).select("query_id", F.array_join(F.transform("p", lambda x: x["say"]), " ").alias("say"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"))


def fail_fast(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """FLT-11: (query_id, fail): no hits, off topic, or a top score of at most 2 and no content word in any hit."""
    q = queries.withColumn("terms", content_words(F.col("text")))
    per = hits_in_brief(q, hits)
    q = q.join(per, "query_id", "left")
    weak = (F.col("top") <= FAIL_FAST_SCORE) & ((F.size("terms") == 0) | ~F.col("common"))
    return q.select("query_id", (F.col("n").isNull() | tx.matches(F.col("text"), OFF_TOPIC, True) | F.coalesce(weak, F.lit(False))).alias("fail"))


def hits_in_brief(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n, top, common) of queries with hits: their number, best score, and whether any holds one of the query's ``terms``."""
    found = F.exists("terms", lambda t: F.lower(F.col("body")).contains(t))
    each = hits.select("query_id", "score", F.col("text").alias("body")).join(queries.select("query_id", "terms"), "query_id")
    return each.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.max(F.coalesce(found, F.lit(False))).alias("common"))


def prompt_hits(hits: DataFrame, cap: int = PROMPT_CHUNKS, per_file: int = PROMPT_PER_FILE) -> DataFrame:
    """RET-31: up to eight hits a query in order of rank, at most four a file, numbered as ``n``."""
    file = Window.partitionBy("query_id", "path").orderBy("rank")
    kept = hits.withColumn("of_file", F.row_number().over(file)).filter(F.col("of_file") <= per_file)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= cap).drop("of_file")


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """ANS-10, AGG-43: (query_id, prompt, chunks, tokens)."""
    piece = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "path", F.lit("\n"), F.substring("text", 1, PROMPT_CHARS))
    body = prompt_hits(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))).alias("ps"))
    out = body.join(queries.select("query_id", "text"), "query_id").select(
        "query_id", F.concat(F.lit("Answer from the numbered passages only and cite them.\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n"), F.lit("\nQUESTION: "), "text").alias("prompt"),
        F.size("ps").alias("chunks"))
    return out.withColumn("tokens", tx.prompt_tokens(F.col("prompt")))


def verified_generation(said: DataFrame, hits: DataFrame) -> DataFrame:
    """ANS-10, JOIN-13: generated lines that cite passages and are supported by them; (query_id, say, chunk_ids)."""
    marks = said.select("query_id", F.col("say").alias("raw"), F.explode(audit.citation_numbers(F.col("say"))).alias("n"))
    cited = marks.join(prompt_hits(hits).select("query_id", "n", "chunk_id", "text"), ["query_id", "n"]).groupBy("query_id", "raw").agg(
        F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.array_join(F.collect_list("text"), "\n").alias("corpus"))
    c = cited.withColumn("say", audit.strip_citations(F.col("raw")))
    ok = (F.size(audit.content_tokens(F.col("say"))) > 0) & (F.size(audit.missing_words(F.col("say"), F.col("corpus"))) == 0)
    c = c.filter(ok & audit.numbers_supported(F.col("say"), F.col("corpus"), F.col("corpus")))
    return verify_meaning(c, "corpus").select("query_id", "say", "chunk_ids")


def route(queries: DataFrame, hits: DataFrame, files: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ANS-01, ANS-02, FLT-12, FLT-13: (query_id, tier, say, chunk_ids, reason) of every query.

    In this order: silent if retrieval cannot carry an answer; the local card if it is verified, scores at
    least four and covers several sources where the hits span them; the model's grounded line if it is
    verified; the local card; silent. Each stage sees only the queries that none before it has answered.
    """
    hits = materialize(hits, "hits")
    claims = materialize(local_claims(queries, hits, subject_terms(queries, files)), "claims")
    single = local_cards(claims).select("query_id", "say", F.array("chunk_id").alias("chunk_ids"))
    multi = multi_source_cards(claims)
    per = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.count_distinct("source_id").alias("sources"))
    state = queries.select("query_id").join(fail_fast(queries, hits), "query_id").join(per, "query_id", "left")
    state = state.join(single.select("query_id", F.col("say").alias("say1"), F.col("chunk_ids").alias("ids1")), "query_id", "left")
    state = state.join(multi.select("query_id", F.col("say").alias("say2"), F.col("chunk_ids").alias("ids2")), "query_id", "left")
    wide = F.coalesce("sources", F.lit(0)) >= 2
    fast = ~F.col("fail") & (F.col("top") >= FAST_PATH_SCORE) & F.when(wide, F.col("say2").isNotNull()).otherwise(F.col("say1").isNotNull())
    state = state.withColumn("fast", F.coalesce(fast, F.lit(False)))
    if model is not None:
        open_ = state.filter("not fail and not fast").select("query_id")
        said = model(prompts(queries.join(open_, "query_id", "left_semi"), hits.join(open_, "query_id", "left_semi")))
        made = verified_generation(said, hits).select("query_id", F.col("say").alias("say3"), F.col("chunk_ids").alias("ids3"))
    else:
        made = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, say3 string, ids3 array<{hits.schema['chunk_id'].dataType.simpleString()}>")
    s = state.join(made, "query_id", "left")
    local_say = F.when(wide & F.col("say2").isNotNull(), F.col("say2")).otherwise(F.col("say1"))
    local_ids = F.when(wide & F.col("say2").isNotNull(), F.col("ids2")).otherwise(F.col("ids1"))
    tier = F.when(F.col("fail"), "silent").when(F.col("fast"), "localCard").when(F.col("say3").isNotNull(), "grounded").when(local_say.isNotNull(), "localCard").otherwise("silent")
    s = s.withColumn("tier", tier)
    pick = lambda local, made: F.when(F.col("tier") == "grounded", F.col(made)).when(F.col("tier") == "localCard", local)
    reason = F.when(F.col("tier") == "silent", F.when(F.col("top").isNull(), "no passages").when(F.col("fail"), "passages too weak").otherwise("no supported line"))
    return s.select("query_id", "tier", pick(local_say, "say3").alias("say"), pick(local_ids, "ids3").alias("chunk_ids"), reason.alias("reason"))


def tier_mix(routed: DataFrame) -> DataFrame:
    """AGG-13: (tier, n, share)."""
    total = Window.partitionBy()
    n = routed.groupBy("tier").agg(F.count("*").alias("n"))
    return n.withColumn("share", share(F.col("n"), F.sum("n").over(total)))


def provenance(files: DataFrame, commits: DataFrame) -> DataFrame:
    """JOIN-11: (path, sha) of the first commit, in log order, that touches each path."""
    touched = commits.select("ord", "sha", F.explode("files").alias("path")).groupBy("path").agg(F.min_by("sha", "ord").alias("sha"))
    return files.select("path").distinct().join(touched, "path", "left")


def top_directories(files: DataFrame, n: int = 4) -> DataFrame:
    """AGG-31: the directories at the top with the most files."""
    return files.filter(F.col("path").contains("/")).groupBy(F.split("path", "/")[0].alias("dir")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir").limit(n)


def components_under(files: DataFrame, directory: str) -> DataFrame:
    """AGG-32: distinct names right below a directory, sorted, as one row."""
    below = files.filter(F.col("path").startswith(f"{directory}/")).select(F.split(F.substring(F.col("path"), F.lit(len(directory) + 2), F.length("path")), "/")[0].alias("name"))
    return below.agg(F.sort_array(F.collect_set("name")).alias("names"))
