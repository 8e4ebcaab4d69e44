"""What a question requires of its answer, decisions of the rule-based judge, source selection, repository overview.

A contract is a row: shape, predicate, expectation, enumeration, required relation, subject terms, selected sources.
Candidate lines are joined to it by query_id and kept if they fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import dialogue, say
from tesselon.functions import text as tx
from tesselon.operators import audit
from tesselon.operators.answers import content_words, fail_fast, hits_in_brief, mentions
from tesselon.session import materialize

# --- fixed values ---------------------------------------------------------------------------------------
EXTERNAL = r"\b(weather|stock price|capital of|who won|score of|temperature today|exchange rate)\b"
PREPOSITIONS = r"(?:on|in|with|from|by|to|at|into|for)"
COUNT_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"
#: Markers that each text is searched for one by one; more are looked up by what the text holds.
FEW_MARKERS = 64
# ---------------------------------------------------------------------------------------------------------


def relation_of(q: Column) -> dict[str, Column]:
    """STR-50: the main verb of a does/did question and the preposition that ends it: what does X run on."""
    low = F.lower(q)
    verb = F.regexp_extract(low, rf"(?:does|do|did)\s+(?:[a-z0-9_'-]+\s+){{1,5}}?([a-z]{{3,}})(?:\s+{PREPOSITIONS})?\s*\??\z", 1)
    prep = F.regexp_extract(low, rf"\s({PREPOSITIONS})\s*\??\z", 1)
    return {"verb": F.nullif(verb, F.lit("")), "preposition": F.nullif(prep, F.lit(""))}


def relation_fits(claim: Column, verb: Column, preposition: Column) -> Column:
    """STR-50: the verb stands in the line in some form, unmodalised, with a subject before it and not only in a relative
    clause, and the preposition follows within eighty characters."""
    low = F.lower(claim)
    stem = F.regexp_replace(F.regexp_replace(verb, "(?:e|y)\\z", ""), "([bcdfglmnprst])\\1\\z", "$1")
    at = F.regexp_instr(low, F.concat(F.lit(r"\b"), stem, F.lit(r"\w*\b")))
    before = F.substring(low, F.lit(1), at - 1)
    modal = before.rlike(r"\b(?:can|could|may|might|should|would|will|must)\s+(?:not\s+)?\z")
    relative = before.rlike(r"\b(?:which|that|who|where)\s+(?:\w+\s+){0,2}\z")
    after = F.substring(low, at, F.lit(80))
    prep = preposition.isNull() | F.regexp_like(after, F.concat(F.lit(r"\s"), F.coalesce(preposition, F.lit("")), F.lit(r"\b")))
    return verb.isNull() | ((at > 1) & before.rlike("[a-z0-9]") & ~modal & ~relative & prep)


def contracts(queries: DataFrame) -> DataFrame:
    """STR-43: (query_id, shape, predicate, expectation, members, verb, preposition, terms) of every question."""
    q, low = F.col("text"), F.lower("text")
    kind = dialogue.predicate_of(q)
    expect = F.create_map(*[F.lit(x) for kv in dialogue.EXPECTATIONS.items() for x in kv])
    counted = F.regexp_extract(low, tx.edges(r"\b(two|three|four|five|six)\b"), 1)
    numbers = F.create_map(*[F.lit(x) for kv in COUNT_WORDS.items() for x in kv])
    rows = queries.select("query_id", "text", tx.question_shape(q).alias("shape"), kind.alias("predicate"))
    return rows.select(
        "query_id", "shape", "predicate", F.coalesce(F.try_element_at(expect, F.col("predicate")), F.lit("definition")).alias("expectation"),
        F.when(F.col("predicate") == "enumeration", F.try_element_at(numbers, counted)).alias("members"),
        relation_of(q)["verb"].alias("verb"), relation_of(q)["preposition"].alias("preposition"), content_words(q).alias("terms"),
    )


def fitting_claims(contracts_: DataFrame, claims: DataFrame) -> DataFrame:
    """STR-43, STR-49: ``claims`` (query_id, say, ...) that are of the kind their question asks for."""
    c = claims.join(contracts_.select("query_id", "shape", "predicate", "members", "verb", "preposition"), "query_id")
    kind = F.when(F.col("predicate") == "enumeration", dialogue.enumeration_fits(F.col("say"), F.col("members"))).otherwise(
        dialogue.predicate_fits(F.col("say"), F.col("predicate")))
    ok = kind & relation_fits(F.col("say"), F.col("verb"), F.col("preposition")) & (F.col("shape") != "absence")
    return c.filter(ok).select(*claims.columns)


def select_sources(queries: DataFrame, documents: DataFrame, types: DataFrame) -> DataFrame:
    """STR-44, STR-45: (query_id, source_ids, by): sources that a question names by file, by title, or by type.

    ``documents`` has source_id, path, title; ``types`` (word, type_word) says which words of a file's name make it of
    which type: knowledge about a corpus is a table. Names beat titles, titles beat types; several sources of one
    kind stay several, for the caller to see the ambiguity.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(tx.nonempty(F.split(F.lower("text"), "[^a-z0-9.-]+")))).alias("w"))
    names = documents.select("source_id", F.explode(say.identity_tokens(F.col("path"))).alias("w"))
    titles = documents.filter("title is not null").select("source_id", F.lower("title").alias("title"), F.element_at(F.split(F.lower("title"), r"\s+"), 1).alias("w"))
    by_name = words.withColumn("w", F.regexp_replace("w", r"\.[a-z0-9]+\z", "")).join(names.filter(F.length("w") >= 4), "w").select("query_id", "source_id", F.lit(1).alias("rank"))
    text = queries.select("query_id", F.lower("text").alias("q"))
    by_title = words.join(titles, "w").join(text, "query_id").filter(F.col("q").contains(F.col("title"))).select("query_id", "source_id", F.lit(2).alias("rank"))
    typed = names.join(types.select("word", "type_word"), F.col("w") == F.col("word")).select("source_id", "type_word").distinct()
    by_type = words.join(typed, F.col("w") == F.col("type_word")).select("query_id", "source_id", F.lit(3).alias("rank"))
    found = by_name.union(by_title).union(by_type).distinct()
    best = found.withColumn("best", F.min("rank").over(Window.partitionBy("query_id"))).filter("rank = best")
    how = F.element_at(F.array(F.lit("name"), F.lit("title"), F.lit("type")), F.col("best"))
    return best.groupBy("query_id", how.alias("by")).agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"))


def applicability(pairs: DataFrame) -> DataFrame:
    """STR-36: (id, decision) of (id, question, evidence): APPLICABLE by overlap, shape and a supported first sentence."""
    first = F.element_at(F.filter(F.split("evidence", r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) >= 12), 1)
    p = pairs.withColumns({"terms": content_words(F.col("question")), "shape": tx.question_shape(F.col("question")),
                           "first": F.when(F.size(F.filter(F.split("evidence", r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) >= 12)) > 0, F.trim(first))})
    n = F.size(F.filter("terms", lambda t: F.lower("evidence").contains(t)))
    fits = dialogue.evidence_fits_shape(F.coalesce("first", "evidence"), F.col("shape"), F.lit(False))
    supported = F.col("first").isNotNull() & (F.size(audit.missing_words(F.col("first"), F.col("evidence"))) == 0)
    yes = ~tx.matches(F.lower("question"), EXTERNAL) & ((n > 0) | fits) & ((supported & ((n >= 1) | fits)) | ((n >= 2) & fits) | (n >= 3))
    return p.select("id", F.when(yes, "APPLICABLE").otherwise("NOT_APPLICABLE").alias("decision"))


def escalation(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """STR-36: (query_id, decision): SILENT on a failed retrieval, an answer at a score of four with a word in common, ESCALATE from two on."""
    per = hits_in_brief(queries.select("query_id", content_words(F.col("text")).alias("terms")), hits)
    s = fail_fast(queries, hits).join(per, "query_id", "left")
    common = F.col("common")
    return s.select("query_id", F.when(F.col("fail") | F.col("top").isNull(), "SILENT").when((F.col("top") >= 4) & common, "ANSWER_WITH_CURRENT_PIPELINE")
                    .when(F.col("top") >= 2, "ESCALATE").otherwise("SILENT").alias("decision"))


def word_form(hay: Column, term: Column) -> Column:
    """STR-18: the term as a whole word, or with s, es, ed or ing."""
    words = F.split(F.lower(hay), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.concat(term, F.lit(x)) for x in ("", "s", "es", "ed", "ing")]))


def provenance_of(terms: Column, subject: Column, claim: Column, path: Column) -> Column:
    """STR-19: struct of content, path and covered terms, and whether the candidate is admissible (it covers a subject term)."""
    low, where = F.lower(claim), F.lower(path)
    content = F.filter(terms, lambda t: mentions(low, t))
    in_path = F.filter(terms, lambda t: ~mentions(low, t) & mentions(where, t))
    covered = F.filter(subject, lambda t: F.array_contains(F.concat(content, in_path), t))
    return F.struct(content.alias("content"), in_path.alias("path"), covered.alias("covered"), (F.size(covered) > 0).alias("admissible"))


def prose(files: DataFrame) -> DataFrame:
    """STR-20: (path, description, capabilities): of a file's first comment or document block the first sentence that says
    what it does (240 characters at most) and its short bullets (six at most)."""
    head = F.coalesce(
        F.when(F.col("path").rlike(r"(?i)\.(md|mdx|txt|rst)\z"), F.col("content")),
        F.nullif(F.regexp_extract("content", r'(?s)\A\s*(?:#![^\n]*\n)?\s*(?:"""|\'\'\')(.*?)(?:"""|\'\'\')', 1), F.lit("")),
        F.nullif(F.regexp_extract("content", r"(?s)\A\s*/\*\*?(.*?)\*/", 1), F.lit("")),
        F.nullif(F.regexp_extract("content", r"\A((?:\s*(?://|#)[^\n]*\n)+)", 1), F.lit("")), F.lit(""))
    lines = tx.nonempty(F.transform(F.split(head, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\*|//|#(?!#))\s?", ""))))
    f = files.select("path", lines.alias("lines"))
    body = F.filter("lines", lambda x: ~say.is_heading(x) & ~x.rlike(BULLET) & ~x.endswith(":"))
    told = F.filter(F.split(F.array_join(body, " "), r"(?<=[.!?])\s+"), lambda s: say.is_descriptive(s) & (F.length(s) <= 240))
    caps = F.transform(F.filter("lines", lambda x: x.rlike(BULLET)), lambda x: F.regexp_replace(say.plain(F.regexp_replace(x, BULLET, "")), r"[.,;]\z", ""))
    caps = F.slice(F.filter(caps, lambda c: (F.length(c) > 2) & (F.length(c) < 60) & ~c.rlike("[·—|:]")), 1, 6)
    out = f.select("path", F.when(F.size(told) > 0, say.plain(F.element_at(told, 1))).alias("description"), caps.alias("capabilities"))
    return out.filter(F.col("description").isNotNull() | (F.size("capabilities") >= 2))


def overview(files: DataFrame) -> DataFrame:
    """ANS-08, SRT-12: per pack one verified line about what it does, with the file it is read from: the description of the
    file with the best path score, or its capabilities."""
    from tesselon.operators.scope import path_score

    p = prose(files).join(files.select("pack_id", "path"), "path").withColumn("rank", path_score(F.col("path")) + F.when(F.lower("path").rlike(r"(^|/)readme"), 20).otherwise(0))
    best = Window.partitionBy("pack_id").orderBy(F.desc("rank"), "path")
    top = p.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    line = F.coalesce(F.col("description"), F.concat(F.lit("It covers "), say.list_phrase(F.slice("capabilities", 1, 4)), F.lit(".")))
    return top.select("pack_id", "path", line.alias("say"))


def document_cards(contracts_: DataFrame, claims: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """ANS-07: per query the best admitted sentence of a document that fits its contract, from the selected sources where a question names any."""
    c = fitting_claims(contracts_, claims.filter(F.col("reject").isNull()))
    if sources is not None:
        c = c.join(sources, "query_id", "left").filter(F.col("source_ids").isNull() | F.array_contains("source_ids", F.col("source_id"))).select(*claims.columns)
    w = Window.partitionBy("query_id").orderBy(F.desc("claim_score"), "rank", "place")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("query_id", "say", "chunk_id", "source_id")


def isolation_leaks(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """ANS-13: (query_id, tenant, leaked) for hits whose text holds the marker of another tenant; empty if tenants are apart."""
    m = materialize(markers.select(F.col("tenant").alias("owner"), "marker").filter(F.length("marker") > 0), "markers")
    h = hits.select("query_id", "tenant", "text")
    n = m.count()
    if n > FEW_MARKERS:
        # a hit meets the markers whose first eight characters (all, if shorter) stand in it; the texts stay behind while runs are looked up
        m = m.withColumn("g", F.substring("marker", 1, 8))
        sizes = [r["n"] for r in m.select(F.length("g").alias("n")).distinct().collect()]  # eight at most
        runs = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes])))
        grams = h.select(F.col("query_id").alias("__q"), F.col("tenant").alias("__t"), F.explode(runs).alias("g"))
        few = F.broadcast(m) if n <= 1_000_000 else m
        m = grams.join(few, "g").filter(F.col("owner") != F.col("__t")).select("__q", "__t", "owner", "marker").distinct()
        met = h.join(m, F.col("query_id").eqNullSafe(F.col("__q")) & (F.col("tenant") == F.col("__t")) & F.col("text").contains(F.col("marker")))
    else:
        met = h.join(F.broadcast(m), (F.col("owner") != F.col("tenant")) & F.col("text").contains(F.col("marker")))
    return met.select("query_id", "tenant", F.col("owner").alias("leaked")).distinct()


def nearest_samples(samples: Column, rate: int, target: int = 16_000) -> Column:
    """SCL-07: samples at the target rate, each the nearest one of the source."""
    n = F.floor(F.size(samples) * target / rate).cast("int")
    pick = lambda i: F.element_at(samples, F.least(F.size(samples), (F.round(i * rate / target) + 1).cast("int")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pick)).otherwise(F.slice(samples, 1, 0))


def trailing_frames(frames: DataFrame, ms: float = 4000.0) -> DataFrame:
    """WIN-10: the last frames of each lane that together cover ``ms``."""
    back = Window.partitionBy("lane").orderBy(F.desc("at_ms")).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("__after", F.coalesce(F.sum("ms").over(back), F.lit(0.0))).filter(F.col("__after") < ms).drop("__after")


def viewer_metrics(events: DataFrame) -> DataFrame:
    """AGG-45: per kind of viewer event the count, failures and latency percentiles."""
    from tesselon.operators.metrics import latency_triple

    return events.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), *latency_triple("latency_ms", "latency"))


def migrate(rows: DataFrame, defaults: dict[str, Column], version: int) -> DataFrame:
    """DML-13: rows of older versions with the columns that newer ones have, set where they are missing or null, and the version raised."""
    old = F.coalesce("schema_version", F.lit(0)) < version
    out = rows
    for name, value in defaults.items():
        have = F.col(name) if name in rows.columns else F.lit(None)
        out = out.withColumn(name, F.when(old, F.coalesce(have, value)).otherwise(F.coalesce(have, F.lit(None))))
    return out.withColumn("schema_version", F.when(old, version).otherwise(F.col("schema_version")))
