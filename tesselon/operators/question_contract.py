"""STR-43 in full: what a question requires of its answer, by rules that are rows.

A rule is (field, priority, shape, patterns, value): it holds for a question whose shape is the rule's (if it names one) and in which
all patterns are found. Every question meets all rules once; of those that hold the one with the least priority gives the
field its value. What is particular to a corpus is more rows of the same table, with priorities below those of the built-in ones.
The rest of a contract, which of its words an answer must hold, follows from these fields by set operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import dialogue
from tesselon.functions import text as tx
from tesselon.operators.answers import content_words
from tesselon.operators.contract import COUNT_WORDS, relation_fits, relation_of, word_form

# --- fixed values ---------------------------------------------------------------------------------------
FRAMING = (
    "please tell remind looking according packet typical authors author professor paper papers guide policy document documents pdf publication "
    "notes memorandum memo say said saying mention mentions mentioned thing things stuff one"
).split()
ASKING = (
    "use treat cover introduce prevent require allow write lock see create list listed listing stand call measure prefer implement operate solve "
    "define expect align encrypt provide impose satisfy select generate freeze cut disclose recommend mandate charge pay buy own store open happen "
    "hidden give present report propose get need happens happened preferred"
).split()
FIELD_WORDS = "company name names phone number numbers telephone mobile email website site contact address".split()
VERB_FORMS = {"store": ["stored", "stores"], "freeze": ["freezes", "frozen"], "implement": ["implemented", "implements"]}
ENTITY = r"\bwhich ((?:gpu |sso |database |password )?)([a-z]{3,})\b"
NO_ENTITY = ["isolation", "levels"]
COUNTED = r"\b(two|three|four|five|six)\b"
#: field, shape or None, patterns, value; in order of priority within a field.
RULES = [
    ("field", None, [r"\bcompany name\b"], "yes"), ("field", None, [r"\bcompany\b", r"\bname\b"], "yes"), ("field", None, [r"\bphone number\b"], "yes"),
    ("enumeration", None, [r"\b(what are the|which of the|which)\b", COUNTED], "counted"), ("enumeration", None, [r"\bhow many\b", r"\band\b"], "some"),
    ("enumeration", None, [r"\bfirst step\b"], "one"), ("enumeration", None, [r"\b(which isolation levels|which models|what isolation levels|primary resources|pillars)\b"], "some"),
    ("copula", None, [r"\bwhat does\b"], "no"), ("copula", None, [r"\bwhat(?:'s| is) (?:a |an |the )?[a-z]"], "yes"),
    ("when", None, [r"\bwhen is the (?:\w+ )?secure\b"], "secure"), ("when", None, [r"\bwhen is the (?:\w+ )?safe\b"], "safe"),
    ("when", None, [r"\bwhen is the (?:\w+ )?ready\b"], "ready"), ("when", None, [r"\bwhen is the (?:\w+ )?done\b"], "done"),
    ("when", None, [r"\bwhen is it a\b|\bwhen do they call\b"], "class-condition"), ("no_entity", None, [r"\bwhich of\b"], "yes"),
]
STARTERS = (
    "The This That Then They Thus There These Those When What With From After Also Once Each Both Such Note Next First Last Most Some Many Only Just "
    "Over Like Even More Here Data We In On If As An A To For By Our Its No Not One Two How Why Who Where Let Let’s Lets And But Or Nor Yet So"
).split()
BROKEN, WHOLE = r"(?i)\b(tion|piler|ular|ility)\b", r"(?i)\b(popular|ability|compiler|condition|additional)\b"
# ---------------------------------------------------------------------------------------------------------
_RULE = "field string, priority int, shape string, patterns array<string>, value string"


def built_in_rules(spark: SparkSession) -> DataFrame:
    """(field, priority, shape, patterns, value): the predicates' rules and those of the other fields."""
    rows = [("predicate", 0, "who", [], "ownership")]
    for kind, patterns in dialogue._PREDICATES:
        shapes = [p[6:] for p in patterns if p.startswith("shape=")]
        rows.append(("predicate", len(rows), shapes[0] if shapes else None, [p for p in patterns if not p.startswith("shape=")], kind))
    rows += [(field, 1000 + i, shape, patterns, value) for i, (field, shape, patterns, value) in enumerate(RULES)]
    return spark.createDataFrame(rows, _RULE)


def rule_values(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, values): a map of field to value, of the holding rule with the least priority (ties by value); questions that meet none have no row.

    Rules are a stated set: up to 10,000 of them; more is an error.
    """
    n = rules.count()
    if n > 10_000:
        raise ValueError(f"{n} rules; at most 10,000 can be held against every question")
    q = questions.select("query_id", F.lower("text").alias("low"), tx.question_shape(F.col("text")).alias("q_shape"), F.lit(0).alias("all"))
    met = q.join(F.broadcast(rules.withColumn("all", F.lit(0))), "all")
    # patterns find Latin word edges, as elsewhere
    found = F.forall("patterns", lambda p: F.regexp_like(F.col("low"), p)) & (F.col("shape").isNull() | (F.col("shape") == F.col("q_shape")))
    least = met.filter(found).groupBy("query_id", "field").agg(F.min_by("value", F.struct("priority", "value")).alias("value"))
    return least.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("values"))


def full_contracts(queries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(query_id, shape, predicate, expectation, enumerates, members, entity, is_field, needs_copula, when_is, verb, preposition, required, optional).

    ``queries`` are (query_id, text) and may have ``selected``, the words by which a source was chosen: these need not stand in
    the answer. ``rules`` are held beside the built-in ones. required: the words an answer must hold; optional: those that frame the question, the
    asking verb, the kind of thing asked for. Null texts count as empty.
    """
    spark = queries.sparkSession
    selected = F.coalesce(F.col("selected"), F.lit("")) if "selected" in queries.columns else F.lit("")
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), selected.alias("selected"))
    both = built_in_rules(spark) if rules is None else built_in_rules(spark).unionByName(rules)
    q = q.join(rule_values(q, both), "query_id", "left")
    low, text = F.lower("text"), F.col("text")
    value = lambda f: F.try_element_at("values", F.lit(f))
    predicate = F.coalesce(value("predicate"), F.lit("definition"))
    enumerates = value("enumeration").isNotNull() | (predicate == "enumeration")
    numbers = F.create_map(*[F.lit(x) for kv in COUNT_WORDS.items() for x in kv])
    members = F.when(value("enumeration") == "one", 1).when(value("enumeration") == "counted", F.try_element_at(numbers, F.regexp_extract(low, COUNTED, 1)))
    noun = F.regexp_extract(low, ENTITY, 2)
    asks_thing = ~enumerates & ~predicate.isin("recommendation", "requirement") & value("no_entity").isNull() & (noun != "") & ~noun.isin(NO_ENTITY)
    entity = F.when(asks_thing, noun)
    is_field = (predicate == "contact") | value("field").isNotNull()
    expect = F.create_map(*[F.lit(x) for kv in dialogue.EXPECTATIONS.items() for x in kv])
    relation = relation_of(text)
    q = q.select(
        "query_id", tx.question_shape(text).alias("shape"), predicate.alias("predicate"),
        F.when(entity.isNotNull(), "naming").when(enumerates, "enumeration").otherwise(F.coalesce(F.try_element_at(expect, predicate), F.lit("definition"))).alias("expectation"),
        enumerates.alias("enumerates"), members.alias("members"), entity.alias("entity"), is_field.alias("is_field"),
        ((value("copula") == "yes") & ~is_field).alias("needs_copula"), value("when").alias("when_is"), relation["verb"].alias("verb"), relation["preposition"].alias("preposition"),
        content_words(text).alias("terms"), F.filter(F.split(F.lower("selected"), "[^a-z0-9]+"), lambda w: F.length(w) > 2).alias("chosen"),
    )
    frames = lambda w: F.array_contains("chosen", w) | w.isin(FRAMING)
    counts = lambda w: F.col("enumerates") & w.isin(list(COUNT_WORDS))
    first = F.filter("terms", lambda w: ~frames(w) & ~w.isin(ASKING) & ~counts(w))
    q = q.withColumn("must", F.when(F.size(first) > 0, first).otherwise(F.filter("terms", lambda w: ~frames(w))))
    forms = F.create_map(*[x for k, v in VERB_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    verb = F.col("verb")
    verbal = F.when(verb.isNotNull(), F.concat(F.array(verb, F.concat(verb, F.lit("s")), F.concat(verb, F.lit("ed")), F.concat(verb, F.lit("d"))), F.coalesce(F.try_element_at(forms, verb), F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    q = q.withColumn("verbal", verbal)
    eased = lambda w: w.eqNullSafe(F.col("entity")) | F.array_contains("verbal", w) | (F.col("is_field") & w.isin(FIELD_WORDS))
    required = F.filter("must", lambda w: ~eased(w))
    named = F.when(F.col("entity").isNotNull(), F.array("entity")).otherwise(F.array().cast("array<string>"))
    optional = F.array_distinct(F.concat(F.filter("terms", lambda w: frames(w) | w.isin(ASKING)), named, F.filter("must", eased)))
    return q.withColumns({"required": required, "optional": optional}).withColumn("needs_copula", F.coalesce("needs_copula", F.lit(False))).drop("terms", "chosen", "must", "verbal")


def broken_edge(claim: Column) -> Column:
    """A line that begins or goes on with the leftover of a word cut at a column's edge."""
    t = F.trim(claim)
    starter = t.rlike(rf"^({'|'.join(STARTERS)})\b")
    stump = t.rlike(r"^[A-Z][a-z]{1,3}\b") | t.rlike(r"^[A-Z][a-z]{1,5}\b\s+(?i:since|and|or|but)\b")
    return (stump & ~starter) | (t.rlike(BROKEN) & ~t.rlike(WHOLE))


def fits_contract(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """``claims`` (query_id, say, ...) that their question's contract admits; a null line fits nothing."""
    c = claims.join(contracts.withColumnsRenamed({k: f"__{k}" for k in contracts.columns if k != "query_id"}), "query_id")
    say, low = F.col("say"), F.lower("say")
    words = F.forall("__required", lambda w: word_form(say, w))
    near = lambda w: F.regexp_like(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b[^.]{0,48}\bis\b|\bis\b[^.]{0,48}\b"), w, F.lit(r"\b")))
    defines = ~F.col("__needs_copula") | F.exists("__required", near)
    vague = low.rlike(r"\btalk about\b|\bjust like\b") & ~low.rlike(r"\b(continuous|discrete|called a|if |when )\b")
    when_ = F.when(F.col("__when_is").isNull(), True).when(F.col("__when_is") == "class-condition", ~vague).otherwise(F.regexp_like(low, F.concat(F.lit(r"\bis\s+"), "__when_is", F.lit(r"\b"))))
    listed = ~F.col("__enumerates") | dialogue.enumeration_fits(say, F.col("__members"))
    kind = F.when(F.col("__predicate") == "enumeration", True).otherwise(dialogue.predicate_fits(say, F.col("__predicate")))
    ok = (F.col("__shape") != "absence") & ~broken_edge(say) & words & kind & listed & defines & when_ & relation_fits(say, F.col("__verb"), F.col("__preposition"))
    return c.filter(ok).select(*claims.columns)
