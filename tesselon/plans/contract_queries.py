"""The full question contract over the conversations' lines, and questions of every kind beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import question_contract as qc
from tesselon.plans import queries as base
from tesselon.plans.registry import query, table
from tesselon.plans.talk_queries import _WORDS
from tesselon.session import spread_small

#: Beside each turn stands a further row with one of these; the number of the turn is raised for it.
ASKED = [
    "what is the phone number of the company", "which of the three modes does the exporter use", "which exporter handles the sessions", "what is a checkpoint",
    "when is the channel secure", "please tell what the paper says about attention", "how many queues and workers are there", "what does the worker run on",
    "which vendor must we select", "when is it a class of its own", "where is the cache stored", "what are the pillars of the design", "how much does a seat cost", "what is the first step",
]
ASKED_AT = 200_000


def _questions(spark, sf_dir):
    rows = spread_small(table(spark, sf_dir, "conversations"))
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    at = ((F.col("conv_id") * 5 + turn) % len(ASKED) + 1).cast("int")
    own = F.struct(turn.alias("turn"), text.alias("text"))
    extra = F.struct((turn + ASKED_AT).alias("turn"), F.element_at(F.array(*map(F.lit, ASKED)), at).alias("text"))
    return rows.select("conv_id", F.explode(F.array(own, extra)).alias("r")).select(F.struct("conv_id", "r.turn").alias("query_id"), "r.text")


_LIST = "[" + ", ".join(f"'{x}'" for x in ASKED) + "]"
_WORD_SET = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws.split()) + "]"
# fixed values, written down for the SQL side on their own
_FRAMES = _WORD_SET(
    "please tell remind looking according packet typical authors author professor paper papers guide policy document documents pdf publication notes "
    "memorandum memo say said saying mention mentions mentioned thing things stuff one")
_ASKS = _WORD_SET(
    "use treat cover introduce prevent require allow write lock see create list listed listing stand call measure prefer implement operate solve define expect "
    "align encrypt provide impose satisfy select generate freeze cut disclose recommend mandate charge pay buy own store open happen hidden give present report "
    "propose get need happens happened preferred")
_FIELDS = _WORD_SET("company name names phone number numbers telephone mobile email website site contact address")
_COUNTS = _WORD_SET("two three four five six")
_M = lambda p: f"regexp_matches(low, '{p}')"


@query(rf"""WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations UNION ALL SELECT conv_id, turn + {ASKED_AT}, {_LIST}[(conv_id * 5 + turn) % {len(ASKED)} + 1] FROM conversations),
    s AS (SELECT *, lower(t) AS low, {base._shape_sql('q')} AS shape FROM (SELECT *, trim(lower(t), ' ') AS q FROM l)),
    p AS (SELECT *, {base._predicate_sql()} AS predicate, CASE WHEN {_M(r'\b(what are the|which of the|which)\b')} AND {_M(r'\b(two|three|four|five|six)\b')} THEN 'counted' WHEN {_M(r'\bhow many\b')} AND {_M(r'\band\b')} THEN 'some'
            WHEN {_M(r'\bfirst step\b')} THEN 'one' WHEN {_M(r'\b(which isolation levels|which models|what isolation levels|primary resources|pillars)\b')} THEN 'some' END AS en,
        regexp_extract(low, '\bwhich ((?:gpu |sso |database |password )?)([a-z]{{3,}})\b', 2) AS noun, {_WORDS.format(c='t')} AS terms,
        nullif(regexp_extract(low, '(?:does|do|did)\s+(?:[a-z0-9_''-]+\s+){{1,5}}?([a-z]{{3,}})(?:\s+(?:on|in|with|from|by|to|at|into|for))?\s*\??$', 1), '') AS verb FROM s),
    f AS (SELECT *, en IS NOT NULL OR predicate = 'enumeration' AS enumerates, predicate = 'contact' OR {_M(r'\bcompany name\b')} OR ({_M(r'\bcompany\b')} AND {_M(r'\bname\b')}) OR {_M(r'\bphone number\b')} AS is_field FROM p),
    e AS (SELECT *, CASE WHEN NOT enumerates AND predicate NOT IN ('recommendation', 'requirement') AND NOT {_M(r'\bwhich of\b')} AND noun NOT IN ('', 'isolation', 'levels') THEN noun END AS entity,
        list_filter(terms, lambda w: NOT list_contains({_FRAMES}, w) AND NOT list_contains({_ASKS}, w) AND NOT (enumerates AND list_contains({_COUNTS}, w))) AS m1 FROM f),
    m AS (SELECT *, CASE WHEN len(m1) > 0 THEN m1 ELSE list_filter(terms, lambda w: NOT list_contains({_FRAMES}, w)) END AS must FROM e)
    SELECT conv_id, turn, predicate, enumerates, coalesce(CASE en WHEN 'one' THEN 1 WHEN 'counted' THEN list_position({_COUNTS}, regexp_extract(low, '\b(two|three|four|five|six)\b', 1))::INT + 1 END, 0) AS members, entity, is_field,
        {_M(r"\bwhat(?:''s| is) (?:a |an |the )?[a-z]")} AND NOT {_M(r'\bwhat does\b')} AND NOT is_field AS needs_copula,
        CASE WHEN {_M(r'\bwhen is the (?:\w+ )?(secure|safe|ready|done)\b')} THEN regexp_extract(low, '\bwhen is the (?:\w+ )?(secure|safe|ready|done)\b', 1) WHEN {_M(r'\bwhen is it a\b|\bwhen do they call\b')} THEN 'class-condition' END AS when_is,
        array_to_string(list_sort(list_filter(must, lambda w: w IS DISTINCT FROM entity AND NOT (is_field AND list_contains({_FIELDS}, w))
            AND (verb IS NULL OR NOT list_contains([verb, verb || 's', verb || 'ed', verb || 'd'], w))
            AND NOT coalesce(verb = 'store' AND w IN ('stored', 'stores'), false) AND NOT coalesce(verb = 'freeze' AND w IN ('freezes', 'frozen'), false) AND NOT coalesce(verb = 'implement' AND w IN ('implemented', 'implements'), false))), ' ') AS required
    FROM m""")
def question_contracts(spark, sf_dir):
    """STR-43: predicate, enumeration, entity, field, copula and the words an answer must hold, by rules that are rows."""
    c = qc.full_contracts(_questions(spark, sf_dir))
    return c.select("query_id.conv_id", "query_id.turn", "predicate", "enumerates", F.coalesce("members", F.lit(0)).alias("members"), "entity", "is_field", "needs_copula", "when_is", F.array_join(F.sort_array("required"), " ").alias("required"))
