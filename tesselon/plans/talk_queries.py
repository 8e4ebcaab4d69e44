"""Queries over spoken lines, questions and short texts: gates, follow-ups, support checks, small scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselon.functions import dialogue, say
from tesselon.functions import scalars as sc
from tesselon.functions import text as tx
from tesselon.operators import answers as answers_ops
from tesselon.operators import audit, contract
from tesselon.plans.registry import query, table
from tesselon.session import spread_small

#: Spoken lines that the tables lack: beside each turn of the conversations as it is stands a further row with one of them.
SAYINGS = [
    "Thanks for that. How does the retry queue handle a timeout?", "okay so why not?", "Can you hear me?", "What is the owner of the billing service.", "So, um, tell me more",
    "Good morning everyone - what about the cache, hi there", "How do we deploy main.ts today", "the contract says 3 retries and we decided on Friday", "why", "Based on the docs, it seems that the worker writes two rows.",
    "Does the API return a token? Thanks!", "Is there any fallback when the database fails?", "do you mind if I share my screen?", "can you share the plan of the migration?",
]
#: What is added to the turn of such a row.
SAID_AT = 100_000
_S = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SAYINGS) + "]"
_LINES = (
    f"l AS (SELECT conv_id, turn, coalesce(text, '') AS t, coalesce(text, '') AS raw FROM conversations"
    f" UNION ALL SELECT conv_id, turn + {SAID_AT}, {_S}[(conv_id * 5 + turn) % {len(SAYINGS)} + 1], coalesce(text, '') FROM conversations)"
)


def _lines(spark, sf_dir):
    said = F.array(*[F.lit(x) for x in SAYINGS])
    at = ((F.col("conv_id") * 5 + F.col("turn")) % len(SAYINGS) + 1).cast("int")
    text = F.coalesce("text", F.lit(""))
    rows = spread_small(table(spark, sf_dir, "conversations"))
    own = F.struct(F.col("turn").alias("turn"), text.alias("t"))
    extra = F.struct((F.col("turn") + SAID_AT).alias("turn"), F.element_at(said, at).alias("t"))
    return rows.select("conv_id", text.alias("raw"), F.explode(F.array(own, extra)).alias("r")).select("conv_id", "r.turn", "r.t", "raw")


# fixed values, as in the engine but written down for the SQL side on their own
_LOGISTICS = (
    r"can you hear me|can you all hear|(?:can|are) you (?:able to )?see (?:my|the|this) (?:screen|slide|deck|tab|window)|can everyone (?:see|hear)|(?:is|are) (?:everyone|everybody) (?:here|on|with us)|are you there|you still there|next slide|"
    r"(?:should|shall|can|could) we (?:move on|move along|continue|proceed|jump ahead|skip ahead|get started|start|begin|wrap up|take a break)|let''?s (?:move on|get started|start|begin|wrap up|take that offline)|any (?:other )?questions|"
    r"(?:take|taking) (?:that|this|it) offline|you''?re (?:on mute|muted)|(?:i think )?you''?re muted|(?:can you|could you) (?:repeat|say that again|say it again)|who else (?:are we|is) (?:waiting|joining)|(?:can|could) you speak up|"
    r"is my (?:audio|mic|video) (?:ok|okay|working|coming through)|do you (?:mind if|want to) (?:i )?share|(?:are|is) (?:we|this) recording"
)
_FILLER = (
    r"^(?:how are you(?: doing| today)?|how''?s it going|what''?s up|what''?s new|sorry|sorry,? (?:what|say that)(?: again)?|thanks|thank you|thanks for\b[^?]{0,20}|thank you for\b[^?]{0,20}|good (?:morning|afternoon|evening)(?: (?:everyone|all|team|folks))?|"
    r"(?:hello|hi|hey)(?: (?:there|everyone|all|team|folks))?|nice to (?:meet|see) you(?: (?:all|too|again))?|(?:are )?we good(?: (?:on|for) (?:time|schedule|now))?|all good(?: (?:on|for) (?:time|schedule|now))?)[\s,!.?]*$"
)
_LEAD = r"^(what|why|who|how|where|when|which|whose|can we|can you|could we|could you|should we|does |do we|do you|did we|did you|is there|are there|is it|are we|tell me|walk me|explain|remind me)\b"
_OVERVIEW = r"\b(architecture|structured|overview|how (is|does) (this|the))\b"
_ARCH = r"architect|high[- ]level|system design|whole (app|application|system)|how (is|does) (this|the) (app|system|code|repo|application)|how is (this|it) (structured|built|organized)|overview of (the )?(app|system|codebase|application)"
_TECH = r"\b(api|apis|endpoint|retry|retries|auth|authn|authz|authenticat\w*|authoriz\w*|login|session|token|cookie|database|db|sql|query|schema|migration|lambda|architect\w*|service|microservice|client|server|request|response|exporter|importer|queue|worker|job|cron|model|route|router|handler|controller|module|component|backend|frontend|deploy\w*|timeout|cache|caching|webhook|middleware|pipeline|ingest\w*|codebase|repo|repository|contract|clause|termination|liability|revenue|requirement|requirements|spec|sla|latency|throughput|rollback|failover|retention|encryption|permission|permissions|role|scope|tenant|webhooks|config|env|secret|credentials)\b"
_OURS = r"\b(this|that|the|our) (app|application|api|service|system|code|repo|backend|frontend|codebase|file|module|contract|doc|document|deck|design|flow|feature|change)\b"
_TERSE = r"^(why(\s+not)?|how(\s+(so|come))?|what|what\s+else|what\s+about\s+(that|it|this)|then\s+what|so\s+what|since\s+when|based\s+on\s+what|according\s+to\s+what)\b[\s,]*\??$"


def _asks(c: str) -> str:
    return (f"(length({c}) >= 10 AND NOT (regexp_matches({c}, '(?i){_LOGISTICS}') OR regexp_matches({c}, '(?i){_FILLER}')) AND (contains({c}, '?') OR regexp_matches({c}, '(?i){_LEAD}') OR regexp_matches({c}, '(?i){_OVERVIEW}')))")


def _live(c: str, in_material: str, open_: str) -> str:
    return (f"({_asks(c)} AND (regexp_matches({c}, '(?i){_ARCH}') OR {in_material} OR regexp_matches({c}, '(?i){_TECH}') OR regexp_matches({c}, '[A-Za-z0-9_.-]+\\.[A-Za-z0-9]{{1,8}}')"
            f" OR regexp_matches({c}, '(?i){_OURS}') OR ({open_} AND length({c}) >= 12)))")


_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(t, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1) || '|\s*[—–]\s*|\s+-\s+|,\s+'), lambda x: trim(x)), lambda x: x <> '')"
_STRIP = f"CASE WHEN len(list_filter({_PARTS}, lambda x: NOT regexp_matches(x, '(?i){_FILLER}'))) = len({_PARTS}) THEN t ELSE array_to_string(list_filter({_PARTS}, lambda x: NOT regexp_matches(x, '(?i){_FILLER}')), ' ') END"


@query(f"WITH {_LINES} SELECT conv_id, turn, {_STRIP} AS said FROM l")
def stripped_fillers(spark, sf_dir):
    """STR-03."""
    return _lines(spark, sf_dir).select("conv_id", "turn", dialogue.strip_filler(F.col("t")).alias("said"))


_SENT = r"string_split(regexp_replace(t, '([.?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(f"WITH {_LINES}, q AS (SELECT *, list_filter({_SENT}, lambda s: {_asks('s')}) AS qs FROM l) SELECT conv_id, turn, {_asks('t')} AS asks, substr(CASE WHEN len(qs) > 0 THEN qs[-1] ELSE t END, 1, 280) AS question FROM q")
def asked_questions(spark, sf_dir):
    """STR-04, STR-05."""
    return _lines(spark, sf_dir).select("conv_id", "turn", dialogue.looks_like_question(F.col("t")).alias("asks"), dialogue.extract_question(F.col("t")).alias("question"))


@query(f"""WITH {_LINES}, q AS (SELECT *, list_filter(string_split(regexp_replace(t, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_live('s', 'turn % 3 = 0', 'turn % 2 = 0')}) AS lv, {_live('t', 'turn % 3 = 0', 'turn % 2 = 0')} AS whole FROM l),
    f AS (SELECT *, CASE WHEN len(lv) > 0 THEN lv[-1] WHEN whole THEN t END AS s FROM q), e AS (SELECT *, list_filter(string_split(regexp_replace(s, '([.?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_asks('x')}) AS qs FROM f)
    SELECT conv_id, turn, substr(CASE WHEN len(qs) > 0 THEN qs[-1] ELSE s END, 1, 280) AS question FROM e""")
def last_live_questions(spark, sf_dir):
    """STR-07, STR-08."""
    i = F.col("turn")
    return _lines(spark, sf_dir).select("conv_id", "turn", dialogue.last_live_question(F.col("t"), i % 3 == 0, i % 2 == 0).alias("question"))


@query(f"""WITH {_LINES}, s AS (SELECT *, {_STRIP} AS s FROM l) SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i){_LOGISTICS}') OR regexp_matches(t, '(?i){_FILLER}') OR s = '' THEN 'chatter'
    WHEN regexp_matches(s, '(?i){_TERSE}') THEN CASE WHEN turn % 2 = 0 AND turn % 4 < 2 THEN 'follow-up' ELSE 'orphan-follow-up' END WHEN NOT {_live('s', 'turn % 3 = 0', 'turn % 2 = 0')} THEN 'not-a-question'
    WHEN turn % 5 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'follow-up' ELSE 'unresolved-reference' END ELSE 'question' END AS verdict FROM s""")
def gate_verdicts(spark, sf_dir):
    """STR-09."""
    i = F.col("turn")
    return _lines(spark, sf_dir).select("conv_id", "turn", dialogue.gate_verdict(F.col("t"), i % 3 == 0, i % 2 == 0, i % 4 < 2, i % 5 == 0).alias("verdict"))


_OPENERS = r"(?i)^\s*(?:so|ok|okay|alright|all right|well|right|now|anyway|anyways|basically|essentially|honestly|actually|seriously|look|listen|see|yeah|yep|yes|um|umm|uh|uhh|er|erm|hmm|hmmm|wait|hold on|and|but|then|plus|also|i guess|you know|i mean|quick question|one question|let me ask)\b[\s,;:—–-]*"


def _open_sql(n: int) -> str:
    prev = "trim(t)" if n == 0 else f"o{n - 1}"
    less = f"regexp_replace({prev}, '{_OPENERS}', '')"
    return f"CASE WHEN len(list_filter(string_split_regex({less}, '\\s+'), lambda x: x <> '')) >= 3 THEN {less} ELSE {prev} END AS o{n}"


@query(f"WITH {_LINES}, x0 AS (SELECT *, {_open_sql(0)} FROM l), x1 AS (SELECT *, {_open_sql(1)} FROM x0), x2 AS (SELECT *, {_open_sql(2)} FROM x1), x3 AS (SELECT *, {_open_sql(3)} FROM x2), x4 AS (SELECT *, {_open_sql(4)} FROM x3), x5 AS (SELECT *, {_open_sql(5)} FROM x4) SELECT conv_id, turn, o5 AS bare FROM x5")
def stripped_openers(spark, sf_dir):
    """STR-11, its first part."""
    return _lines(spark, sf_dir).select("conv_id", "turn", answers_ops.strip_openers(F.col("t")).alias("bare"))


_STOP = "what when where which how why who whose does do did doing done is are was were be been being have has had having the a an this that these those and or but for from with into about after before then there here it its our we you your they them their to of in on at by as can could should would will might must work works working worked happen happens happening handle handles handled handling use used uses using own owns owned owning make makes making made get gets getting got go goes going know knows mean means all any thing things stuff again though anymore actually really basically essentially literally honestly seriously even just also okay alright well right sorry yeah maybe guess".split()
_WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in _STOP) + ")))"
_FOLLOW = r"(?i)^(?:and |or |so )?(?:(?:can you |could you )?(?:tell me more|say more|go on|explain(?: that| more)?|continue)|why(?:\s+\S+){0,2}|how does that(?: work)?|how so|what about that)\s*$"
_SHORT = f"(regexp_matches(trim(regexp_replace(trim(t), '[?.!]+$', '')), '{_FOLLOW}') OR (len({_WORDS.format(c='t')}) < 4 AND len(list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '')) < 7))"


@query(f"WITH {_LINES}, p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM l) SELECT conv_id, turn, {_SHORT} AS short, CASE WHEN {_SHORT} AND prev IS NOT NULL THEN prev || ' ' || t ELSE t END AS query FROM p")
def expanded_follow_ups(spark, sf_dir):
    """STR-10, STR-12."""
    rows = _lines(spark, sf_dir).withColumn("prev", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", answers_ops.is_short_follow_up(F.col("t")).alias("short"), answers_ops.expand_query(F.col("t"), F.col("prev")).alias("query"))


_TERM = "['retry', 'database', 'deployment', 'tokens', 'own']"
_TERMS = ["retry", "database", "deployment", "tokens", "own"]


@query(f"""WITH {_LINES}, m AS (SELECT conv_id, turn, lower(t) AS t, unnest({_TERM}) AS term FROM l)
    SELECT conv_id, turn, term, contains(t, term) OR (length(term) >= 6 AND contains(t, substr(term, 1, greatest(5, length(term) - 3)))) AS mentions,
    list_has_any(string_split_regex(t, '[^a-z0-9]+'), [term, term || 's', term || 'es', term || 'ed', term || 'ing']) AS word_form FROM m""")
def term_mentions(spark, sf_dir):
    """STR-17, STR-18."""
    m = _lines(spark, sf_dir).select("conv_id", "turn", F.lower("t").alias("t"), F.explode(F.array(*[F.lit(x) for x in _TERMS])).alias("term"))
    return m.select("conv_id", "turn", "term", answers_ops.mentions(F.col("t"), F.col("term")).alias("mentions"), contract.word_form(F.col("t"), F.col("term")).alias("word_form"))


_PREFACE = r"(?i)^(?:well,?\s+|so,?\s+|ok(?:ay)?,?\s+)?(?:based (?:up)?on|according to|as per|per|from|in|looking at|after reviewing)\s+(?:the\s+)?(?:provided\s+|given\s+|loaded\s+|attached\s+|retrieved\s+)?(?:repository|repo|codebase|code ?base|code|context|documentation|docs|evidence|material|excerpts?|snippets?|files?|chunks?)\b[^,.;:]*[,.;:]?\s*"
_HEDGE = r"(?i)^(?:it\s+(?:appears|seems|looks like)(?:\s+that)?|the\s+(?:documentation|docs|repository|repo|code ?base|code|evidence|context|material)\s+(?:suggests?|shows?|indicates?|says?|states?)(?:\s+that)?|there\s+(?:appears|seems)\s+to\s+be|i\s+(?:think|believe)(?:\s+that)?|this\s+(?:suggests?|indicates?)(?:\s+that)?)\s*"
_CUT = lambda c: f"trim(regexp_replace(trim(regexp_replace({c}, '{_PREFACE}', '')), '{_HEDGE}', ''))"


@query(f"""WITH {_LINES}, a AS (SELECT conv_id, turn, {_CUT("trim(regexp_replace(t, '\\s+', ' ', 'g'))")} AS x FROM l), b AS (SELECT conv_id, turn, {_CUT('x')} AS x FROM a),
    c AS (SELECT conv_id, turn, trim(regexp_replace({_CUT('x')}, '^[,;:.\\-–—]+\\s*', '')) AS x FROM b)
    SELECT conv_id, turn, CASE WHEN length(x) >= 12 AND regexp_matches(x, '[A-Za-z]') AND len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) >= 3 THEN upper(substr(x, 1, 1)) || substr(x, 2) END AS line FROM c""")
def sayable_lines(spark, sf_dir):
    """STR-24."""
    return _lines(spark, sf_dir).select("conv_id", "turn", say.sayable(F.col("t")).alias("line"))


@query(r"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '@x.org' WHEN 1 THEN 'a b@x.y' ELSE '  ' || c_custkey || '@mail  ' END AS e,
    c_custkey % 3 = 0 AND NOT contains(c_name, ' ') AS valid FROM customer""")
def valid_emails(spark, sf_dir):
    """STR-29."""
    i = F.col("c_custkey")
    e = F.when(i % 3 == 0, F.concat("c_name", F.lit("@x.org"))).when(i % 3 == 1, "a b@x.y").otherwise(F.concat(F.lit("  "), i.cast("string"), F.lit("@mail  ")))
    return table(spark, sf_dir, "customer").select("c_custkey", e.alias("e"), say.valid_email(e).alias("valid"))


@query(r"""WITH t AS (SELECT doc_id, 'It holds [' || (doc_id % 4) || '] rows [12] and  keys [' || (doc_id % 4) || '].' AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 12 THEN '12' ELSE (doc_id % 4) || ',12' END AS marks, 'It holds rows and keys.' AS bare FROM t""")
def citation_marks(spark, sf_dir):
    """STR-27."""
    m = (F.col("doc_id") % 4).cast("string")
    t = F.concat(F.lit("It holds ["), m, F.lit("] rows [12] and  keys ["), m, F.lit("]."))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(audit.citation_numbers(t).cast("array<string>"), ",").alias("marks"), audit.strip_citations(t).alias("bare"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'Commit ' || substr('abcdef0123', 1, 7) || CASE WHEN l_suppkey % 2 = 0 THEN ' · PR #' || l_suppkey ELSE '' END
    WHEN 1 THEN 'doc.pdf · Page ' || l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN ' · "Heads"' ELSE '' END ELSE 'src/a.ts:' || l_linenumber || CASE WHEN l_partkey > l_linenumber THEN '-' || l_partkey ELSE '' END END AS cite FROM lineitem""")
def citation_texts(spark, sf_dir):
    """STR-26."""
    n, even = F.col("l_linenumber"), F.col("l_suppkey") % 2 == 0
    kind = F.when(n % 3 == 0, "commit").when(n % 3 == 1, "document").otherwise("code")
    path = F.when(n % 3 == 1, "doc.pdf").otherwise("src/a.ts")
    cite = say.citation_text(kind, path, n, F.col("l_partkey"), n, F.when(even, "Heads"), F.lit("abcdef0123"), F.when(even, F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cite.alias("cite"))


@query("""WITH w AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS w FROM nation WHERE n_nationkey % 4 < 2 GROUP BY 1) SELECT n_regionkey, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(w[1:len(w) - 1], ', ') || ' and ' || w[-1] END AS phrase FROM w""")
def list_phrases(spark, sf_dir):
    """STR-23."""
    w = table(spark, sf_dir, "nation").filter("n_nationkey % 4 < 2").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("w"))
    return w.select("n_regionkey", say.list_phrase(F.col("w")).alias("phrase"))


_GLUE = (
    "about above after again against along already also although always among another anything around because become becomes been before behind being below beneath beside between beyond both cannot could different does doing done during each either enough entire even every except further given gives hence here however immediately include included includes including inside instead into itself just keeps later least less "
    "letting like made make makes making many meant might more most much must neither never next none normally nothing often once only onto other others otherwise over overall particular perhaps rather really same several shall should similar simply since some someone something sometimes still such take taken takes than that their them themselves then there therefore these they thing things this those though through throughout "
    "thus together toward towards under until upon used uses using usually various very well were what when whenever where whether which while whole whose will with within without would your manages plus split work service across commit one two three four five six seven eight nine"
).split()
_CONTENT = "list_distinct(list_filter(list_transform(string_split_regex(lower(t), '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9_]+|[^a-z0-9_]+$', '', 'g')), lambda w: length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in _GLUE) + ")))"
_NUMS = lambda c: f"regexp_extract_all(lower({c}), '\\d+(?:[.,]\\d+)?')"


@query(f"""WITH {_LINES}, p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || raw AS corpus FROM l)
    SELECT conv_id, turn, len(list_filter({_CONTENT}, lambda w: NOT contains(lower(corpus), w)))::INT AS missing,
    len(list_filter({_NUMS('t')}, lambda n: NOT list_contains({_NUMS('corpus')}, n))) = 0 AS numbers,
    length(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'))) >= 12 AND contains(trim(regexp_replace(lower(corpus), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'))) AS extractive FROM p""")
def word_support(spark, sf_dir):
    """STR-37, STR-39, STR-40: each line against the one before it and the conversation's own text."""
    rows = _lines(spark, sf_dir).withColumn("corpus", F.concat_ws(" ", F.coalesce(F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), "raw"))
    t, c = F.col("t"), F.col("corpus")
    return rows.select("conv_id", "turn", F.size(audit.missing_words(t, c)).alias("missing"), audit.numbers_supported(t, c, c).alias("numbers"), audit.extractive(t, c).alias("extractive"))


@query(r"""WITH w AS (SELECT item_id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS w FROM benchmark), x AS (SELECT DISTINCT w FROM w UNION SELECT unnest(['GraphQL', 'p99', 'iOS', 'A1', 'API', 'x-9z', 'MySQLDb', 'word.'])),
    b AS (SELECT w, regexp_replace(w, '[^A-Za-z0-9]', '', 'g') AS b FROM x)
    SELECT w AS token, length(b) >= 2 AND (regexp_matches(b, '[A-Z][a-z]+[A-Z]') OR regexp_matches(b, '[A-Za-z]+[0-9]|[0-9]+[A-Za-z]')) AS entity FROM b""")
def named_entities(spark, sf_dir):
    """STR-51."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("token"))
    extra = spark.createDataFrame([(x,) for x in ("GraphQL", "p99", "iOS", "A1", "API", "x-9z", "MySQLDb", "word.")], "token string")
    return words.unionByName(extra).distinct().select("token", dialogue.is_named_entity(F.col("token")).alias("entity"))


@query(r"""WITH t AS (SELECT conv_id, turn, ['why', 'who', 'failure', 'absence', 'how'][turn % 5 + 1] AS shape, lower(coalesce(text, '')) || CASE conv_id % 4 WHEN 0 THEN ' because of it' WHEN 1 THEN ' maintained by ops' WHEN 2 THEN ' retries on error' ELSE '' END AS t FROM conversations)
    SELECT conv_id, turn, CASE shape WHEN 'why' THEN regexp_matches(t, '\b(because|since|so that|in order to|to avoid|to prevent|to ensure|rather than|instead of|trade[- ]?off|on purpose|by design|deliberately|intentionally|the reason|rationale|decided|decision|chose|chosen|opted|due to|owing to|required by|constraint|limitation|workaround|prevents|avoids)\b')
        WHEN 'who' THEN regexp_matches(t, '\b(owned|owner|owners|ownership|maintained|maintainer|maintainers|authored|responsible for|on-call|oncall|codeowner|codeowners)\b')
        WHEN 'failure' THEN regexp_matches(t, '\b(fail|fails|failed|failure|error|errors|exception|retry|retries|timeout|rollback|abort|aborts)\b') WHEN 'absence' THEN conv_id % 2 = 0 ELSE true END AS fits FROM t""")
def shape_fits(spark, sf_dir):
    """STR-14."""
    i = F.col("conv_id") % 4
    tail = F.when(i == 0, " because of it").when(i == 1, " maintained by ops").when(i == 2, " retries on error").otherwise("")
    shape = F.element_at(F.array(*[F.lit(x) for x in ("why", "who", "failure", "absence", "how")]), (F.col("turn") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("t"), shape.alias("shape"))
    return rows.select("conv_id", "turn", dialogue.evidence_fits_shape(F.col("t"), F.col("shape"), F.col("conv_id") % 2 == 0).alias("fits"))


@query(r"""WITH t AS (SELECT doc_id, ['It has rows, keys, and locks', 'The three parts are:', 'one, two', 'alpha' || chr(10) || 'beta line', 'rows, keys and locks', 'A single plain sentence here'][doc_id % 6 + 1] AS t FROM documents)
    SELECT doc_id, doc_id % 6 IN (0, 3) AS fits, doc_id % 6 IN (0) AS three FROM t""")
def enumerations(spark, sf_dir):
    """STR-48: lists of members, and of three members."""
    said = F.array(*[F.lit(x) for x in ("It has rows, keys, and locks", "The three parts are:", "one, two", "alpha\nbeta line", "rows, keys and locks", "A single plain sentence here")])
    t = F.element_at(said, (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", dialogue.enumeration_fits(t).alias("fits"), dialogue.enumeration_fits(t, F.lit(3)).alias("three"))


@query(r"""SELECT c_custkey, ['Phone: 030 1234567', 'Acme Corp', 'x = 3;', 'This is a long sentence with many words in it.', 'jo@acme.org', ''][c_custkey % 6 + 1] AS t, c_custkey % 6 IN (0, 1, 4) AS field FROM customer""")
def field_lines(spark, sf_dir):
    """STR-25."""
    said = F.array(*[F.lit(x) for x in ("Phone: 030 1234567", "Acme Corp", "x = 3;", "This is a long sentence with many words in it.", "jo@acme.org", "")])
    t = F.element_at(said, (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("t"), say.is_field_line(t).alias("field"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, least(coalesce(n_chars, 0), doc_id % 400) AS off FROM documents)
    SELECT doc_id, (length(substr(t, 1, off::INT)) - length(replace(substr(t, 1, off::INT), chr(10), '')) + 1)::INT AS line, strftime(TIMESTAMP '2024-02-28 20:00:00' + to_hours((doc_id % 100)::INT), '%Y-%m-%d') AS day FROM d""")
def line_and_day(spark, sf_dir):
    """SCL-08, SCL-13."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.least(F.coalesce("n_chars", F.lit(0)), F.col("doc_id") % 400).cast("int").alias("off"))
    ts = F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-28 20:00:00").cast("timestamp")) + F.col("doc_id") % 100 * 3600)
    return d.select("doc_id", sc.line_of(F.col("t"), F.col("off")).alias("line"), sc.day_key(ts).alias("day"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / len(embedding)), 9) AS rms, len(embedding) * 16 // 48 AS n, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[4]::DOUBLE, 6) AS second FROM embeddings""")
def frame_levels(spark, sf_dir):
    """SCL-05, SCL-07: vectors stand for frames at 48 kHz."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    low = contract.nearest_samples(F.col("v"), 48_000)
    return e.select("vec_id", F.round(sc.rms(F.col("v")), 9).alias("rms"), F.size(low).cast("long").alias("n"), F.round(F.element_at(low, 1), 6).alias("first"), F.round(F.element_at(low, 2), 6).alias("second"))



@query(r"""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) || ['', ' never', ' we cannot', ' not without'][conv_id % 4 + 1] AS t FROM conversations)
    SELECT conv_id, turn, regexp_matches(t, '\bnever\b') AS never, regexp_matches(t, '\bnot\b') AS "not", regexp_matches(t, '\bwithout\b') AS without,
    regexp_matches(t, '\bnever\b|\bnot\b|\bwithout\b|\b(cannot|can''t|won''t|doesn''t|don''t|isn''t|aren''t|wasn''t|weren''t|nor|none|nothing)\b') AS "any" FROM t""")
def negations(spark, sf_dir):
    """STR-38."""
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", " never", " we cannot", " not without")]), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("t"))
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in audit.negation_flags(F.col("t")).items()])


@query(r"""WITH b AS (SELECT item_id, string_split(lower(coalesce(text, '')), ' ') AS w FROM benchmark), c AS (SELECT item_id, array_to_string(w, ' ') AS corpus, list_filter([w[1], w[3], w[5]], lambda x: x IS NOT NULL) AS up, list_filter([w[5], w[3], w[1]], lambda x: x IS NOT NULL) AS down FROM b),
    p AS (SELECT item_id, up, down, corpus, strpos(corpus, up[1]) + length(up[1]) AS e1, strpos(corpus, down[1]) + length(down[1]) AS d1 FROM c),
    q AS (SELECT *, strpos(substr(corpus, e1), up[2]) AS a2, strpos(substr(corpus, d1), down[2]) AS b2 FROM p), r AS (SELECT *, e1 + a2 - 1 + length(up[2]) AS e2, d1 + b2 - 1 + length(down[2]) AS d2 FROM q)
    SELECT item_id, a2 > 0 AND strpos(substr(corpus, e2), up[3]) > 0 AS forward, b2 > 0 AND strpos(substr(corpus, d2), down[3]) > 0 AS backward FROM r WHERE len(up) = 3""")
def ordered_tokens(spark, sf_dir):
    """STR-40: three words of an item in their order and the other way round."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower(F.coalesce("text", F.lit(""))), " ").alias("w")).filter(F.size("w") >= 5)
    corpus, take = F.array_join("w", " "), lambda *xs: F.array(*[F.element_at("w", x) for x in xs])
    return b.select("item_id", audit.ordered_tokens(take(1, 3, 5), corpus).alias("forward"), audit.ordered_tokens(take(5, 3, 1), corpus).alias("backward"))


@query(r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS c, doc_id % 6 AS k FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'STALE' WHEN 1 THEN 'OUT_OF_BOUNDS' WHEN 2 THEN 'TEXT_MISMATCH' WHEN 3 THEN 'LINE_MISMATCH' END AS failure FROM f WHERE length(c) >= 12 AND substr(c, 3, 5) <> substr(c, 4, 5)""")
def span_failures(spark, sf_dir):
    """SCL-09: spans [2, 7) that are stale, end too far, hold another text, name another line, or are sound."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("c"), (F.col("doc_id") % 6).alias("k")).filter((F.length("c") >= 12) & (F.substring("c", 3, 5) != F.substring("c", 4, 5)))
    k, c = F.col("k"), F.col("c")
    end = F.when(k == 1, F.length(c) + 1).otherwise(7)
    text = F.when(k == 2, F.substring(c, 4, 5)).otherwise(F.substring(c, 3, 5))
    line = sc.line_of(c, F.lit(2)) + F.when(k == 3, 1).otherwise(0)
    return f.select("doc_id", audit.span_failure(F.when(k == 0, "old").otherwise("h"), F.lit(2), end, text, line, c, F.lit("h")).alias("failure"))


@query(r"""WITH b AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS stem FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split_regex(stem, '[^a-z0-9]+'), lambda t: length(t) > 1), [stem, replace(stem, '-', '')]))), ' ') AS tokens FROM b""")
def identity_tokens(spark, sf_dir):
    """STR-45."""
    path = F.concat(F.lit("docs/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(say.identity_tokens(path)), " ").alias("tokens"))


@query("""SELECT doc_id, sum(length(w))::BIGINT AS letters FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id""")
def body_word_letters(spark, sf_dir):
    """RET-02: letters in the words of each document that has any."""
    d = spread_small(table(spark, sf_dir, "documents")).select("doc_id", tx.camel_split(F.coalesce("text", F.lit(""))).alias("low"))
    w = d.select("doc_id", F.explode(F.filter(tx.split_words(F.col("low")), lambda x: ~x.contains("_"))).alias("w"))
    return w.groupBy("doc_id").agg(F.sum(F.length("w")).alias("letters"))


_UNITS = "list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT)"
_MIX = lambda seed, k: f"list_reduce(list_prepend({seed}::BIGINT, {_UNITS}), lambda h, c: ((xor(h, c)::HUGEINT * {k}) % 4294967296)::BIGINT)"
_FOLD = lambda h, n, k: f"((xor({h}, {h} >> {n})::HUGEINT * {k}) % 4294967296)::BIGINT"
_BASE36 = "ltrim(" + " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((v // {36**k}) % 36 + 1)::INT, 1)" for k in range(10, -1, -1)) + ", '0')"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(coalesce(text, ''), ' ')) AS w FROM benchmark), m AS (SELECT w, {_MIX(3735928559, 2654435761)} AS a, {_MIX(1103547991, 1597334677)} AS b FROM w WHERE w <> ''),
    x AS (SELECT w, xor({_FOLD('a', 16, 2246822507)}, {_FOLD('b', 13, 3266489909)}) AS a, b FROM m), y AS (SELECT w, a, xor({_FOLD('b', 16, 2246822507)}, {_FOLD('a', 13, 3266489909)}) AS b FROM x),
    z AS (SELECT w, (b & 2097151) * 4294967296 + a AS v FROM y) SELECT w AS word, {_BASE36} AS h FROM z""")
def mixing_hashes(spark, sf_dir):
    """SCL-02."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word")).distinct().filter("word != ''")
    return w.select("word", sc.mixing_hash(F.col("word")).alias("h"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS nothing FROM events""")
def json_texts(spark, sf_dir):
    """SCL-17, SCL-18."""
    return table(spark, sf_dir, "events").select("event_id", sc.json_text(F.col("props"), "$.k").alias("k"), sc.json_text(F.col("props"), "$.none").alias("nothing"))
