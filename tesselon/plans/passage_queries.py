"""The answer path on real texts: every benchmark item is a question, its hits are the documents that full-text search finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import answers, contract, overview, retrieval
from tesselon.plans import queries as base
from tesselon.plans.answer_queries import _MENTIONS, _WORDS_OF
from tesselon.plans.registry import ORACLE_SQL, query, table
from tesselon.session import materialize, spread_small

_HITS = f"hits AS ({ORACLE_SQL['full_text_topk']}), h AS (SELECT hits.*, coalesce(text, '') AS body FROM hits JOIN documents ON doc_id = chunk_id), q AS (SELECT item_id AS query_id, coalesce(text, '') AS asked FROM benchmark)"
_OFF_TOPIC = r"(?i)\b(weather|stock price|world series|capital of france|bake sourdough)\b"


def _files(spark, sf_dir):
    d = spread_small(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _hits(spark, sf_dir):
    c = _files(spark, sf_dir)
    found = retrieval.full_text_search(base.questions(spark, sf_dir), c)
    return materialize(found.join(c, "chunk_id").withColumn("source_id", F.col("chunk_id")), "passage-hits")


@query(rf"""WITH {_HITS}, t AS (SELECT query_id, list_filter(string_split_regex(lower(asked), '[^a-z0-9]+'), lambda w: length(w) > 2) AS ts FROM q),
    p AS (SELECT query_id, chunk_id, string_split(regexp_replace(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS ps FROM h),
    s AS (SELECT query_id, chunk_id, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g'), ' ') AS say, generate_subscripts(ps, 1) AS place FROM p),
    n AS (SELECT s.*, len(list_filter(ts, lambda w: contains(lower(say), w))) AS n FROM s JOIN t USING (query_id) WHERE length(say) > 12)
    SELECT query_id, chunk_id, say FROM n QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n DESC, place) = 1""")
def passage_sentences(spark, sf_dir):
    """SRT-09, STR-28: of each document found for a question the sentence with most of its words, out of all its sentences."""
    return answers.best_sentences(base.questions(spark, sf_dir), _hits(spark, sf_dir))


@query(rf"""WITH {_HITS}, c AS (SELECT query_id, asked, {_WORDS_OF('asked')} AS cw FROM q),
    b AS (SELECT c.query_id, any_value(asked) AS asked, any_value(len(cw)) AS k, count(h.chunk_id) AS n, max(h.score) AS top, coalesce(bool_or(len(list_filter(cw, lambda w: contains(lower(h.body), w))) > 0), false) AS common FROM c LEFT JOIN h USING (query_id) GROUP BY 1),
    f AS (SELECT *, n = 0 OR regexp_matches(asked, '{_OFF_TOPIC}') OR (top <= 2 AND (k = 0 OR NOT common)) AS fail FROM b)
    SELECT query_id, fail, CASE WHEN fail THEN 'SILENT' WHEN top >= 4 AND common THEN 'ANSWER_WITH_CURRENT_PIPELINE' WHEN top >= 2 THEN 'ESCALATE' ELSE 'SILENT' END AS decision FROM f""")
def passage_gates(spark, sf_dir):
    """FLT-11, STR-36: whether a question fails at once, and what the judge decides, on the documents found for it."""
    q, hits = base.questions(spark, sf_dir), _hits(spark, sf_dir)
    return answers.fail_fast(q, hits).join(contract.escalation(q, hits), "query_id")


_DF = f"""c AS (SELECT item_id AS query_id, unnest({_WORDS_OF("coalesce(text, '')")}) AS term FROM benchmark),
    w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower('docs/' || doc_id || chr(10) || coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
    m AS (SELECT term, w FROM (SELECT DISTINCT term FROM c) JOIN (SELECT DISTINCT w FROM w) ON {_MENTIONS('w', 'term')}),
    df AS (SELECT t.term, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT term FROM c) t LEFT JOIN m USING (term) LEFT JOIN w USING (w) GROUP BY 1)"""


def _sources(spark, sf_dir):
    return _files(spark, sf_dir).withColumnRenamed("text", "content")


@query(f"WITH {_DF} SELECT term, df FROM df")
def passage_term_files(spark, sf_dir):
    """AGG-33: documents that mention each content word of the questions."""
    terms = base.questions(spark, sf_dir).select(F.explode(answers.content_words(F.col("text"))).alias("term"))
    return answers.term_file_frequency(terms, _sources(spark, sf_dir))


@query(f"""WITH {_DF}, k AS (SELECT query_id, term, df, df <= (SELECT count(*) FROM documents) / 2 AS rare FROM c JOIN df USING (term) WHERE df > 0),
    p AS (SELECT * FROM (SELECT *, bool_or(rare) OVER (PARTITION BY query_id) AS some FROM k) WHERE rare OR NOT some),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS rn, count(*) OVER (PARTITION BY query_id) AS n FROM p)
    SELECT o.query_id, o.term, o.df FROM o JOIN o AS m ON m.query_id = o.query_id AND m.rn = (m.n - 1) // 2 + 1 WHERE o.df <= m.df""".replace("some", "anyrare"))
def passage_subjects(spark, sf_dir):
    """AGG-34, AGG-35: the words that carry each question, by how many documents mention them."""
    return answers.subject_terms(base.questions(spark, sf_dir), _sources(spark, sf_dir)).select("query_id", "term", "df")


@query(f"WITH {_DF} SELECT query_id, count(*) FILTER (df = 0) < count(*) FILTER (df > 0) AS covered FROM c JOIN df USING (term) GROUP BY 1")
def passage_coverage(spark, sf_dir):
    """AGG-36: questions of which the documents know more words than not."""
    return answers.covers_question(base.questions(spark, sf_dir), _sources(spark, sf_dir))


#: Twelve documents are a pack; a document's number in it gives its path. The ranks are for the SQL side.
TREE = [
    ("README.md", 8), ("main.ts", 10), ("container-lambdas/ingest/h.py", 0), ("container-lambdas/parse/h.py", 0), ("src/app.py", 13), ("docs/readme.md", 8),
    ("workers-pool/a/x.ts", 0), ("workers-pool/b/x.ts", 0), ("workers-pool/c/x.ts", 0), ("config/x.json", -6), ("lib/deep/er/server.ts", -4), (".github/ci.yml", -6),
]
_TREE = ", ".join(f"({i}, '{p}', {r})" for i, (p, r) in enumerate(TREE))


@query(rf"""WITH tr AS (SELECT * FROM (VALUES {_TREE}) v(i, path, rank)),
    d AS (SELECT doc_id // 12 AS pack, doc_id, path, rank, doc_id * 7 % 5 < 2 AS tells, doc_id % 11 = 0 AS fast,
        array_to_string(list_slice(list_filter(string_split_regex(coalesce(text, ''), '[ 	-]+'), lambda w: regexp_full_match(w, '[a-z]+')), 1, 6), ' ') AS ws FROM documents JOIN tr ON i = doc_id % 12),
    c AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY rank DESC, path) AS place FROM d),
    t AS (SELECT pack, path, trim('This module provides ' || ws, ' ') AS said FROM c WHERE tells AND (place <= 6 OR path LIKE '%eadme.md' OR path = 'README.md') QUALIFY row_number() OVER (PARTITION BY pack ORDER BY place) = 1),
    f AS (SELECT pack, count(*) AS n FROM d WHERE fast GROUP BY 1), p AS (SELECT pack, count(DISTINCT path) AS n FROM d WHERE path LIKE 'container-lambdas/%' GROUP BY 1)
    SELECT t.pack AS pack_id, path, CASE WHEN f.n > 0 THEN 'FastAPI' END AS framework, CASE WHEN p.n = 2 THEN 'container-lambdas' END AS dir, CASE WHEN p.n = 2 THEN 2 ELSE 0 END::BIGINT AS components,
        t.pack || ' is a ' || CASE WHEN f.n > 0 THEN 'FastAPI ' ELSE '' END || 'service — ' || said || '.' || CASE WHEN p.n = 2 THEN ' Work is split across two container lambdas.' ELSE '' END AS say
    FROM t LEFT JOIN f USING (pack) LEFT JOIN p USING (pack)""")
def architecture_cards(spark, sf_dir):
    """ANS-08, SRT-12, AGG-31, AGG-32: what packs of twelve documents are; some say so in a line before their text, some show a framework."""
    i = F.col("doc_id")
    path = F.element_at(F.array(*[F.lit(p) for p, _ in TREE]), (i % 12 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w.rlike("^[a-z]+$"))
    line = F.concat(F.when(path.endswith(".md"), F.lit("")).otherwise(F.lit("// ")), F.lit("This module provides "), F.array_join(F.slice(words, 1, 6), " "), F.lit(".\n\n"))
    code = F.when(i % 11 == 0, F.lit("from fastapi import FastAPI\n")).otherwise(F.lit(""))
    content = F.concat(F.when(i * 7 % 5 < 2, line).otherwise(F.lit("")), code, text)
    files = table(spark, sf_dir, "documents").select(F.floor(i / 12).cast("long").alias("pack_id"), path.alias("path"), content.alias("content"))
    return overview.architecture_cards(files)
