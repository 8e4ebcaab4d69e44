"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import ann, chat, decontaminate, fim, language, lm, mining, mixing, quality, repeats, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds at least 0.8."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document, in all and by the shard of the splitting tree."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    out = mixing.taken_per_document(plan, shards=16)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "shard_words")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_examples(turns.unionByName(extra)))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document because it repeats 50 bytes of an earlier one."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; one row in seven takes the next label first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(rows.withColumn("label", moved.cast("long")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form and of the text rebuilt from it."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_mix, op3_quality, op4_lm_score, op5_language, op6_toxicity, op7_simhash, op8_chat,
        op9_shard, op10_ann, op11_suffix_dedup, op12_hard_negatives, op13_fim,
    )
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\x0c\r]+'), lambda w: w != '')"
_SHINGLES = (
    "list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),"
    " lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"
)
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
        i AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
        n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS matched, item_shingles, count(*) / item_shingles AS containment
        FROM d JOIN i USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, item_shingles HAVING count(*) / item_shingles >= 0.8""",
    # an example reaches from the first turn to an assistant turn, or to the end if that is none
    "op8_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        r AS (SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY conv_id) AS n,
                sum(length(regexp_replace(role, '([<\[\\\n])', '\1.', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1.', 'g'))
                    + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) OVER w AS upto
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(upto) FILTER (role = 'assistant' OR no = n)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id""",
    # bytes as pairs of hexadecimal digits; windows of 50 bytes out of pieces of 249, so that long texts are not walked for each
    "op11_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT r, doc_id, o, substr(x, 2 * o + 1, 498) AS y FROM (SELECT *, unnest(range(0, length(x) // 2 - 49, 200)) AS o FROM d)),
        w AS (SELECT r, doc_id, o + p AS p, substr(y, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(length(y) // 2 - 49)) AS p FROM c)),
        f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        h AS (SELECT r, p FROM w JOIN f USING (s) WHERE least < doc_id),
        b AS (SELECT r, p, coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -100) AS before FROM h),
        g AS (SELECT r, p, count(*) FILTER (p > before + 50) OVER (PARTITION BY r ORDER BY p) AS island FROM b),
        i AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY r, island),
        k AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS la, list(z ORDER BY a) AS lz FROM i GROUP BY r),
        -- what is left stands before the first run, between two, and behind the last
        e AS (SELECT doc_id, x, n_spans, n_removed, list_append(coalesce(la, []), length(x) // 2) AS ends,
                list_prepend(0, coalesce(lz, [])) AS starts FROM d LEFT JOIN k USING (r))
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(array_to_string(list_transform(range(1, len(ends) + 1),
                lambda j: substr(x, 2 * starts[j] + 1, 2 * (ends[j] - starts[j]))), ''))) AS kept_sha256
        FROM e""",
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
        FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same
            AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5""",
    # lines as a list, cut at two of its ranks; the text comes back from the parts themselves
    "op13_fim": r"""
        WITH l AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
                ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
                    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
        p AS (SELECT *, array_to_string(list_slice(u, 1, least(a, b)), '') AS pre,
                array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS mid,
                array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
            sha256(pre || mid || suf) AS restored_sha256
        FROM p""",
}
