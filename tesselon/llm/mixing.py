"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of up to ``block_words`` words. Every source has an exact quota of
words, and so of block draws: whole passes over its blocks, then the first blocks of a permutation
(the last one cut to the word). The splitting tree hands the draws to the output shards: at each node
the left half's counts by source are one multivariate-hypergeometric draw from the node's counts, down
to single shards. Shard j of source s then owns a run of consecutive draws, so shards' draws are
disjoint; inside a shard the draws are put in a permuted order.

The hypergeometric draws are exact at any population: numpy's generator within its range, rejection
under the universal envelope of log-concave distributions beyond it, on log-factorials of 40 digits.

A row is known by its doc_id, its source and the SHA-256 of its text; rows equal in these are one group with a
count and get copy numbers, so a group of any size is one row until its copies are dealt out in pieces. A
source of any size is ranked in hash buckets (running sums over bucket totals in two levels, then
inside the bucket), so no task holds a source. Only one row per source, the mix's recipe, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.llm.decontaminate import text_id, words_of
from tesselon.session import materialize

BUCKET_ROWS = 1024
#: Copies of a repeated row that one task makes at a time.
COPIES = 4096
#: Words of a shard's piece, the unit in which a mix is dealt out to tasks.
PIECE_WORDS = 8_000_000
SEED = 20240229
_KEYS = ["doc_id", "source", "text_id"]


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> dict:
    """Target words by source: the total shared by weight, none above ``cap`` times its source's size.

    Sources in code point order, null last, take the weights in turn; what a capped source can't use
    is shared again by weight among the others until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        rest = total - sum(out.values())
        share = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > cap * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / share for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in out]
    return {s: out[s] for s in order}


def _log_factorial(k: int) -> Decimal:
    """ln k! in the current decimal context: Stirling's series, exact factorials where it is short of digits."""
    if k < 1024:
        return Decimal(math.factorial(k)).ln()
    z, half_log_2pi = Decimal(k), Decimal("0.91893853320467274178032973640561763986139747363778")
    tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z + Decimal("0.5")) * z.ln() - z + half_log_2pi + tail


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw at any population, by rejection under the envelope that every log-concave distribution obeys:
    f(mode + x) <= f(mode) * min(1, exp(1 + f(mode) / 2 - f(mode) * |y|)) for y within a half of x."""
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    with localcontext() as ctx:
        ctx.prec = 40
        log_p = lambda x: -sum(map(_log_factorial, (x, good - x, n - x, bad - n + x)))
        const = sum(map(_log_factorial, (good, bad, n, good + bad - n))) - _log_factorial(good + bad)
        at_mode = log_p(mode)
        p = math.exp(const + at_mode)
        w = 1 + p / 2
        while True:
            y = rng.random() * w / p if rng.random() * (1 + w) <= w else (w + rng.exponential()) / p
            x = mode + round(y) * (1 if rng.random() < 0.5 else -1)
            if low <= x <= high and math.log(1 - rng.random()) + min(0.0, w - p * y) <= float(log_p(x) - at_mode):
                return x


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw; the generator of numpy takes no population of 10 ** 9 or more."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    return int(rng.hypergeometric(good, bad, n)) if good + bad < 1_000_000_000 else _large_hypergeometric(rng, good, bad, n)


def split_quotas(quotas: Sequence[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """Counts by shard and source; each source's counts sum to its quota, shards' totals differ by one at most."""
    if shards == 1:
        return [list(quotas)]
    left = shards // 2
    left_total = sum(quotas) * left // shards
    need, rest, mine = left_total, sum(quotas), []
    for q in quotas:
        rest -= q
        x = _hypergeometric(rng, q, rest, need)
        mine.append(x)
        need -= x
    other = [q - x for q, x in zip(quotas, mine, strict=True)]
    return split_quotas(mine, left, rng) + split_quotas(other, shards - left, rng)


def _same_row(a: str, b: str) -> Column:
    """Join condition on a row's identity; null ids and sources equal themselves."""
    same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _KEYS[:2]]
    return same[0] & same[1] & (F.col(f"{a}.text_id") == F.col(f"{b}.text_id"))


def _groups(docs: DataFrame) -> DataFrame:
    """One row a group of rows equal in doc_id, source and text: these, n (rows) and size (words of one)."""
    rows = docs.select("doc_id", "source", text_id("text").alias("text_id"), F.size(words_of("text")).cast("long").alias("size"))
    return materialize(rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min("size").alias("size")), "mix-rows")


def _copies(groups: DataFrame) -> DataFrame:
    """A row for each copy 1 to n; a large group's copies are made in pieces that many tasks share."""
    if (groups.agg(F.max("n").alias("n")).first()["n"] or 0) > COPIES:
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("piece")
        groups = groups.select("*", piece).repartition(*_KEYS, "piece")
        first = F.col("piece") * COPIES + 1
        return groups.select("*", F.explode(F.sequence(first, F.least(F.col("n"), first + (COPIES - 1)))).alias("copy")).drop("piece")
    return groups.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def _ahead(totals: DataFrame, bits: int) -> DataFrame:
    """Per source and bucket n0 and w0, the sums of n and w over the source's buckets before it.

    Summed in two levels of about the square root of the number of buckets, so no task holds a source's buckets.
    """
    totals = totals.withColumn("coarse", F.shiftrightunsigned("bucket", bits // 2))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(upto(w)), F.lit(0))
    across, inside = Window.partitionBy("source").orderBy("coarse"), Window.partitionBy("source", "coarse").orderBy("bucket")
    top = totals.groupBy("source", "coarse").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    top = top.select(F.col("source").alias("__s"), F.col("coarse").alias("__c"), before("n", across).alias("n1"), before("w", across).alias("w1"))
    low = totals.select("source", "coarse", "bucket", before("n", inside).alias("n0"), before("w", inside).alias("w0"))
    out = low.join(top, F.col("source").eqNullSafe(F.col("__s")) & (F.col("coarse") == F.col("__c")))
    return out.select(
        F.col("source").alias("__s"), F.col("bucket").alias("__b"), (F.col("n0") + F.col("n1")).alias("n0"), (F.col("w0") + F.col("w1")).alias("w0")
    )


def _ranked_blocks(live: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Blocks of documents with words, with pos (rank in the source's permutation) and before (words of the blocks ahead)."""
    count = F.ceil(F.col("size") / block_words).cast("int")
    n = live.agg(F.sum(count * F.col("n")).alias("n")).first()["n"] or 0
    blocks = _copies(live).select(*_KEYS, "copy", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    blocks = blocks.withColumn("start_word", F.col("block") * block_words).withColumn(
        "block_size", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("start_word"))
    )
    blocks = blocks.withColumn("h", F.xxhash64(*_KEYS, "copy", "block", F.lit(seed)))
    bits = max(0, math.ceil(math.log2(max(1, n) / BUCKET_ROWS)))
    blocks = blocks.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    offsets = _ahead(blocks.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("block_size").alias("w")), bits)
    inside = Window.partitionBy("source", "bucket").orderBy("h", *_KEYS, "copy", "block")
    ranked = blocks.withColumn("r", F.row_number().over(inside)).withColumn(
        "w", F.sum("block_size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    out = ranked.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return out.select(
        *_KEYS, "copy", "size", "block", "start_word", "block_size",
        (F.col("n0") + F.col("r") - 1).alias("pos"), (F.col("w0") + F.coalesce("w", F.lit(0))).alias("before"),
    )


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, shards: int = 16,
    block_words: int = 128, seed: int = SEED,
) -> DataFrame:
    """Every block of every document with the draws the mix makes of it.

    Columns: doc_id, source, text_id, copy (tell rows apart; copies count from 1), size, source_size,
    target, block, start_word, block_size, draws: array of (shard, order_key, pass, n_words); a block that
    the mix leaves out has an empty array. The same input gives the same plan.

    Edge cases: a null source is a source of its own, in last place; null and empty texts have size 0
    and one block of no words, never drawn; repeated rows are mixed each by itself; an empty table
    gives an empty plan; other columns, whatever their names, are not read.
    """
    return _plan(_groups(docs), weights, cap, shards, block_words, seed)


def _plan(groups: DataFrame, weights: Sequence[float], cap: float, shards: int, block_words: int, seed: int) -> DataFrame:
    spark = groups.sparkSession
    recipe = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()
    want = targets({r["source"]: r["size"] for r in recipe}, weights, cap)
    size = {r["source"]: r["size"] for r in recipe}
    quota = {s: min(round(t), math.floor(cap * size[s])) for s, t in want.items()}

    ranked = materialize(_ranked_blocks(groups.filter("size > 0"), block_words, seed), "mix-blocks")
    order = list(want)
    passes = {s: quota[s] // size[s] if size[s] else 0 for s in order}
    extra = {s: quota[s] % size[s] if size[s] else 0 for s in order}
    schema = "__s string, source_size long, target double, passes long, extra long"
    table = spark.createDataFrame([(s, size[s], want[s], passes[s], extra[s]) for s in order], schema)
    table = _recipe(table, len(order))
    blocks = ranked.join(table, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    counts = {
        r["source"]: (r["n"], r["m"])
        for r in blocks.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("before") < F.col("extra")).alias("m")).collect()
    }
    draws = [passes[s] * counts[s][0] + counts[s][1] if s in counts else 0 for s in order]
    by_shard = split_quotas(draws, shards, np.random.default_rng(seed))
    tree = _recipe(
        spark.createDataFrame(
            [(s, counts.get(s, (0, 0))[0], np.cumsum([q[i] for q in by_shard]).tolist()) for i, s in enumerate(order)],
            "__s string, n_blocks long, ends array<long>",
        ),
        len(order),
    )
    none = F.array().cast("array<long>")
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(none)
    last = F.when(F.col("before") < F.col("extra"), F.array("passes")).otherwise(none)

    def draw(p):
        # ends: the source's draws up to and with each shard, so a draw's shard is the number of ends it has passed
        index = p * F.col("n_blocks") + F.col("pos")
        cut = F.least(F.col("block_size"), F.col("extra") - F.col("before"))
        return F.struct(
            F.size(F.filter("ends", lambda e: e <= index)).alias("shard"),
            F.xxhash64(*_KEYS, "copy", "block", p, F.lit(seed + 1)).alias("order_key"),
            p.alias("pass"),
            F.when(p == F.col("passes"), cut).otherwise(F.col("block_size")).alias("n_words"),
        )

    columns = [*_KEYS, "copy", "size", "source_size", "target", "block", "start_word", "block_size"]
    drawn = blocks.join(tree, F.col("source").eqNullSafe(F.col("__s"))).select(
        *columns, F.transform(F.concat(whole, last), draw).alias("draws")
    )
    empty = _copies(groups.filter("size = 0")).join(table, F.col("source").eqNullSafe(F.col("__s")))
    for c, kind in (("block", "int"), ("start_word", "int"), ("block_size", "long")):
        empty = empty.withColumn(c, F.lit(0).cast(kind))
    kind = drawn.schema["draws"].dataType
    return drawn.unionByName(empty.select(*columns, F.array().cast(kind).alias("draws")))


def _recipe(df: DataFrame, rows: int) -> DataFrame:
    """One row per source: broadcast while few, as it is otherwise."""
    return F.broadcast(df) if rows <= 100_000 else df


def _span(text: str, start: Column, n: Column) -> Column:
    """``n`` words of a text from the word ``start`` (from 0) on, joined by spaces."""
    raw = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    return F.array_join(F.slice(raw, (start + 1).cast("int"), n.cast("int")), " ")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (shard, order_key, pass, doc_id, source, block, start_word, n_words, text).

    Ordering a shard's rows by order_key is its local shuffle. text is the drawn span's words, joined
    by spaces. Options and edge cases as for :func:`plan_mix`.
    """
    plan = plan_mix(docs, **options).select("*", F.explode("draws").alias("d")).alias("p")
    texts = docs.select("doc_id", "source", text_id("text").alias("text_id"), F.col("text").alias("__text"))
    texts = texts.dropDuplicates(_KEYS).alias("t")
    return plan.join(texts, _same_row("p", "t")).select(
        "d.shard", "d.order_key", "d.pass", "p.doc_id", "p.source", "block", "start_word", "d.n_words",
        _span("__text", F.col("start_word"), F.col("d.n_words")).alias("text"),
    )


def _numbered(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc, a struct of all columns; doc_id, source, text_id, copy): the rows of each group numbered from 1.

    Rows of repeated groups are written with a number of their own; a row's copy is its rank among its
    group's rows of the same partition plus those of the partitions before, so no task counts a whole group.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, "doc_id", "source", text_id("text").alias("text_id"))
    again = materialize(groups.filter("n > 1").select(*_KEYS), "mix-again")
    one = F.lit(1).cast("long").alias("copy")
    if again.isEmpty():
        return rows.select("*", one)
    on = _same_row("r", "a")
    single = rows.alias("r").join(again.alias("a"), on, "left_anti").select("*", one)
    several = rows.alias("r").join(again.alias("a"), on, "left_semi").withColumn("no", F.monotonically_increasing_id())
    several = materialize(several, "mix-several")
    slim = several.select(*_KEYS, "no", F.shiftright("no", 33).alias("part"))
    ahead = Window.partitionBy(*_KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.groupBy(*_KEYS, "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("a")
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS, "part").orderBy("no"))).alias("r")
    copies = ranked.join(parts, on & (F.col("r.part") == F.col("a.part"))).select("no", (F.col("rank") + F.col("ahead")).alias("copy"))
    return single.unionByName(several.join(copies, "no").drop("no"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, shards: int = 16, seed: int = SEED
) -> DataFrame:
    """The mix with whole documents as blocks: ``docs`` rows, each as often as drawn, columns as they are.

    Rows are dealt out by the tree's shard and, inside each piece of a shard, in the permuted order of its
    local shuffle; written as it is, the result keeps both. The last document drawn of a source is cut
    to its first words, so the source meets its quota to the word; n_chars, if there is such a column, is the
    text's new length. Other columns stay as they are.

    Edge cases: as for :func:`plan_mix`; of rows equal in doc_id, source and text but not in other columns each is
    drawn as a copy of its own, and which of them is which copy is open; column names may be any.
    """
    groups = _groups(docs)
    total = groups.agg(F.sum(F.col("size") * F.col("n")).alias("n")).first()["n"] or 0
    draws = _plan(groups, weights, cap, shards, 1 << 40, seed).select(*_KEYS, "copy", "size", F.explode("draws").alias("d")).alias("a")
    rows = _numbered(docs, groups).alias("r")
    out = rows.join(draws, _same_row("r", "a") & (F.col("r.copy") == F.col("a.copy"))).select("doc", "size", "d")
    shortened, n = F.col("d.n_words") < F.col("size"), F.col("d.n_words")
    text = F.when(shortened, _span("doc.text", F.lit(0), n)).otherwise(F.col("doc.text"))
    # shard and order ride along as far as the sort and are dropped after it
    out = out.select("doc", "d", text.alias("text"), shortened.alias("shortened"))
    out = deal_out(out, F.col("d.shard"), F.col("d.order_key"), 1 + total // shards // PIECE_WORDS)

    def column(c: str) -> Column:
        if c.lower() == "text":
            return F.col("text").alias(c)
        old = F.col("doc").getField(c)
        if c.lower() == "n_chars":
            return F.when(F.col("shortened"), F.length("text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*[column(c) for c in docs.columns])


def deal_out(rows: DataFrame, shard: Column, order_key: Column, pieces: int) -> DataFrame:
    """``rows`` with each shard in ``pieces`` parts dealt out to tasks, and each part in order of ``order_key``."""
    return rows.repartition(shard, F.pmod(order_key, F.lit(pieces))).sortWithinPartitions(shard, order_key)


def write_mix(mixed: DataFrame, path: str, files_per_shard: int | None = None) -> None:
    """Write the output of :func:`mix` as folders shard=j, each file in its locally shuffled order.

    Without ``files_per_shard`` a shard gets a file for every ``PIECE_WORDS`` words of its share.
    """
    if files_per_shard is None:
        size = mixed.agg(F.sum("n_words").alias("n"), F.max("shard").alias("s")).first()
        files_per_shard = 1 + (size["n"] or 0) // (1 + (size["s"] or 0)) // PIECE_WORDS
    deal_out(mixed, F.col("shard"), F.col("order_key"), files_per_shard).write.partitionBy("shard").parquet(path)


def taken_per_document(plan: DataFrame, shards: int = 0) -> DataFrame:
    """One row per row of the documents: doc_id, source, size, source_size, target, taken (words).

    With ``shards`` also shard_words, how many of them the splitting tree gave to each shard.
    """
    keys = [*_KEYS, "copy", "size", "source_size", "target"]
    each = plan.select(*keys, F.explode_outer("draws").alias("d")).select(*keys, "d.shard", F.coalesce("d.n_words", F.lit(0).cast("long")).alias("n"))
    in_shard = [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"w{s}") for s in range(shards)]
    out = each.groupBy(*keys).agg(F.sum("n").alias("taken"), *in_shard)
    dealt = [F.array(*[f"w{s}" for s in range(shards)]).alias("shard_words")] if shards else []
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *dealt)
