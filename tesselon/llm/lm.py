"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Two levels, both neural. Words fall into classes: each of the ``TOP`` most frequent words is one of its own, the
others share classes by the hash of their last three bytes. The log-bilinear model predicts a token's class from
those of the two before it: the context vector is the sum of the two classes' vectors, each scaled by a
position vector, and a class's logit its product with the context plus a bias. Inside a class the
``NEURAL`` next frequent words have vectors of their own: a word's logit is the log of its count plus the product
of its vector with the same context, so words that share a class are told apart by what stands before them.

Training is noise-contrastive at both levels (noise: the classes' corpus frequencies, samples shared by a batch;
inside a class its words' frequencies), so all is batched array work: a start on a bounded sample, then one
round of parameter mixing in which every partition trains on all its training documents and the results are
averaged, classes by tokens, words by their occurrences. The sums travel as one binary row a block of parameters
and partition, added up in a tree. Afterwards both levels are normalised exactly, in batched matrix products: all
pairs of context classes once, the words of a class for each token.

Rarer words have the share of their class that their add-0.1 frequency gives (one slot held for words never
seen), words with vectors divide the share that all of them have, so the model, like the base it is compared with,
spreads one unit of mass. No word is left out at any size of the vocabulary.

Word counts are exact counts over all training documents. The words above a frequency threshold (at
most ``HOT_WORDS``) go to the workers as a table of bounded size; the counts of all others are joined by
shuffle, which is the exact way for the rest. The averaged parameters depend on how rows are dealt to partitions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.labelled import fold
from tesselon.session import materialize

HOT_WORDS = 300_000
TOP = 384
SUFFIXES = 128
CLASSES = TOP + SUFFIXES
DIM = 24
NOISE = 32
BATCH = 4096
#: Words with vectors of their own beside the ``TOP`` ones.
NEURAL = 16_384
#: Bound of the sample that the model starts from, in documents of at most so many characters; all documents follow.
START_DOCS, START_CHARS = 400, 100_000
END = b""
ADD = 0.1
_FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of anything but ASCII white space, then the end token."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(w binary, n long): exact counts of all tokens, combined in the worker and again before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(tokens(t))
                if len(held) > _FLUSH:
                    yield pd.DataFrame({"w": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"w": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def suffix_class(w: bytes) -> int:
    return TOP + zlib.crc32(w[-3:]) % SUFFIXES


@dataclass
class Vocabulary:
    """Counts of the frequent words, classes, and the classes' totals."""

    index: dict[bytes, int]
    count: np.ndarray
    klass: np.ndarray
    total: int
    distinct: int
    class_count: np.ndarray
    class_words: np.ndarray
    threshold: int
    #: Words with vectors, in order of their class: slot by word number (-1: none), first slot by class, counts
    slot: np.ndarray
    first: np.ndarray
    members: np.ndarray

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: not in the table) and class of each word."""
        get = self.index.get
        i = np.array([get(w, -1) for w in words], np.int64)
        k = self.klass[i]
        for j in np.flatnonzero(i < 0):
            k[j] = suffix_class(words[j])
        return i, k


def vocabulary(counts: DataFrame, hot: int = HOT_WORDS) -> Vocabulary:
    """From materialized word counts; at most ``hot`` words reach the driver."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("low"))
    levels = sorted(levels.collect(), key=lambda r: -r["b"])
    threshold, seen = 1 << 62, 0
    for r in levels:
        seen += r["v"]
        if seen > hot:
            break
        threshold = r["low"]
    table = counts.filter(F.col("n") >= threshold).toArrow()
    rows = sorted(zip(table["w"].to_pylist(), table["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    index = {w: i for i, (w, _) in enumerate(rows)}
    klass = np.array([i if i < TOP else suffix_class(w) for i, (w, _) in enumerate(rows)] + [0], np.int64)
    suffix = F.crc32(F.substring("w", -3, 3)) % SUFFIXES
    class_count, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(suffix.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_count[TOP + r["k"]], class_words[TOP + r["k"]] = r["n"], r["v"]
    for i, (w, n) in enumerate(rows[:TOP]):
        class_count[suffix_class(w)] -= n
        class_words[suffix_class(w)] -= 1
        class_count[i], class_words[i] = n, 1
    count = np.array([n for _, n in rows] + [0], float)
    own = np.arange(min(TOP, len(rows)), min(TOP + NEURAL, len(rows)))
    own = own[np.argsort(klass[own], kind="stable")]
    slot = np.full(len(rows) + 1, -1, np.int64)
    slot[own] = np.arange(len(own))
    return Vocabulary(
        index, count, klass, sum(r["n"] for r in levels), sum(r["v"] for r in levels), class_count, class_words, threshold,
        slot, np.searchsorted(klass[own], np.arange(CLASSES + 1)), count[own],
    )


class LogBilinear:
    """Parameters, noise-contrastive training and exact normalisation of the class model."""

    def __init__(self, noise: np.ndarray, flat: np.ndarray | None = None, seed: int = 1):
        self.noise = noise
        self.shapes = [(CLASSES, DIM), (CLASSES, DIM), (2, DIM), (CLASSES,)]
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, self.sizes[0] + self.sizes[1]), np.ones(2 * DIM), np.log(noise)])
        self.flat = flat.astype(np.float32)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum(self.sizes)[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, cuts), self.shapes, strict=True)]

    def train(self, k1: np.ndarray, k2: np.ndarray, k: np.ndarray, state: np.ndarray, rng, rate: float = 0.05) -> None:
        """Adagrad over batches of tokens k with their contexts k1 (last) and k2 (the one before)."""
        vec, out, pos, bias = self.parts(self.flat)
        g_flat = np.empty_like(self.flat)
        dims = np.arange(DIM)
        prior = np.log(NOISE * self.noise).astype(np.float32)
        cdf = np.cumsum(self.noise)
        for s in range(0, len(k), BATCH):
            a, b, c = k1[s : s + BATCH], k2[s : s + BATCH], k[s : s + BATCH]
            z = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), CLASSES - 1)
            va, vb, oc, oz = vec[a], vec[b], out[c], out[z]
            q = va * pos[0] + vb * pos[1]
            gd = -1 / (1 + np.exp((q * oc).sum(1) + bias[c] - prior[c]))
            gn = 1 / (1 + np.exp(-(q @ oz.T + bias[z] - prior[z])))
            gq = gd[:, None] * oc + gn @ oz
            g_vec, g_out, g_pos, g_bias = self.parts(g_flat)
            add = lambda i, x: np.bincount((i[:, None] * DIM + dims).ravel(), x.ravel(), minlength=CLASSES * DIM)
            g_vec[:] = (add(a, gq * pos[0]) + add(b, gq * pos[1])).reshape(CLASSES, DIM)
            g_out[:] = (add(c, gd[:, None] * q) + add(z, gn.T @ q)).reshape(CLASSES, DIM)
            g_pos[0], g_pos[1] = (gq * va).sum(0), (gq * vb).sum(0)
            g_bias[:] = np.bincount(c, gd, minlength=CLASSES) + np.bincount(z, gn.sum(0), minlength=CLASSES)
            g_flat /= len(c)
            state += g_flat**2
            self.flat -= rate * g_flat / (np.sqrt(state) + 1e-6)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits by last class, by the class before, and the log of the normaliser of each pair."""
        vec, out, pos, bias = self.parts(self.flat.astype(np.float64))
        s1, s2 = (vec * pos[0]) @ out.T + bias, (vec * pos[1]) @ out.T
        log_z = np.empty((CLASSES, CLASSES))
        for i in range(CLASSES):
            x = s1[i] + s2
            top = x.max(1)
            log_z[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
        return s1, s2, log_z


def context_vectors(model: LogBilinear, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    vec, _, pos, _ = model.parts(model.flat)
    return vec[k1] * pos[0] + vec[k2] * pos[1]


class ClassWords:
    """Vectors of the words inside the classes."""

    def __init__(self, vocab: Vocabulary, vectors: np.ndarray | None = None):
        self.first, self.n = vocab.first, vocab.members
        self.vectors = np.zeros((len(self.n), DIM), np.float32) if vectors is None else vectors.astype(np.float32)
        self.upto = np.r_[0.0, np.cumsum(self.n)]
        self.log_n = np.log(np.maximum(self.n, 1e-9)).astype(np.float32)
        self.state = np.ones_like(self.vectors)

    def train(self, q: np.ndarray, slot: np.ndarray, k: np.ndarray, rng, rate: float = 0.1) -> np.ndarray:
        """One Adagrad step: each word against one noise word of its class; gives the words' occurrences."""
        at = np.flatnonzero(slot >= 0)
        w, c, q = slot[at], k[at], q[at]
        lo, hi = self.upto[self.first[c]], self.upto[self.first[c + 1]]
        v = np.searchsorted(self.upto, lo + rng.random(len(at)) * (hi - lo), side="right") - 1
        v = np.minimum(v, self.first[c + 1] - 1)
        dot = lambda x: np.einsum("ij,ij->i", q, self.vectors[x])
        # the noise is the frequency that a logit starts from, so it cancels and the product alone decides
        gd, gn = -1 / (1 + np.exp(dot(w))), 1 / (1 + np.exp(-dot(v)))
        dims = np.arange(DIM)
        add = lambda i, g: np.bincount((i[:, None] * DIM + dims).ravel(), (g[:, None] * q).ravel(), minlength=self.vectors.size)
        grad = (add(w, gd) + add(v, gn)).reshape(self.vectors.shape).astype(np.float32)
        self.state += grad**2
        self.vectors -= rate * grad / np.sqrt(self.state)
        return np.bincount(w, minlength=len(self.n))

    def log_share(self, q: np.ndarray, slot: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Log of each word's part of what the words with vectors of its class have; all slots must be valid."""
        out = self.log_n[slot] + np.einsum("ij,ij->i", q, self.vectors[slot])
        order = np.argsort(k, kind="stable")
        ends = np.flatnonzero(np.r_[k[order][1:] != k[order][:-1], len(k) > 0])
        for s, e in zip(np.r_[0, ends[:-1] + 1], ends + 1, strict=True):
            rows = order[s:e]
            c = k[rows[0]]
            a, b = self.first[c], self.first[c + 1]
            x = q[rows] @ self.vectors[a:b].T
            x += self.log_n[a:b]
            top = x.max(1, keepdims=True)
            np.exp(x - top, out=x)
            out[rows] -= np.log(x.sum(1)) + top[:, 0]
        return out


def contexts(k: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token of a document; the end's class stands before its start."""
    return np.r_[ends, k[:-1]], np.r_[ends, ends, k[:-2]][: len(k)]


def _sequences(texts, vocab: Vocabulary, ends: int):
    """Contexts, classes and slots of whole texts, gathered to about 16 batches a turn."""
    held, n = [], 0
    for t in texts:
        i, k = vocab.ids(tokens(t))
        held.append((*contexts(k, ends), k, vocab.slot[i]))
        n += len(k)
        if n >= 16 * BATCH:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _learn(model: LogBilinear, words: ClassWords, state: np.ndarray, turn, rng) -> np.ndarray:
    k1, k2, k, slot = turn
    mixed = rng.permutation(len(k))
    model.train(k1[mixed], k2[mixed], k[mixed], state, rng)
    return words.train(context_vectors(model, k1, k2), slot, k, rng)


#: Parameters of a block in the sums that partitions send, and how many blocks are added up at a time.
_BLOCK, _FAN_IN = 1 << 16, 64


def _summed(parts: DataFrame, partitions: int) -> np.ndarray:
    """Element-wise sum of the partitions' vectors, in (part, block, x: float32 bytes) rows, added up in a tree."""
    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in g["x"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"part": [g["part"].iloc[0]], "block": [g["block"].iloc[0]], "x": [total.tobytes()]})

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / _FAN_IN)).groupBy("block", "part").applyInPandas(add, "part long, block int, x binary")
        partitions = -(-partitions // _FAN_IN)
        if partitions <= 1:
            break
    rows = sorted(parts.select("block", "x").collect(), key=lambda r: r["block"])  # one row a block of parameters
    return np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros(0, np.float32)


def train(docs: DataFrame, vocab_ref, start_docs: int = START_DOCS) -> tuple[LogBilinear, ClassWords]:
    """Train on all of ``docs`` (the training documents); ``vocab_ref`` is a broadcast Vocabulary."""
    vocab = vocab_ref.value
    noise = np.maximum(vocab.class_count, 0.5)
    noise = noise / noise.sum()
    ends = int(vocab.klass[vocab.index[END]]) if END in vocab.index else suffix_class(END)
    model, words = LogBilinear(noise), ClassWords(vocab)
    n = docs.count()
    if not n:
        return model, words
    at = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30))
    few = docs.filter((at < min(1 << 30, int(1.3 * start_docs / n * (1 << 30)) + 1)) & (F.length(F.coalesce("text", F.lit(""))) <= START_CHARS))
    few = few.select("text", at.alias("at")).orderBy("at", F.xxhash64("text")).limit(start_docs)
    first = sorted(r["text"] or "" for r in few.collect())
    rng, state = np.random.default_rng(2), np.full(len(model.flat), 1e-6, np.float32)
    for _ in range(3):
        for turn in _sequences(first, vocab, ends):
            _learn(model, words, state, turn, rng)
    start, start_words = model.flat.copy(), words.vectors.copy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, r, seen, part = vocab_ref.value, np.random.default_rng(4), 0, 0
        mine, own, acc = LogBilinear(noise, start), ClassWords(v, start_words), state.copy()
        times = np.zeros(len(own.n))
        for b in batches:
            part = b["part"].iloc[0] if len(b) else part
            for turn in _sequences(b["text"], v, ends):
                times += _learn(mine, own, acc, turn, r)
                seen += len(turn[0])
        if seen:
            sums = np.concatenate([[seen], mine.flat * float(seen), times, (own.vectors * times[:, None]).ravel()]).astype(np.float32)
            blocks = [sums[i : i + _BLOCK].tobytes() for i in range(0, len(sums), _BLOCK)]
            yield pd.DataFrame({"part": part, "block": np.arange(len(blocks), dtype=np.int32), "x": blocks})

    rows = docs.select("text", F.spark_partition_id().cast("long").alias("part"))
    sums = _summed(rows.mapInPandas(run, "part long, block int, x binary"), docs.rdd.getNumPartitions()).astype(np.float64)
    if not len(sums):
        return model, words
    seen, flat, rest = sums[0], sums[1 : 1 + len(start)], sums[1 + len(start) :]
    times, vectors = rest[: len(words.n)], rest[len(words.n) :].reshape(-1, DIM)
    met = np.where(times[:, None] > 0, vectors / np.maximum(times, 1)[:, None], start_words)
    return LogBilinear(noise, flat / seen), ClassWords(vocab, met)


def lm_scores(docs: DataFrame, folds: int = 10, hot: int = HOT_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-0.1 unigram log10 probability, score the model's. Whole texts are read; the rows
    of remainder 0 of ``folds`` are scored but not learned from.

    Edge cases: null and empty texts are one end token; with no training rows all tokens are unknown, N
    and V are 0; rows that repeat an id, or have none, are scored each by itself; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(folds) == 0).alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(training), "lm-counts")
    vocab = vocabulary(counts, hot)
    ref = spark.sparkContext.broadcast(vocab)
    model, words = train(training, ref)
    ends = int(vocab.klass[vocab.index[END]]) if END in vocab.index else suffix_class(END)
    tables = spark.sparkContext.broadcast((tuple(x.astype(np.float32) for x in model.tables()), model.flat, words.vectors))
    noise = model.noise
    class_norm = np.log10(vocab.class_count + ADD * (vocab.class_words + 1))
    class_norm[:TOP] = 0.0
    log_count = np.log10(vocab.count + ADD)
    upto = np.r_[0.0, np.cumsum(vocab.members + ADD)]
    log_mass = np.log10(np.maximum(upto[vocab.first[1:]] - upto[vocab.first[:-1]], ADD))

    def scores(held: list, v: Vocabulary, own: ClassWords, at: LogBilinear, logits) -> list[tuple]:
        """(known, log10 count of the known words, log10 probability without rare words' counts) of each of some texts."""
        s1, s2, log_z = logits
        i, k = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.r_[0, np.cumsum([len(x) for x, _ in held])[:-1]]
        k1, k2 = contexts(k, ends)
        second = starts[np.r_[starts[1:], len(k)] > starts + 1] + 1
        k1[starts], k2[starts], k2[second] = ends, ends, ends
        log_p = (s1[k1, k] + s2[k2, k] - log_z[k1, k2]).astype(np.float64) / np.log(10) - class_norm[k]
        slot = v.slot[i]
        inside, plain = np.flatnonzero(slot >= 0), (slot < 0) & (i >= 0) & (k >= TOP)
        log_p[plain] += log_count[i[plain]]
        if len(inside):
            q = context_vectors(at, k1[inside], k2[inside])
            log_p[inside] += log_mass[k[inside]] + own.log_share(q, slot[inside], k[inside]) / np.log(10)
        known = i >= 0
        sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), np.where(known, log_count[i], 0.0), log_p)]
        return list(zip(*(x.tolist() for x in sums), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, (logits, flat, vectors) = ref.value, tables.value
        own, at = ClassWords(v, vectors), LogBilinear(noise, flat)
        for b in batches:
            got, held, size, rest = [], [], 0, []
            for text in b["text"]:
                w = tokens(text)
                held.append(v.ids(w))
                unknown = Counter([w[j] for j in np.flatnonzero(held[-1][0] < 0)])
                rest.append((len(w), list(unknown), list(unknown.values())))
                size += len(w)
                if size >= 16 * BATCH:
                    got += scores(held, v, own, at, logits)
                    held, size = [], 0
            if held:
                got += scores(held, v, own, at, logits)
            known, hot_sum, partial = zip(*got, strict=True) if got else ((), (), ())
            n, rare, tf = zip(*rest, strict=True) if rest else ((), (), ())
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "n_tokens": n, "n_hot": known, "hot_sum": hot_sum,
                "partial": partial, "rare": rare, "tf": tf,
            })

    scored = rows.mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, partial double, "
        "rare array<binary>, tf array<int>",
    )
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("r")).select("row", F.col("r.rare").alias("w"), "r.tf")
    rest = counts.filter(F.col("n") < vocab.threshold)
    found = rare.join(rest, "w", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("rare_sum"),
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("n_rare"),
    )
    out = scored.drop("rare", "tf").join(found, "row", "left")
    norm = float(np.log10(vocab.total + ADD * (vocab.distinct + 1)))
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + rare_sum - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("partial") + rare_sum).alias("score"),
    )
