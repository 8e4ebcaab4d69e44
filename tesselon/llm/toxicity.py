"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a document are the presence of words (runs of letters, lower-cased) and of word beginnings of
four to six letters, which inflected words share; the training sample selects those that speak for toxic
documents. A text of any length is one sparse row. Grades: labels say toxic or not, so a toxic document's
grade is 1, 2 or 3 by how many distinct words with such features it holds (none or one, two or three, four or
more), 0 if it isn't toxic. The model shares one vector of weights, none negative, across the ordered
thresholds: P(grade > k) = sigmoid(w x - b_k), b_0 <= b_1 <= b_2. Its output is the expected severity, the sum
of P(grade > k) over k. No weight is negative because a long harmless passage does not excuse an insult.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.labelled import labelled_sample
from tesselon.session import materialize

#: Bounds of the training sample and of the vocabulary.
SAMPLE_ROWS = 6000
VOCABULARY = 4000
GRADES = 4
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_LONG = 1 << 16


def words(text: str | None) -> set[str]:
    """Distinct words; a long text is read match by match, so that only its vocabulary is held."""
    low = (text or "").lower()
    return set(_WORD.findall(low)) if len(low) < _LONG else {m.group() for m in _WORD.finditer(low)}


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a caret."""
    n = len(word)
    return [word, *("^" + word[:k] for k in PREFIXES if n > k)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def evidence(self, text: str | None) -> float | None:
        """Sum of the weights of a text's features; None for a text without words."""
        found, v = words(text), self.vocabulary
        if not found:
            return None
        cols = {v[f] for w in found for f in features(w) if f in v}
        return float(self.weights[list(cols)].sum())

    def exceed(self, evidence: float | None) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2; a text without words has severity 0."""
        return np.zeros(GRADES - 1) if evidence is None else _sigmoid(evidence - self.thresholds)

    def rejects(self, evidence: float | None) -> bool:
        """Likelier toxic than not, on the evidence of its words and not of the sample's rate alone."""
        return evidence is not None and evidence > 0 and evidence >= self.thresholds[0]


def strength(bad: np.ndarray, all_: np.ndarray, n_bad: int, n: int) -> np.ndarray:
    """Likelihood ratio of features that ``bad`` toxic ones of ``all_`` documents hold; 0 unless four in five are toxic."""
    a, c = np.asarray(bad, float), np.asarray(all_, float)
    e = c * n_bad / max(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (a * np.log(a / e) + np.where(c > a, (c - a) * np.log((c - a) / (c - e)), 0.0))
    return np.where((a > 0.8 * c) & (a > e), g, 0.0)


#: Hundreds of thousands of features are tried: about one in a hundred thousand passes this by chance.
LEAST_STRENGTH, LEAST_DOCUMENTS = 20.0, 3


def fit(rows: list[tuple[str, int]], vocabulary: int = VOCABULARY, **options) -> Model:
    """Train on (text, toxic) pairs in memory; :func:`train` does the same for tables."""
    bags, n_bad = [words(t) for t, _ in rows], sum(t for _, t in rows)
    bad, all_ = Counter(), Counter()
    for bag, (_, toxic) in zip(bags, rows, strict=True):
        found = {f for w in bag for f in features(w)}
        all_.update(found)
        bad.update(found if toxic else ())
    names = [f for f, a in bad.items() if a >= LEAST_DOCUMENTS]
    g = strength([bad[f] for f in names], [all_[f] for f in names], n_bad, len(rows))
    names = [f for _, f in sorted((-x, f) for x, f in zip(g, names, strict=True) if x > LEAST_STRENGTH)[:vocabulary]]
    index = {f: i for i, f in enumerate(names)}
    return learn(index, [row(bag, index) for bag in bags], np.array([t for _, t in rows], int), **options)


def row(bag: set[str], index: dict[str, int]) -> tuple[list[int], int]:
    """A document's sparse row: numbers of the features it holds, and how many of its words hold any."""
    per_word = [[index[f] for f in features(w) if f in index] for w in bag]
    return sorted({i for x in per_word for i in x}), sum(map(bool, per_word))


def learn(index: dict[str, int], rows: list[tuple[list[int], int]], y: np.ndarray, rounds: int = 500, l2: float = 0.05) -> Model:
    """Weights and thresholds from sparse rows; without features no document is rejected."""
    hits = np.array([h for _, h in rows], int)
    grade = np.where(y == 1, 1 + (hits >= 2) + (hits >= 4), 0)
    over = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    w = np.zeros(len(index))
    rate = np.clip(over.mean(0), 1e-3, 1 - 1e-3) if len(rows) else np.full(GRADES - 1, 1e-3)
    b = -np.log(rate / (1 - rate))
    r = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows]).astype(int)
    c = np.array([i for x, _ in rows for i in x], int)
    m, v = np.zeros(len(w) + len(b)), np.zeros(len(w) + len(b))
    for t in range(1, rounds + 1 if len(rows) else 1):
        s = np.bincount(r, w[c], minlength=len(rows))
        err = _sigmoid(s[:, None] - b) - over
        dw = np.bincount(c, err.sum(1)[r], minlength=len(w)) / len(rows) + l2 * w / len(rows)
        g = np.r_[dw, -err.mean(0)]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w = np.maximum(0.0, w - step[: len(w)])
        b = np.maximum.accumulate(b - step[len(w) :])
    return Model(index, w, b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Fit on a bounded sample of labelled documents (at most ``max_rows``, whole texts).

    Texts stay on the executors: features are counted there, and the driver gets the chosen ones and the
    documents' sparse rows.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", max_rows).selectExpr("cast(doc_id as long) doc_id", "text", "y"), "toxic-sample")
    sizes = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = Counter()
            for t, y in zip(b["text"], b["y"], strict=True):
                held.update((f, int(y)) for f in {f for w in words(t) for f in features(w)})
            per = [(f, y, n) for (f, y), n in held.items()]
            yield pd.DataFrame(per, columns=["f", "y", "n"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = strength(b["a"].to_numpy(), b["c"].to_numpy(), sizes["bad"], sizes["n"])
            yield pd.DataFrame({"f": b["f"], "g": g})[g > LEAST_STRENGTH]

    counts = sample.mapInPandas(spread, "f string, y int, n long").groupBy("f").agg(
        F.sum("n").alias("c"), F.sum(F.col("n") * F.col("y")).alias("a")
    )
    chosen = counts.filter(F.col("a") >= LEAST_DOCUMENTS).mapInPandas(choose, "f string, g double")
    names = [r["f"] for r in chosen.orderBy(F.desc("g"), "f").limit(vocabulary).collect()]
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [row(words(t), index) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "cols": [x for x, _ in out], "hits": [h for _, h in out]})

    got = sorted(sample.mapInPandas(sparse, "doc_id long, y int, cols array<int>, hits int").collect(), key=lambda r: (r["doc_id"], r["hits"]))
    return learn(index, [(r["cols"], r["hits"]) for r in got], np.array([r["y"] for r in got], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row of ``docs``, whole texts.

    severity is the expected grade (0 to 3), p_toxic = P(grade > 0), toxic is 1 if p_toxic >= 0.5 and the
    document's own words speak for it, and grade is 0 where it is 0, the likeliest of 1 to 3 elsewhere. Null texts and texts without a word
    have severity 0; repeated rows, null ids and other columns need no care: rows are scored one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.evidence(t) for t in b["text"]]
            p = np.array([model.exceed(e) for e in found]).reshape(-1, GRADES - 1)
            bad = np.array([model.rejects(e) for e in found], np.int32)
            each = -np.diff(np.c_[np.ones(len(p)), p, np.zeros(len(p))], axis=1)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "severity": p.sum(1), "p_toxic": p[:, 0],
                "grade": np.where(bad, 1 + each[:, 1:].argmax(1), 0).astype(np.int32), "toxic": bad,
            })

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInPandas(run, "doc_id long, severity double, p_toxic double, grade int, toxic int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows the model rejects; columns stay, each row is judged by its text."""
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not model.rejects(model.evidence(t)) for t in text], dtype=bool)

    return docs.filter(clean("text"))
