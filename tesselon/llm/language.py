"""Language ID as inference in a multilingual mixture.

Each language has a distribution over hashed character trigrams (bytes of the lower-cased text, all but
letters made a space). A document is a mixture: expectation-maximisation estimates each language's
proportion from the trigrams' likelihoods, and the language set is chosen by penalised likelihood,
dropping one language after another as long as that does not cost more than the penalty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.labelled import fold

#: Bound of the training sample, in documents of each language.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 14
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # may still be a sign such as a raised digit, see has_letter
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")
_PIECE = 1 << 20


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams of a text, runs of anything but letters being one space, and their counts.

    A long text is counted piece by piece, so the memory on top of it is bounded.
    """
    raw = np.frombuffer(_OTHER.sub(b" ", b" " + text.lower().encode() + b" "), np.uint8)
    n = np.zeros(BUCKETS, np.int64)
    for s in range(0, max(0, len(raw) - 2), _PIECE):
        b = raw[s : s + _PIECE + 2].astype(np.int64)
        n += np.bincount((b[:-2] * 7919 + b[1:-1] * 263 + b[2:] * 31) & (BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at].astype(float)


class Mixture:
    """Trigram distributions by language and the inference over them."""

    def __init__(self, names: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.names = names
        p = counts + smooth
        self.p = p / p.sum(1, keepdims=True) if len(names) else p

    def em(self, p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
        """Proportions of the languages in p and the log-likelihood of counts n."""
        share, total = np.full(len(p), 1 / len(p)), n.sum()
        for _ in range(rounds):
            mixed = share @ p
            share = share * (p @ (n / mixed)) / total
        return share, float(n @ np.log(share @ p))

    def infer(self, text: str, penalty: float = 2.0) -> dict[str, float]:
        """Proportions of the chosen language set; empty without a letter or a learned language.

        A language stays if its share of the likelihood outweighs ``penalty`` times log(trigrams).
        """
        at, n = trigrams(text)
        if not len(at) or not len(self.names):
            return {}
        p = self.p[:, at]
        chosen = np.arange(len(self.names))
        share, like = self.em(p, n)
        price = penalty * np.log(n.sum() + 1)
        while len(chosen) > 1:
            keep = np.delete(np.arange(len(chosen)), share.argmin())
            less, worse = self.em(p[chosen[keep]], n) if len(keep) > 1 else (np.ones(1), float(n @ np.log(p[chosen[keep[0]]])))
            if like - worse > price:
                break
            chosen, share, like = chosen[keep], less, worse
        return {self.names[i]: float(s) for i, s in zip(chosen, share, strict=True)}


def train(docs: DataFrame, folds: int = 5, max_rows: int = SAMPLE_ROWS) -> Mixture:
    """Learn from text and non-null lang of at most ``max_rows`` documents a language, remainder 0 left out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds) != 0))
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in per_lang.collect()}  # one row a language
    if not sizes:
        return Mixture([], np.zeros((0, BUCKETS)))
    # a hash range a language keeps about max_rows documents, the same each time
    cut = F.lit(0)
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * max_rows / n)))).otherwise(cut)
    # rows of one id fall apart by their texts, and a repeated row counts once, so the bound holds for any input
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) < cut).select("lang", "text").dropDuplicates()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                at, n = trigrams(text)
                total.setdefault(lang, np.zeros(BUCKETS))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    sums = picked.mapInPandas(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(sizes)
    counts = np.zeros((len(names), BUCKETS))
    for r in sums.collect():  # at most BUCKETS rows a language
        counts[names.index(r["lang"]), r["bucket"]] = r["n"]
    return Mixture(names, counts)


def identify(docs: DataFrame, model: Mixture, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row of ``docs``, whole texts.

    lang_pred is the language of the largest proportion (ties: first by name), score that proportion,
    languages the chosen set with proportions. A text that is null or has no letter is ``und`` with
    score 0 and an empty set. Rows are judged one by one: repeated rows, null ids and other columns
    need no care.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.infer(t) if t is not None and has_letter(t) else {} for t in b["text"]]
            best = [max(f.items(), key=lambda x: x[1]) if f else (UNKNOWN, 0.0) for f in found]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x for x, _ in best],
                "score": [min(1.0, s) for _, s in best], "languages": found,
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(folds) == 0).alias("held_out"), "text")
    return rows.mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, languages map<string,double>"
    )
