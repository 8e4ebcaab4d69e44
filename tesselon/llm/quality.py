"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (standardised character
and word statistics, then a hidden layer); gated attention, learned from document labels alone, weighs
the encoded passages, and the weighted sum is scored. A text of any length is read whole, in pieces
of at most ``PIECE`` bytes whose attention sums add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.labelled import fold, labelled_sample

#: Bound of the training sample.
SAMPLE_ROWS = 5000
PASSAGE = 64
PIECE = 1 << 20
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b"|", b"#$%&*@^~", b".,;:", b"!?", b"\"'()-/<=>[\\]_`{}+"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = len(_CLASSES) + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
N_FEATURES = len(_CLASSES) + 1 + 7
_PRIME = np.uint64(0x100000001B3)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_UP = _powers(2 * PIECE + 64, _PRIME)
_DOWN = _powers(2 * PIECE + 64, np.uint64(pow(int(_PRIME), -1, 1 << 64)))


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(document numbers, byte strings) of up to 2 PIECE bytes a turn; a long text is cut at white space if it has any."""
    nos, held, size = [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        while True:
            cut = len(b)
            if cut > PIECE:
                cut = 1 + max(b.rfind(b" ", PIECE // 2, PIECE), b.rfind(b"\n", PIECE // 2, PIECE)) or PIECE
            nos.append(i)
            held.append(b[:cut])
            size += cut + 1
            b = b[cut:]
            if size > PIECE:
                yield nos, held
                nos, held, size = [], [], 0
            if not b:
                break
    if held:
        yield nos, held


def features(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the byte string, features) of every passage; a string without words is one passage of zeros."""
    raw = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in held])
    space = _SPACE[raw]
    before = np.r_[True, space[:-1]]
    w0 = np.flatnonzero(~space & before)
    w1 = np.flatnonzero(space & ~before)
    doc = np.searchsorted(starts, w0, "right") - 1
    number = np.arange(len(w0)) - np.searchsorted(doc, doc)
    begins = np.flatnonzero(number % PASSAGE == 0)
    p_doc, n_words = doc[begins], np.diff(np.r_[begins, len(w0)])
    p = len(begins)
    blank = np.setdiff1d(np.arange(len(held)), p_doc)
    if not p:
        return blank, np.zeros((len(blank), N_FEATURES))
    of_word = np.repeat(np.arange(p), n_words)
    # a passage's bytes reach from its first word to the next passage or the text's end
    end = np.r_[w0[begins[1:]], len(raw)]
    end = np.minimum(end, starts[p_doc + 1] - 1)
    length = end - w0[begins]
    span = np.repeat(w0[begins] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    c = len(_CLASSES) + 2
    kinds = np.bincount(np.repeat(np.arange(p), length) * c + _CLASS[raw[span]], minlength=p * c).reshape(p, c)[:, 1:]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(raw.astype(np.uint64) * _UP[: len(raw)], dtype=np.uint64)]
        h = (sums[w1] - sums[w0]) * _DOWN[w0]
    size = w1 - w0
    same1 = np.r_[False, (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])]
    same2 = np.r_[False, False, (h[2:] == h[:-2]) & (of_word[2:] == of_word[:-2])][: len(h)]
    order = np.lexsort((h, of_word))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    mean = lambda x: np.bincount(of_word, x, minlength=p) / n_words
    upper = _CLASS[raw[w0]] == 1
    f = np.c_[
        kinds / np.maximum(length, 1)[:, None], np.log1p(mean(size)), np.log1p(n_words), mean(same1), mean(same2),
        np.bincount(of_word[order], fresh, minlength=p) / n_words, mean(size <= 3), mean(upper),
    ]
    return np.r_[p_doc, blank], np.r_[f, np.zeros((len(blank), N_FEATURES))]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden passages and their attention logits."""
        h = np.tanh(((x - self.mean) / self.scale) @ self.p["W"] + self.p["b"])
        return h, (np.tanh(h @ self.p["V"]) / (1 + np.exp(-h @ self.p["U"]))) @ self.p["w"]

    def score(self, texts: list[str | None]) -> np.ndarray:
        num, den = np.zeros((len(texts), len(self.p["c"]))), np.zeros(len(texts))
        for nos, held in pieces(texts):
            piece, x = features(held)
            doc = np.array(nos)[piece]
            h, e = self.encode(x)
            a = np.exp(e)  # bounded: the gate lies in (-1, 1)
            np.add.at(den, doc, a)
            np.add.at(num, doc, a[:, None] * h)
        return 1 / (1 + np.exp(-((num / den[:, None]) @ self.p["c"] + self.p["d"])))


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, rounds: int = 250, seed: int = 3) -> Model:
    """Adam on the whole sample; without rows the model scores 0.5."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    p = {
        "W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "w": rng.normal(0, 0.1, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    }
    model = Model(mean, scale, p)
    if not len(bags):
        p["c"][:] = 0
        return model
    x = (x - mean) / scale
    sizes = np.array([len(b) for b in bags])
    at, doc = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(bags)), sizes)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        a = np.exp((tv * su) @ p["w"])
        a /= np.add.reduceat(a, at)[doc]
        z = np.add.reduceat(a[:, None] * h, at)
        q = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        ds = (q - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[doc] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, at)[doc])
        gated = de[:, None] * p["w"]
        dtv, dsu = gated * su * (1 - tv**2), gated * tv * su * (1 - su)
        dh = (a[:, None] * dz[doc] + dtv @ p["V"].T + dsu @ p["U"].T) * (1 - h**2)
        g = {
            "W": x.T @ dh + 1e-4 * p["W"], "b": dh.sum(0), "V": h.T @ dtv, "U": h.T @ dsu, "w": (tv * su).T @ de,
            "c": z.T @ ds + 1e-4 * p["c"], "d": ds.sum(keepdims=True),
        }
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents, whole texts, remainder 0 of ``folds`` left out.

    The passages are encoded on the executors; the driver gets their statistics, not the texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(len(b))]
            for nos, held in pieces(list(b["text"])):
                piece, x = features(held)
                doc = np.array(nos)[piece]
                for i in np.unique(doc):
                    parts[i].append(x[doc == i])
            rows = [np.concatenate(x).astype(np.float32).tobytes() for x in parts]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": rows})

    sample = labelled_sample(docs, labels, "quality", max_rows, folds).selectExpr("cast(doc_id as long) doc_id", "text", "y")
    got = sorted(sample.mapInPandas(run, "doc_id long, y int, x binary").collect(), key=lambda r: r["doc_id"])
    bags = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES).astype(float) for r in got]
    return fit(bags, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; predicted is 1 if score >= threshold.

    Only the text is an input. Null and empty texts are one passage of zeros. Rows are scored one by one:
    repeated rows, null ids and other columns need no care.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(list(b["text"])) if len(b) else np.zeros(0)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(folds) == 0).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
