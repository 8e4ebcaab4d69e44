"""Full check of a line against its evidence: clause by clause, for candidates that survived ranking.

A line fails for any of: negation, numeric, phrase_order. Each clause is anchored at the block of the evidence
that shares most of its words; what it denies, counts and orders must stand there.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------------------
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}
WEAK_ACTIONS = set("about after again before being could every never other should their there these those through under until which while would".split())
UNITS = re.compile(r"\b\d+(?:\.\d+)?\s*(?:ms|milliseconds?|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|kb|mb|gb|tb|percent|%|rps|qps)(?![a-z])", re.A)
VERSIONS = re.compile(r"\bv?\d+(?:\.\d+){1,3}\b", re.A)
OTHER_NEGATIONS = re.compile(r"\b(?:cannot|can't|won't|doesn't|don't|isn't|aren't|wasn't|weren't|nor|none|nothing)\b", re.A)
# ---------------------------------------------------------------------------------------------------------


def has_word(text: str, word: str) -> bool:
    return re.search(rf"\b{re.escape(word)}\b", text, re.A) is not None


def split_blocks(text: str) -> list[str]:
    """STR-41: sentences of the evidence, hard line breaks and comment marks undone, lower-cased."""
    lines = [re.sub(r"^\s*(?:[*/]+|//|#|-)\s+|/\*+|\*+/", "", x).strip() for x in text.split("\n")]
    out, open_ = [], False
    for line in filter(None, lines):
        if open_:
            out[-1] += " " + line
        else:
            out.append(line)
        open_ = not re.search(r"[.!?][\"']?$", line)
    return [b.lower() for x in out for b in re.split(r"(?<=[.!?])\s+", x) if b]


def split_clauses(line: str) -> list[str]:
    """STR-41: parts of a line between semicolons, sentence ends, commas, and an and before a new verb."""
    cut = r"\s*;\s*|(?<=[.!?])\s+|\s*,\s+|\s+and\s+(?=[a-z][a-z-]*\s+(?:are|is|was|were|has|have|require|run|process|support)\b)"
    return [p for x in re.split(cut, line.strip(), flags=re.I) if (p := x.strip())]


def numbers(text: str) -> set[str]:
    low = text.lower()
    return {*re.findall(r"\b\d+(?:\.\d+)?\b", low, re.A), *(d for w, d in NUMBER_WORDS.items() if has_word(low, w))}


def anchor(blocks: list[str], words: list[str]) -> str:
    """The block that holds most of the words; the first of equals."""
    return max(blocks, key=lambda b: sum(has_word(b, w) for w in words), default="")


def shares_action(a: str, b: str) -> bool:
    """Whether a longer word of one text begins in the other as well."""
    return any(w[:6] in b for w in re.findall(r"\b[a-z]{5,}\b", a.lower(), re.A) if w not in WEAK_ACTIONS)


def negation_fits(claim: str, block: str) -> bool:
    """STR-38: what is denied on one side is denied on the other."""
    c, b = claim.lower(), block.lower()
    deny = lambda t: {w for w in ("never", "not", "without") if has_word(t, w)}
    cd, bd = deny(c), deny(b)
    c_any, b_any = bool(cd or OTHER_NEGATIONS.search(c)), bool(bd or OTHER_NEGATIONS.search(b))
    if "never" in cd and "never" not in bd or "without" in cd and not bd:
        return False
    if "not" in cd and not b_any and shares_action(claim, b):
        return False
    return c_any or not b_any or not shares_action(claim, b)


def numbers_fit(claim: str, block: str, corpus: str) -> bool:
    """STR-39: numbers stand in the anchored block (in the corpus if it has none), units and versions in the corpus."""
    low, pool = corpus.lower(), numbers(block) or numbers(corpus)
    units = {re.sub(r"\s+", " ", u) for u in UNITS.findall(claim.lower())}
    return numbers(claim) <= pool and all(u in low for u in units) and set(VERSIONS.findall(claim.lower())) <= set(VERSIONS.findall(low))


def in_order(words: list[str], text: str) -> bool:
    """STR-40: whole words, one after the other."""
    at = 0
    for w in words:
        m = re.compile(rf"\b{re.escape(w)}\b", re.A).search(text, at)
        if not m:
            return False
        at = m.end()
    return True


def check(line: str, words: list[str], corpus: str) -> list[str]:
    """STR-42: reasons against a line; none if it holds. ``words`` are its content words that the corpus holds."""
    blocks, clauses, out = split_blocks(corpus), split_clauses(line), set()
    level = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    own = {c: [w for w in words if has_word(c.lower(), w)] for c in clauses}
    for c in clauses:
        block = anchor(blocks, own[c])
        out |= {"negation"} if not negation_fits(c, block) else set()
        out |= {"numeric"} if not numbers_fit(c, block, corpus) else set()
    if len(clauses) == 1 and not numbers(line):
        block = anchor(blocks, words)
        prose = len(block) >= 16 and re.search(r"[a-z]{3,}\s+[a-z]{3,}", block)
        if numbers(block) and prose and len([w for w in level(line).split() if len(w) >= 4]) >= 3 and shares_action(line, block):
            out.add("numeric")
    if not (len(level(line)) >= 12 and level(line) in level(corpus)):
        seen: set[str] = set()
        groups = [*own.values(), [w for w in words if not any(w in g for g in own.values())]]
        for g in groups:
            left = [w for w in g if w not in seen]
            seen.update(left)
            if left and not any(in_order(left, b) for b in blocks):
                out.add("phrase_order")
    return sorted(out)


def semantic_faults(line: Column, words: Column, corpus: Column) -> Column:
    """STR-42 for a table: array of reasons, empty for a line that holds; Arrow batches, rows independent."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(line: pd.Series, words: pd.Series, corpus: pd.Series) -> pd.Series:
        return pd.Series([check(a or "", list(w) if w is not None else [], c or "") for a, w, c in zip(line, words, corpus, strict=True)])

    return run(line, words, corpus)
