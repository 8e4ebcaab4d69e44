"""Spoken questions made canonical, and pointers resolved against the topic before them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.operators.answers import NOT_A_SUBJECT, OPENERS

# --- fixed values ---------------------------------------------------------------------------------------
REPAIR = re.compile(r"[\s,—–-]*\b(?:actually,?\s+i\s+mean|i\s+mean|i\s+meant|sorry|or\s+rather|rather|scratch\s+that)\b[,:;]?\s*", re.I)
HEAD = re.compile(r"\s*((?:where|what|which|who|whose|when|why|how)(?:'s|'re|s)?|does|do|did|is|are|was|were|can|could|should|would|will|has|have)\b", re.I)
HEDGES = {
    "actually": "do|does|did|is|are|was|were|am|be|been|being|we|you|they|it|i", "really": "do|does|did|is|are|was|were|am|not|we|you|they|it|i",
    "even": "do|does|did|is|are|was|were|have|has|had|we|you|they|it|i", "just": "is|are|was|were|am|be|been|being|we|you|they|it|i",
    "basically": "what|how|why|where|it|we|they", "literally": "is|are|was|were|we|you|they|it",
}
VERBS = "do|does|did|doing|happen|happens|happened|work|works|working|get|gets|use|uses|using|used|call|calls|run|runs|handle|handles|write|writes|read|reads|store|stores|retry|retries|fail|fails|live|lives|go|goes|need|needs|talk|talks|know"
VAGUE = re.compile(r"\b(?:around|about)\s+(?=(?:this|that|it|these|those)\b\s*[?.!]*$)", re.I)
KINDS = "service|worker|job|module|file|function|endpoint|route|handler|component|queue|table|flow|process|feature|topic|part|thing|system|document|contract"
TOPIC_KINDS = {"flow", "process", "feature", "topic", "part", "thing"}
_LEAD = re.compile(rf"\s*(?:{'|'.join(sorted(OPENERS, key=len, reverse=True))})\b[\s,;:—–-]*", re.I)
_KIND = re.compile(rf"\b(?:this|that|the same|these|those)\s+({KINDS})s?\b", re.I)
_CONTINUE = re.compile(r"^\s*(?:and\s+)?(?:then\s+what|what\s+(?:happens|comes|is)\s+(?:next|(after|before)(?:\s+(?:that|this|it))?))\W*$", re.I)
_TERSE = re.compile(r"^(?:why(?:\s+not)?|how(?:\s+(?:so|come))?|since\s+when)\W*$", re.I)
_PRONOUN = re.compile(r"\b(?:it|this|that|they|them|these|those)\b", re.I)
# ---------------------------------------------------------------------------------------------------------


def _body(text: str) -> bool:
    return re.search(r"[a-z0-9]", text, re.I) is not None


def _tidy(text: str) -> str:
    return re.sub(r"^[\s,;:—–-]+", "", re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:!?])", r"\1", text))).strip()


def normalize(raw: str) -> str:
    """STR-11: openers (six at most), self-repairs (three at most), hedges and a vague preposition taken out, each only
    while something with meaning stays."""
    text = (raw or "").strip()
    for _ in range(6):
        m = _LEAD.match(text)
        if not m or not _body(text[m.end() :]):
            break
        text = text[m.end() :]
    for _ in range(3):
        m = REPAIR.search(text)
        if not m or not m.start() or not _body(text[m.end() :]):
            break
        left, right = text[: m.start()], text[m.end() :]
        head = HEAD.match(left)
        text = right if HEAD.match(right) or not head else f"{head[1]} {right}"
    for hedge, before in HEDGES.items():
        less = re.sub(rf"((?:\b(?:{before})|n't)\s+){hedge}\b|\b{hedge}\s+(?=(?:{VERBS})\b)", lambda m: m[1] or "", text, flags=re.I)
        text = less if _body(less) else text
    less = VAGUE.sub("", text)
    out = _tidy(less if _body(less) else text)
    return out if _body(out) else (raw or "").strip()


def reference(canonical: str) -> tuple[str, str, str] | None:
    """STR-15: (kind, phrase, detail) of the pointer in a question: continuation, entity, terse or pronoun."""
    if m := _CONTINUE.match(canonical):
        return "continuation", m[0].strip(), (m[1] or "after").lower()
    if m := _KIND.search(canonical):
        return "entity", m[0], m[1].lower()
    if _TERSE.match(canonical):
        return "terse", re.sub(r"[?.!,\s]+$", "", canonical), ""
    m = _PRONOUN.search(canonical)
    return ("pronoun", m[0], "") if m else None


def stands_alone(canonical: str) -> bool:
    """Whether a question names its own subject: a content word that is neither a kind of thing nor a verb."""
    words = [w for w in re.split("[^a-z0-9]+", canonical.lower()) if len(w) > 2 and w not in NOT_A_SUBJECT]
    return any(not re.fullmatch(rf"(?:{KINDS})s?|\w+(?:ed|ing)|(?:{VERBS})", w) for w in words)


def resolve(canonical: str, subject: list[str], entities: list[str]) -> str | None:
    """STR-15: the question with its pointer replaced by what the topic established; None where that is nothing or several things."""
    found = reference(canonical)
    if found is None or (found[0] != "terse" and found[0] != "continuation" and stands_alone(canonical)):
        return canonical
    kind, phrase, detail = found
    topic = " ".join(subject)
    if kind == "continuation":
        return f"what happens {detail} {topic}" if topic else None
    if kind == "entity":
        named = sorted({e for e in entities if detail in e})
        if len(named) == 1:
            return canonical.replace(phrase, named[0])
        return canonical.replace(phrase, topic) if not named and detail in TOPIC_KINDS and topic else None
    one = " ".join(dict.fromkeys([*(entities if len(set(entities)) == 1 else []), *subject]))
    if not one:
        return None
    return f"{phrase} {one}" if kind == "terse" else canonical.replace(phrase, one, 1)


def normalize_spoken(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(q: pd.Series) -> pd.Series:
        return q.map(lambda x: None if x is None else normalize(x))

    return run(c)


def resolve_spoken(c: Column, subject: Column, entities: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(q: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        many = lambda x: [] if x is None else list(x)
        return pd.Series([None if a is None else resolve(a, many(b), many(d)) for a, b, d in zip(q, s, e, strict=True)])

    return run(c, subject, entities)


def is_replay(line: Column, before: Column) -> Column:
    """STR-16: the same line once case and punctuation are level."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.coalesce(flat(line) == flat(before), F.lit(False))
