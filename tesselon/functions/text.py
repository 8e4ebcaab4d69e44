"""Column functions over text: tokenizers, stems, question shape, captions, claims.

ASCII classes throughout: the engine's tokenizers split at anything outside a-z and 0-9, accented
letters included. Word edges are written as look-arounds on ASCII letters and digits, so that they
mean the same for every script and Java version.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these lists and patterns must stay as they are for equal results ---------------
QUERY_STOP = (
    "the a an that this does did do we you in of for to and or why what who how is it its our was were with from "
    "about please where when which can could should would will are am be been being has have had not but if then "
    "than also any all some more most much many very really actually just out up into over again still now here "
    "there these those they them their us me my your because while"
).split()
DIGIT_WORDS = {
    "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight",
    "9": "nine", "10": "ten",
}
SUFFIX_LONG = "(ational|ization|ations|ition|ment|ness)$"
SUFFIX_SHORT = "(ing|ed|es|s|al|ly)$"
CLAIM_STOP = (
    "a an and are as at be been by can for from in is it of on or our that the their them they this to we will with "
    "would should could"
).split()
NEGATIONS = ["not", "never", "no", "nor", "neither", "without", "cannot"]
ANTONYMS = [
    ("deprecate", "keep"), ("drop", "keep"), ("remove", "keep"), ("cancel", "keep"), ("ship", "delay"),
    ("ship", "postpone"), ("enable", "disable"), ("allow", "block"), ("allow", "deny"), ("increase", "decrease"),
    ("more", "less"), ("before", "after"), ("start", "stop"), ("accept", "reject"), ("yes", "no"),
]
SCHEDULE = (
    "ship shipping timeline deadline schedule date earliest latest friday monday tuesday wednesday thursday saturday "
    "sunday q1 q2 q3 q4 week month quarter"
).split()
# ---------------------------------------------------------------------------------------------------


_WORDY, _AFTER, _BEFORE = re.compile(r"[A-Za-z0-9_]|\\[wd]"), "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
_EDGE = f"(?:(?<=[A-Za-z0-9_]){_AFTER}|{_BEFORE}(?=[A-Za-z0-9_]))"
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?(?:[:=!]|<[=!])|.", re.S)


def edges(pattern: str) -> str:
    r"""``pattern`` with every \b as an ASCII word edge.

    Where a word character must follow, or must stand before, only the other side is looked at: the full test at every
    character of a text is most of what a pattern costs.
    """
    tokens = _TOKEN.findall(pattern)
    # the ends of every group, and the bars right inside it
    other, bars, stack = {}, {}, []
    for k, t in enumerate(tokens):
        if t.startswith("("):
            stack.append(k)
            bars[k] = []
        elif t == ")":
            other[k] = stack.pop()
            other[other[k]] = k
        elif t == "|" and stack:
            bars[stack[-1]].append(k)
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ""

    def opens(k: int) -> bool:
        if at(k) in ("(", "(?:"):
            return at(other[k] + 1) not in ("?", "*", "{") and all(opens(j + 1) for j in [k, *bars[k]])
        return bool(_WORDY.fullmatch(at(k))) and at(k + 1) not in ("?", "*", "{")

    def firsts(k: int) -> set[str]:
        """What can stand first in what opens with a word character, in both cases."""
        if at(k) in ("(", "(?:"):
            return set().union(*(firsts(j + 1) for j in [k, *bars[k]]))
        return {at(k)} if len(at(k)) > 1 else {at(k).lower(), at(k).upper()}

    def closes(k: int) -> bool:
        if at(k) in ("?", "*"):
            return closes(k - 1) and closes(other.get(k - 1, k - 1) - 1)
        if at(k) == ")":
            return at(other[k]) in ("(", "(?:") and all(closes(j - 1) for j in [k, *bars[other[k]]])
        return closes(k - 1) if at(k) == "+" else bool(_WORDY.fullmatch(at(k)))

    # a look at the next character is cheaper than one back, and rules out most places
    before = lambda k: f"(?=[{''.join(sorted(firsts(k)))}]){_BEFORE}"
    out = [(before(k + 1) if opens(k + 1) else _AFTER if closes(k - 1) else _EDGE) if t == r"\b" else t for k, t in enumerate(tokens)]
    return "".join(out).replace("$", r"\z")


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?i)" if ignore_case else "") + edges(pattern))


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def query_terms(q: Column) -> Column:
    """RET-01: lower-cased terms of more than one character, without stop words, each with its alias
    (digit or number word, hyphens joined) right after it; distinct, first place kept."""
    raw = F.split(F.regexp_replace(F.lower(q), "[^a-z0-9_./#-]+", " "), r"[ ]+")
    kept = F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(QUERY_STOP))
    pairs = DIGIT_WORDS | {w: d for d, w in DIGIT_WORDS.items()}
    alias = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    def spread(t: Column) -> Column:
        joined = F.replace(t, F.lit("-"), F.lit(""))
        return F.array_compact(
            F.array(t, F.try_element_at(alias, t), F.when(t.contains("-") & (F.length(joined) > 2), joined))
        )

    return F.array_distinct(F.flatten(F.transform(kept, spread)))


def camel_split(c: Column) -> Column:
    """Lower case, with a space between a small letter or digit and the capital after it."""
    return F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"))


def split_words(low: Column) -> Column:
    """Runs of a-z0-9, then whole snake_case words, of a text that :func:`camel_split` gave."""
    snake = F.when(low.contains("_"), F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9]+(?:_[a-z0-9]+)+)"), F.lit(1)), lambda w: F.length(w) > 2))
    return F.concat(nonempty(F.split(low, "[^a-z0-9]+")), F.coalesce(snake, F.array().cast("array<string>")))


def body_words(c: Column) -> Column:
    """RET-02: camel case split, lower-cased runs of a-z0-9, then whole snake_case words; repeats kept."""
    return split_words(camel_split(c))


def stem(w: Column) -> Column:
    """RET-03: two passes of suffixes; a stem of under three characters is undone, a final e goes."""
    cut = F.regexp_replace(F.regexp_replace(w, SUFFIX_LONG, ""), SUFFIX_SHORT, "")
    base = F.when(F.length(cut) >= 3, cut).otherwise(w)
    return F.when(base.endswith("e") & (F.length(base) > 3), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def saturate(tf: Column) -> Column:
    """RET-05: tf * 2.2 / (tf + 1.2), 0 up to 0."""
    return F.when(tf > 0, tf * 2.2 / (tf + 1.2)).otherwise(F.lit(0.0))


def named_paths(q: Column) -> Column:
    """RET-09: file names in a query, lower-cased."""
    return F.transform(F.regexp_extract_all(q, F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+)"), F.lit(1)), F.lower)


def vocabulary_words(c: Column) -> Column:
    """RET-30: words of a letter and two more letters or digits, camel case split."""
    low = F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.regexp_extract_all(low, F.lit("([a-z][a-z0-9]{2,})"), F.lit(1))


def fts_or_query(q: Column) -> Column:
    """RET-26: up to twelve distinct terms of over two characters, joined by ' | '."""
    terms = F.filter(F.split(F.regexp_replace(F.lower(q), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 2)
    return F.array_join(F.slice(F.array_distinct(terms), 1, 12), " | ")


# --- question shape (STR-13) -------------------------------------------------------------------------
# --- fixed values ---------------------------------------------------------------------------------------
_SHAPE_RULES = [
    ("who", [r"\bwho\s+(wrote|touched|owns?|added|changed|maintains?|maintained|created|authored|reviewed|approved)\b"]),
    ("who", [r"\bwho\b", r"\bown(?:s|er|ership)\b"]),
    ("what", [r"\b(who|whom|whose)\s+(is|are|was|were)\b"]),
    ("who", [r"\b(who|whom|whose)\b", r"\b(wrote|touched|owns?|added|changed|maintains?|maintained|created|authored|reviewed|approved|owner|ownership)\b"]),
    ("what", [r"\b(who|whom|whose)\b"]),
    ("absence", [
        r"\b(not|never|none|nothing|nowhere)\b|\bno\b|n['’]t\b",
        r"\b(right|correct|true|yeah|yes|no)\s*\?*\s*$|\b(is|are|isn['’]?t|aren['’]?t|do|don['’]?t|does|doesn['’]?t|have|haven['’]?t)\s+(it|we|they|you|there)\s*\?*\s*$|\bat all\b|\bany(thing|where|more)?\b",
    ]),
    ("absence", [
        r"\b(do|does|did|have|has) (we|you|they|i|it) (have|has|had|use|uses|support|supports|include|includes|contain|contains)\b|\b(is|are) there (a|an|any|some)\b|\bdo we (have|use)\b"
    ]),
    ("failure", [
        r"\bwhat happens (if|when)\b|\b(if|when) .*\b(fail|fails|failed|breaks|broken|errors?|times out|crashes)\b|\b(error|exception|failure|retry|retries|timeout|fallback|rollback) (handling|behaviour|behavior|path|logic)\b"
    ]),
    ("why", [r"^why\b|\bwhy (is|are|was|were|did|does|do|would|should|the|we|they)\b"]),
    ("where", [r"^where\b|\bwhere (is|are|does|do|did|in the)\b"]),
    ("how", [r"^how\b|\bhow (is|are|does|do|did|would|can)\b"]),
]
# ---------------------------------------------------------------------------------------------------------


def question_shape(q: Column) -> Column:
    """STR-13: what, how, where, why, failure, absence or who; the first rule that holds."""
    low = F.trim(F.lower(q))
    out = None
    for shape, patterns in _SHAPE_RULES:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & matches(low, p)
        out = F.when(hit, shape) if out is None else out.when(hit, shape)
    return out.otherwise("what")


# --- question class (STR-35) -------------------------------------------------------------------------
# --- fixed values ---------------------------------------------------------------------------------------
_ARCHITECTURE = r"architect|high[- ]level|system design|whole (app|application|system)|how (is|does) (this|the) (app|system|code|repo|application)|how is (this|it) (structured|built|organized)|overview of (the )?(app|system|codebase|application)"
_CLASS_RULES = [
    ("current_external_fact", r"\b(weather|stock price|capital of|who won|score of|temperature today|exchange rate)\b"),
    ("pricing_packaging", r"\b(price|pricing|plan|subscription|billing|invoice|seat|tier|cost)\b"),
    ("contractual_sla", r"\b(sla|uptime guarantee|contract|terms of service|liability|indemnif)\b"),
    ("security_compliance", r"\b(auth(entication)?|authorize|security|encrypt|gdpr|soc\s*2|hipaa|pci|secret|credential|session cookie|oauth)\b"),
    ("architecture", _ARCHITECTURE + r"|\b(architecture|system design|components|layout)\b"),
    ("product_capability", r"\b(what does|what is the purpose|what can|capabilities|responsible for)\b"),
]
# ---------------------------------------------------------------------------------------------------------


def is_architecture_query(q: Column) -> Column:
    """STR-06."""
    return matches(q, _ARCHITECTURE, True)


def question_class(q: Column, shape: Column | None = None) -> Column:
    """STR-35: the first of nine classes that holds. ``shape`` is :func:`question_shape` as a column of its own, if there is one."""
    low, shape = F.lower(F.trim(q)), question_shape(q) if shape is None else shape
    out = None
    for name, p in _CLASS_RULES:
        out = F.when(matches(low, p), name) if out is None else out.when(matches(low, p), name)
    # the shape counts only where no class before holds, and is looked at once
    by_shape = F.create_map(*[F.lit(x) for kv in (("where", "implementation"), ("how", "implementation"), ("why", "general_technical_reasoning"), ("failure", "general_technical_reasoning")) for x in kv])
    out = out.when(matches(low, r"\b(implement|function|class|module|file)\b"), "implementation")
    return out.otherwise(F.coalesce(F.try_element_at(by_shape, shape), F.lit("other")))


# --- claims (STR-33) ---------------------------------------------------------------------------------
def claim_normalize(c: Column) -> Column:
    """Lower-cased, contractions written out, anything but a-z, 0-9 and the full stop a space."""
    x = F.lower(c)
    for a, b in (("won't", "will not"), ("don't", "do not"), ("can't", "can not"), ("n't", " not")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9.\s]", " "), r"\s+", " "))


def claim_keywords(normal: Column) -> Column:
    """Distinct words of over two characters that are neither stop words nor negations."""
    return F.array_distinct(
        F.filter(F.split(normal, " "), lambda w: (F.length(w) > 2) & ~w.isin(CLAIM_STOP) & ~w.isin(NEGATIONS))
    )


def claim_negated(normal: Column) -> Column:
    return F.arrays_overlap(F.split(normal, " "), strings(NEGATIONS))


def claim_quantities(normal: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(edges(r"(\d+(?:\.\d+)?k?|\bq[1-4]\b)")), F.lit(1)))


def schedule_words(keywords: Column) -> Column:
    return F.filter(keywords, lambda w: w.isin(SCHEDULE) | w.rlike("^[0-9]") | w.rlike("^q[1-4]$"))


def says_opposite(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """True when two lines cannot both stand; each side has kw, neg, qty, time (columns of one row)."""
    overlap = F.size(F.array_intersect(a["kw"], b["kw"])) >= 1
    antonym = F.lit(False)
    for x, y in ANTONYMS:
        has = lambda s, w: F.array_contains(s["kw"], w)
        antonym = antonym | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    same = lambda s, t: (F.size(F.array_except(s, t)) == 0) & (F.size(F.array_except(t, s)) == 0)
    qty = (F.size(a["qty"]) > 0) & (F.size(b["qty"]) > 0) & ~same(a["qty"], b["qty"])
    topical = F.arrays_overlap(a["kw"], strings(SCHEDULE)) & F.arrays_overlap(b["kw"], strings(SCHEDULE))
    clash = topical & ~same(a["time"], b["time"])
    return (overlap & (antonym | (a["neg"] != b["neg"]) | qty)) | clash


# --- captions and chatter (STR-01, STR-02) -------------------------------------------------------------
# --- fixed values ---------------------------------------------------------------------------------------
_HALLUCINATION = r"^(thank you\.?|thanks for watching\.?|thanks\.?|you\.?|bye\.?|the end\.?|okay\.?|ok\.?|hmm\.?|uh\.?|um\.?|see\.?|hello\.?|hi\.?|hey\.?|we'll be right back\.?|please subscribe\.?)$"
# ---------------------------------------------------------------------------------------------------------


def clean_caption(c: Column) -> Column:
    """STR-01: sound events in brackets, arrows, speaker tags and leading punctuation removed; '' for stock phrases."""
    x = F.regexp_replace(c, r"[(\[][^)\]]{0,40}[)\]]", " ")
    x = F.regexp_replace(F.regexp_replace(x, ">>+", " "), "<<+", " ")
    x = F.regexp_replace(x, edges(r"(?i)\bThey:\s*"), "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[\s,.:;>\-–—]+", ""))
    return F.when(matches(x, _HALLUCINATION, True), F.lit("")).otherwise(x)


def sentences(c: Column) -> Column:
    """CHK-07: pieces that end in . ! or ? before white space, or at the end; trimmed, none empty."""
    return nonempty(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)))


def prompt_tokens(c: Column) -> Column:
    """STR-46: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def xml_text_runs(c: Column) -> Column:
    """SRC-17: text between tags, the five entities decoded, white space collapsed, none empty."""
    runs = F.regexp_extract_all(c, F.lit(">([^<>]+)<"), F.lit(1))

    def decode(r: Column) -> Column:
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            r = F.replace(r, F.lit(a), F.lit(b))
        return F.trim(F.regexp_replace(r, "[ \t\r\n]+", " "))

    return nonempty(F.transform(runs, decode))
