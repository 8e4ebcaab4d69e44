"""Lines that can be said: markdown to plain text, prefaces and hedges cut, field lines, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselon.functions import text as tx

# --- fixed values ---------------------------------------------------------------------------------------
PREFACE = r"^(?:well,?\s+|so,?\s+|ok(?:ay)?,?\s+)?(?:based (?:up)?on|according to|as per|per|from|in|looking at|after reviewing)\s+(?:the\s+)?(?:provided\s+|given\s+|loaded\s+|attached\s+|retrieved\s+)?(?:repository|repo|codebase|code ?base|code|context|documentation|docs|evidence|material|excerpts?|snippets?|files?|chunks?)\b[^,.;:]*[,.;:]?\s*"
HEDGE = r"^(?:it\s+(?:appears|seems|looks like)(?:\s+that)?|the\s+(?:documentation|docs|repository|repo|code ?base|code|evidence|context|material)\s+(?:suggests?|shows?|indicates?|says?|states?)(?:\s+that)?|there\s+(?:appears|seems)\s+to\s+be|i\s+(?:think|believe)(?:\s+that)?|this\s+(?:suggests?|indicates?)(?:\s+that)?)\s*"
DESCRIBES = r"\b(this (?:api|service|app|application|module|package|library|system|server|worker|script|pipeline|repo|project|tool|endpoint|route|handler|function)|provides|handles|manages|exposes|implements|serves|extracts|generates|processes|converts|orchestrates|coordinates|allows|enables|returns|accepts|validates|uploads|downloads|responsible for|used (?:to|for)|is an?|acts as)\b"
# ---------------------------------------------------------------------------------------------------------


# --- fixed values: patterns of marked-down text, headings and field lines ------------------------------------
LINK, CODE_MARK, STARRED = r"\[([^\]]+)\]\([^)]*\)", r"`+([^`]+)`+", r"(\*{1,3})(?=\S)([^*]*\S)\1"
UNDERLINED = r"(?<![A-Za-z0-9_])(_{1,2})(?=\S)([^_]*\s[^_]*?\S)\1(?![A-Za-z0-9_])"
MARKED_HEADING, DOTS, RULE, CAPITALS, SENTENCE_END = r"^#{1,6}\s", r"\.{3}\z", r"^[-*=_]{3,}\z", r"^[A-Z0-9 _/-]+\z", r"[.!?]\z"
HEADING_WORDS, CAPITAL_WORDS = 6, 8
FIELD_CHARS, FIELD_WORDS = 120, 4
NAME_LIKE, CODE_SIGNS = r"^[A-Za-z0-9][A-Za-z0-9 .&'-]{1,60}\z", "[=;{}<>]"
LABELLED = r"(?i)^(phone|tel\.?|telephone|mobile|email|company)\s*:"
PHONE, ADDRESS = r"\+?\d[\d\s().-]{6,}\d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# ---------------------------------------------------------------------------------------------------------


def _count_words(c: Column) -> Column:
    return F.size(tx.nonempty(F.split(F.trim(c), r"\s+")))


def plain(c: Column) -> Column:
    """STR-21: links, code marks and emphasis taken off, names with underscores left whole."""
    bare = c
    for mark, kept in ((LINK, "$1"), (CODE_MARK, "$1"), (STARRED, "$2"), (UNDERLINED, "$2"), (r"\s+", " ")):
        bare = F.regexp_replace(bare, mark, kept)
    return F.trim(bare)


def is_heading(line: Column) -> Column:
    """STR-22: lines in capitals, short ones without an end, rules, trailing dots, marked headings."""
    n = _count_words(line)
    shouted = (n <= CAPITAL_WORDS) & line.rlike(CAPITALS)
    open_ended = (n <= HEADING_WORDS) & ~line.rlike(SENTENCE_END)
    return shouted | open_ended | line.rlike(f"{RULE}|{DOTS}|{MARKED_HEADING}")


def is_descriptive(line: Column) -> Column:
    """STR-22: whether a line says what something does."""
    return tx.matches(line, DESCRIBES, True)


def is_field_line(c: Column) -> Column:
    """STR-25: a labelled contact, a number, an address, or one to four words without a sentence's end."""
    t = F.trim(c)
    contact = t.rlike(ADDRESS) | t.rlike(PHONE) | t.rlike(LABELLED)
    name = (F.size(F.split(t, r"\s+")) <= FIELD_WORDS) & t.rlike("[A-Za-z]") & t.rlike(NAME_LIKE) & ~t.rlike("[.!?]")
    return F.length(t).between(1, FIELD_CHARS) & ~t.rlike(CODE_SIGNS) & (contact | name)


def sayable(c: Column, allow_field: bool = False) -> Column:
    """STR-24: prefaces and hedges cut in up to three passes; null unless three words and twelve characters stay."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    for _ in range(3):
        x = F.trim(F.regexp_replace(F.regexp_replace(x, "(?i)" + tx.edges(PREFACE), ""), "(?i)" + tx.edges(HEDGE), ""))
    x = F.trim(F.regexp_replace(x, r"^[,;:.\-–—]+\s*", ""))
    good = (F.length(x) >= 12) & x.rlike("[A-Za-z]") & (F.size(tx.nonempty(F.split(x, r"\s+"))) >= 3)
    if allow_field:
        good = good | (is_field_line(x) & (F.length(x) >= 4))
    return F.when(good, F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))


def declared_name(line: Column) -> Column:
    """STR-25: the name that a source line declares, else the one it assigns or calls, null for neither."""
    kw = F.regexp_extract(line, tx.edges(r"\b(?:function|const|let|var|class|def|interface|type|enum|struct|fn|trait|module|namespace)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)
    own = F.regexp_extract(line, r"^\s*(?:export\s+)?(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:async\s+)?([A-Za-z_][A-Za-z0-9_]{2,})\s*[=(]", 1)
    word = own.isin("if", "for", "while", "switch", "return", "import", "export", "await", "new")
    return F.when(kw != "", kw).when((own != "") & ~word, own)


def citation_text(kind: Column, path: Column, line: Column, end_line: Column, page: Column, heading: Column, sha: Column, pr: Column) -> Column:
    """STR-26: path:line-end, path and page, or commit and request."""
    span = F.when(end_line > line, F.concat_ws("-", line.cast("string"), end_line.cast("string"))).otherwise(line.cast("string"))
    return (
        F.when(kind == "commit", F.concat_ws(" · ", F.concat(F.lit("Commit "), F.substring(sha, 1, 7)), F.concat(F.lit("PR #"), pr)))
        .when(kind == "document", F.concat_ws(" · ", path, F.concat(F.lit("Page "), page.cast("string")), F.concat(F.lit('"'), heading, F.lit('"'))))
        .otherwise(F.concat_ws(":", path, span))
    )


def valid_email(c: Column) -> Column:
    """STR-29."""
    return F.trim(c).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z")


def identity_tokens(path: Column) -> Column:
    """STR-45: words of a file's name, the name itself and the name without hyphens."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+\z", ""))
    return F.array_distinct(F.concat(F.filter(F.split(stem, "[^a-z0-9]+"), lambda t: F.length(t) > 1), F.array(stem, F.replace(stem, F.lit("-"), F.lit("")))))


def list_phrase(words: Column) -> Column:
    """STR-23: a, b and c."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(words, -1)))
