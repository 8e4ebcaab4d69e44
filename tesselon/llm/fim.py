"""Fill-in-middle transformation by escaped marker injection; DataFrame functions only.

A text is cut into units by a pattern. So that units can be counted and picked by rank without an array of them, a
delimiter is escaped in the text, then appended to every unit by ``regexp_replace``; its count is the number of units,
``substring_index`` extracts the parts before, between and behind two ranks, and each part has its delimiters taken
out and its escapes undone. Where the cuts fall, and which form a row takes, follows from a SHA-256 of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The unit: a line with its break, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, and the character that begins an escape: both may occur in texts.
_CUT, _ESC = "\x01", "\x02"


def escape(c: Column) -> Column:
    """``c`` without the delimiter: both characters become the escape character and a letter."""
    return F.replace(F.replace(c, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_CUT), F.lit(_ESC + "c"))


def unescape(c: Column) -> Column:
    # in this order: after the first step every escape character left stands before an e
    return F.replace(F.replace(c, F.lit(_ESC + "c"), F.lit(_CUT)), F.lit(_ESC + "e"), F.lit(_ESC))


def _first(c: Column | str, n: Column, mark: str = _CUT) -> Column:
    """What stands before the n-th mark, or behind the n-th from the end if n is negative; nothing for 0."""
    return F.call_function("substring_index", F.col(c) if isinstance(c, str) else c, F.lit(mark), n)


def _plain(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(_CUT), F.lit("")))


def _group(h: Column, no: int) -> Column:
    """The no-th group of 8 hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(h, 8 * no + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, pattern: str = LINES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    n is the number of units. form is ``plain`` (the text as it is), ``psm`` (<P>prefix<S>suffix<M>middle) or
    ``spm`` (<S>suffix<P>prefix<M>middle); the part lengths are code points, null if plain. ``pattern`` must cover
    the whole text, left to right. A long text is one pass of each function, linear in its length.

    Edge cases: a null text counts as empty; an empty text, one that contains a marker, and those that the hash
    leaves out (``fim_percent``) stay plain; parts may be empty; a null id hashes as the empty text; repeated rows
    and rows that share an id are rows of their own (one id cuts at ranks of its own number of units); the delimiter and the
    escape character may stand in the text; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = F.regexp_replace(escape(F.col("text")), f"({pattern})", f"$1{_CUT}")
    rows = rows.withColumns({"h": h, "marked": marked})
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(_CUT), F.lit("")))).cast("long"))
    a, b = _group(F.col("h"), 0) % (F.col("n") + 1), _group(F.col("h"), 1) % (F.col("n") + 1)
    holds_marker = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | holds_marker | (_group(F.col("h"), 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_group(F.col("h"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"lo": F.least(a, b).cast("int"), "hi": F.greatest(a, b).cast("int"), "form": form})
    parts = {
        "prefix": _plain(_first("marked", F.col("lo"))),
        "middle": _plain(F.when(F.col("hi") > F.col("lo"), _first(_first("marked", F.col("hi")), F.col("lo") - F.col("hi"))).otherwise("")),
        # the delimiter behind the last unit makes one more part, an empty one
        "suffix": _plain(_first("marked", (F.col("hi") - F.col("n") - 1).cast("int"))),
    }
    rows = rows.select("doc_id", "n", "form", F.when(~plain, F.struct(*[c.alias(k) for k, c in parts.items()])).alias("cut"), "text")
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm = F.concat(p, F.col("cut.prefix"), s, F.col("cut.suffix"), m, F.col("cut.middle"))
    spm = F.concat(s, F.col("cut.suffix"), p, F.col("cut.prefix"), m, F.col("cut.middle"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(
        "doc_id", "n", "form", F.length("cut.prefix").cast("long").alias("prefix_chars"),
        F.length("cut.middle").cast("long").alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` turned into ``output``; the parts hold no marker, so the markers found are its own."""
    middle = _first(output, F.lit(-1), MIDDLE)
    ends = F.length(F.lit(PREFIX)) + 1
    # psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle
    front = _first(output, F.lit(1), MIDDLE)
    psm = F.concat(F.substr(_first(front, F.lit(1), SUFFIX), ends), middle, _first(front, F.lit(-1), SUFFIX))
    spm = F.concat(_first(front, F.lit(-1), PREFIX), middle, F.substr(_first(front, F.lit(1), PREFIX), ends))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
