"""Scalar functions: hashes, vectors, sets, small numerics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """SCL-01: SHA-256 hex of the UTF-8 text."""
    return F.sha2(c, 256)


def fnv1a32(c: Column) -> Column:
    """SCL-03: 32-bit FNV-1a over code points, as an unsigned long."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, p: (h.bitwiseXOR(p) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), step)


# --- fixed values: seeds and multipliers of the 53-bit mixing hash ------------------------------------------
MIX_SEEDS, MIX_STEPS, MIX_ENDS = (0xDEADBEEF, 0x41C6CE57), (2654435761, 1597334677), (2246822507, 3266489909)
# ---------------------------------------------------------------------------------------------------------
_LOW32 = 0xFFFFFFFF


def _times32(a: Column, k: int) -> Column:
    """a * k modulo 2 ** 32, in two halves so that no product leaves a long."""
    long = lambda x: F.lit(x).cast("long")
    high = (a * long(k >> 16)).bitwiseAND(long(0xFFFF))
    return (a * long(k & 0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(long(_LOW32))


def mixing_hash(c: Column) -> Column:
    """SCL-02: 53-bit mixing hash of a text's UTF-16 units, in base 36."""
    point = lambda x: F.ascii(x).cast("long")
    pair = lambda p: F.when(p < 0x10000, F.array(p)).otherwise(
        F.array(F.lit(0xD800).cast("long") + F.shiftright(p - 0x10000, 10), F.lit(0xDC00).cast("long") + (p - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long"))))
    units = F.flatten(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: pair(point(x))))
    mix = lambda seed, k: F.aggregate(units, F.lit(seed).cast("long"), lambda h, u: _times32(h.bitwiseXOR(u), k))
    a, b = (mix(seed, k) for seed, k in zip(MIX_SEEDS, MIX_STEPS, strict=True))

    def end(x: Column, y: Column) -> Column:
        fold = lambda h, n, k: _times32(h.bitwiseXOR(F.shiftrightunsigned(h, n)), k)
        return fold(x, 16, MIX_ENDS[0]).bitwiseXOR(fold(y, 13, MIX_ENDS[1]))

    a = end(a, b)
    b = end(b, a)
    return F.lower(F.conv((F.shiftleft(b.bitwiseAND(F.lit(0x1FFFFF).cast("long")), 32) + a).cast("string"), 10, 36))


def json_text(c: Column, path: str) -> Column:
    """SCL-18: the text at a path of a JSON record, null where there is none."""
    return F.get_json_object(c, path)


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(
        F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """RET-16: over the shorter length; 0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    na, nb = norm(F.slice(a, F.lit(1), n)), norm(F.slice(b, F.lit(1), n))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def jaccard(a: Column, b: Column) -> Column:
    """SET-06: 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def rms(a: Column) -> Column:
    """SCL-05; 0 for an empty frame."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(a) > 0, F.sqrt(total / F.size(a))).otherwise(F.lit(0.0))


def percentile(value: str, p: float) -> Column:
    """AGG-01: nearest rank (the value at ceil(p n)) of an SQL expression, 0 for no values; an aggregate."""
    return F.coalesce(F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY {value})").cast("double"), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def day_key(ts: Column) -> Column:
    """SCL-13: calendar day of the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def line_of(text: Column, offset: Column) -> Column:
    """SCL-08: line number (from 1) of a character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a time with or without zone (the session's zone for one without)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
