"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp01(x: Column) -> Column:
    return F.greatest(num(0), F.least(num(1), x))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-up rounding as floor(x * 10^d + 0.5) / 10^d, which other engines compute alike."""
    scale = float(10**digits)
    return F.floor(x * num(scale) + num(0.5)) / num(scale)


def two_decimals(x: Column) -> Column:
    """A non-negative number with two decimals, from whole hundredths."""
    hundredths = F.floor(x * num(100) + num(0.5)).cast("long")
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def percent_label(score: Column) -> Column:
    """A score as a percentage with one decimal; scores up to one are shares."""
    percent = F.when(score <= 1.0, score * num(100)).otherwise(score)
    tenths = F.floor(percent * num(10) + num(0.5)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def first_number(*columns: Column) -> Column:
    """The first value that reads as a number, else 0."""
    return F.coalesce(*[c.try_cast("double") for c in columns], num(0))


def compact(*items: Column) -> Column:
    """An array of the items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def ai_status(value: Column) -> Column:
    """selected, review or rejected; anything unknown needs review."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("selected", "select", "keep"), "selected").when(v.isin("rejected", "reject"), "rejected").otherwise("review")


def decision(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("post", "save", "delete", "undecided"), v).otherwise("undecided")


def split_reasons(value: Column) -> Column:
    """Trimmed non-blank parts of a text separated by semicolons; null gives none."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r".(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def user_path(value: Column) -> Column:
    """Trimmed, without one pair of matching quotes; blank is null.  A home sign is expanded by the driver."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(value), "^(['\"])(.*)\\1$", "$2")), F.lit(""))


def unsigned_hex(h: Column) -> Column:
    """Sixteen hex digits as the 64-bit number with that bit pattern."""
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))
