"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(x: Column) -> Column:
    """Lower case, white space collapsed (STR1)."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def slug(x: Column) -> Column:
    """Letters and digits, joined by underscores (STR10)."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def token(x: Column) -> Column:
    """Alphanumeric characters only (STR6)."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def collapse_repeats(x: Column) -> Column:
    """Each run of one letter becomes one letter (STR8)."""
    return F.regexp_replace(x, r"(.)\1+", "$1")


def is_junk(x: Column, letters: int = 24, distinct: int = 4) -> Column:
    """At least ``letters`` letters drawn from at most ``distinct`` ones (STR9)."""
    only = F.regexp_replace(F.lower(x), "[^a-z]", "")
    return (F.length(only) >= letters) & (F.size(F.array_distinct(F.split(only, ""))) - F.when(F.array_contains(F.split(only, ""), ""), 1).otherwise(0) <= distinct)


def file_stem(path: Column) -> Column:
    """File name without folder and extension, for both kinds of slashes (STR17)."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def expand_ranges(text: Column) -> Column:
    """The numbers of a list such as ``1,3-5`` (STR16); null if a part is no number or range, or not increasing."""
    parts = F.split(text, ",")
    ends = F.transform(parts, lambda p: F.split(F.trim(p), "-"))
    ok = F.forall(parts, lambda p: F.trim(p).rlike(r"^\d{1,6}(-\d{1,6})?$"))
    lo, hi = (lambda e: F.element_at(e, 1).cast("int")), (lambda e: F.element_at(e, -1).cast("int"))
    rising = F.forall(ends, lambda e: lo(e) <= hi(e))
    numbers = F.when(ok & rising, F.flatten(F.transform(ends, lambda e: F.sequence(lo(e), hi(e)))))
    return F.when(numbers == F.array_sort(F.array_distinct(numbers)), numbers)
