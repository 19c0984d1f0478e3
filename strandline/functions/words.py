"""Words, readings and labels: canonical forms, dictionary lookups and families."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Digits that are read as words, one respelling, and the pattern of each word that may be drawn out.
NUMBER_WORDS = {"1": "one", "2": "two", "3": "three", "5": "five", "10": "ten"}
RESPELT = {"woah": "whoa"}
DRAWN_OUT = {
    "oh": "oh+", "ah": "ah+", "hey": "hey+", "yeah": "yeah+", "yes": "yes+", "wow": "wow+", "ew": "ew+", "no": "no+", "what": "wha+t+", "why": "why+", "who": "who+",
}
#: Marks that don't belong to a word at its edges.
EDGE_MARKS = ".,!?;:\"()[]'“”‘"
#: Words that tell the family of a label.
FAMILIES = {"person": ["person"], "creature": ["skeleton", "monster"], "vehicle": ["vehicle", "car", "truck", "bus"]}
#: Prefixes that don't change what a descriptor means, and its synonyms.
SHADES = ("dark-", "light-", "bright-", "pale-")
SYNONYMS = {"kitten": "cat", "puppy": "dog", "bunny": "rabbit", "human": "person"}


@F.pandas_udf(StringType())
def composed(x: pd.Series) -> pd.Series:
    """NFC, case folded, white space collapsed (STR1); null stays null. Python, as no built-in composes characters."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).casefold().split()))


@F.pandas_udf(StringType())
def plain(x: pd.Series) -> pd.Series:
    """Only a-z and 0-9 of the text without accents and width forms; a question mark stands for a lost d (STR2)."""

    def fold(s):
        if s is None:
            return None
        s = unicodedata.normalize("NFKD", s.casefold().replace("?", "d"))
        return "".join(c for c in s if c.isascii() and c.isalnum())

    return x.map(fold)


def mapped(x: Column, values: dict[str, str]) -> Column:
    """The value for ``x`` in a small fixed map, ``x`` itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x], x)


def spoken_token(x: Column) -> Column:
    """Canonical form of a heard word (STR3): plain quotes, no marks at the edges, digits as words, drawn-out words short."""
    marks = "".join("\\" + c for c in EDGE_MARKS)
    t = F.regexp_replace(F.regexp_replace(composed(x), "’", "'"), f"^[{marks}]+|[{marks}]+$", "")
    t = mapped(mapped(t, NUMBER_WORDS), RESPELT)
    return F.coalesce(*[F.when(t.rlike(f"^(?:{p})$"), F.lit(w)) for w, p in DRAWN_OUT.items()], t)


def phone_key(phones: Column) -> Column:
    """Phones without stress digits; an aspirated beginning HH W counts as W (STR4)."""
    bare = F.transform(phones, lambda p: F.regexp_replace(p, "[0-9]", ""))
    return F.when((bare[0] == "HH") & (F.get(bare, F.lit(1)) == "W"), F.slice(bare, 2, 1_000)).otherwise(bare)


def readings(variants: Column) -> Column:
    """Distinct keys of an array of readings, sorted (STR5)."""
    return F.array_sort(F.array_distinct(F.transform(variants, lambda v: F.array_join(phone_key(v), " "))))


def family(label: Column) -> Column:
    """Family of a label by its words (STR18): vehicle unless another kind is named, person or creature if only one is."""
    words = F.split(F.coalesce(label, F.lit("")), " ")
    has = {k: F.arrays_overlap(words, F.array(*[F.lit(x) for x in v])) for k, v in FAMILIES.items()}
    one = F.when(has["person"] & ~has["creature"], "person").when(has["creature"] & ~has["person"], "creature")
    return F.when(has["vehicle"] & ~has["person"] & ~has["creature"], "vehicle").otherwise(one)


def descriptor(x: Column) -> Column:
    """Slug with one spelling of gray, without shades, by its usual name (STR10)."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), "grey", "gray")
    for shade in SHADES:
        s = F.regexp_replace(s, f"^{shade}", "")
    return mapped(s, SYNONYMS)


def plain_guid(x: Column) -> Column:
    """Lower case without braces and dashes (STR21)."""
    return F.lower(F.regexp_replace(x, "[{}-]", ""))


def looked_up(df: DataFrame, names: DataFrame, *, by: str, aliases: dict[str, str], dims: list[str]) -> DataFrame:
    """Adds ``dims`` of the table of names (``name`` and the dims): an alias counts first (STR11); what isn't listed gets nulls.

    The table of names is a dimension; Spark broadcasts it where its size allows and else joins by shuffle.
    """
    key = mapped(F.col(by), aliases)
    return df.withColumn("__name", key).join(names.select(F.col("name").alias("__name"), *dims), "__name", "left").drop("__name")
