"""Counts, ratios and entropy of string columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(s: Column, piece: str) -> Column:
    """Non-overlapping hits of a fixed piece."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def has(s: Column, piece: str) -> Column:
    return flag(s.contains(piece))


def runs(s: Column) -> Column:
    """The characters of a text in order, equal ones joined: one piece for each distinct character, none for an empty text."""
    return F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))


def entropy(s: Column, of: Column | None = None) -> Column:
    """Shannon entropy in bits over a text's characters; 0 if empty. `of`: the text's runs, where they are at hand."""
    n = F.length(s)
    k = lambda run: F.length(run).cast("double")
    total = F.aggregate(runs(s) if of is None else of, F.lit(0.0), lambda t, run: t + k(run) * F.log2(k(run)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - total / n)


def distinct_grams(s: Column, width: int) -> Column:
    """Distinct n-grams over len - 1; 0 for a text shorter than the width."""
    n = F.length(s)
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))
    return F.when(n < width, F.lit(0.0)).otherwise(F.size(F.array_distinct(grams)) / (n - (width - 1)))


def tokens(s: Column, at: str) -> Column:
    return F.array_remove(F.split(s, at), "")


def fresh(df: DataFrame, prefix: str) -> str:
    """A prefix for working columns that no column of df begins with."""
    prefix = f"_{prefix}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
