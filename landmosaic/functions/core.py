"""Emptiness, deterministic order, ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def is_empty(c: Column) -> Column:
    """Null, white space and the text "nan" all count as empty."""
    return c.isNull() | stripped(c).isin("", "nan")


def fill_if_empty(target: Column, source: Column) -> Column:
    """The source where the target is empty and the source isn't; "nan" in any case is no source."""
    given = stripped(source)
    return F.when(is_empty(target) & source.isNotNull() & ~F.lower(given).isin("", "nan"), given).otherwise(target)


def hash_order(seed: str, key: Column) -> Column:
    """The order that stands for a seeded shuffle: the same in any partitioning, and in other engines."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def any_of(text: Column, parts: list[str]) -> Column:
    return text.contains(parts[0]) if len(parts) == 1 else text.rlike("|".join(map(re.escape, parts)))


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """One flat CASE: the first condition that holds decides."""
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(default)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)
