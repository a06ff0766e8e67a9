"""Bounds, ordering, paging and row filters over per-entity tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def has_value(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def within(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within all bounds, both ends included. A row without a value fails a bound that sets a side; an open one filters nothing.

    Raises ValueError for an unknown column or a minimum above its maximum.
    """
    for c, (low, high) in bounds.items():
        if c not in df.columns:
            raise ValueError(f"no column {c}")
        if low is not None and high is not None and low > high:
            raise ValueError(f"{c}: the minimum is above the maximum")
        if low is not None or high is not None:
            df = df.where(has_value(c))
        if low is not None:
            df = df.where(F.col(c) >= low)
        if high is not None:
            df = df.where(F.col(c) <= high)
    return df


def value_order(c: str, key: str, descending: bool = False) -> list[Column]:
    """Rows without a value are last in both directions; ties by ascending key."""
    return [has_value(c).desc(), F.col(c).desc() if descending else F.col(c).asc(), F.col(key).asc()]


def page(df: DataFrame, c: str, key: str, descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*value_order(c, key, descending)).offset(offset).limit(limit)


def seen_in(entities: DataFrame, observations: DataFrame, key: str, context: str, value) -> DataFrame:
    """The entities that the context observes."""
    return entities.join(observations.where(F.col(context) == value).select(key), key, "left_semi")


def longer_than(observations: DataFrame, key: str, n: int) -> DataFrame:
    """The observations of entities with more than n of them; one shuffle."""
    return observations.join(observations.groupBy(key).count().where(F.col("count") > n).select(key), key, "left_semi")


def at_most(observations: DataFrame, key: str, size: str, most: float) -> DataFrame:
    """Entities whose largest size is most or less; a missing size counts as 0."""
    return observations.groupBy(key).agg(F.max(F.coalesce(size, F.lit(0.0))).alias("max_size")).where(F.col("max_size") <= most)


def renumbered(df: DataFrame, key: str, out: str = "new_index", block: int = 1 << 16) -> DataFrame:
    """Dense numbers from 0 in the order of an integer key, which must be unique.

    Rows are numbered within blocks of the key's range, and blocks by a running count; only the block counts, one row
    for up to `block` keys, are in one place.
    """
    at = F.floor(F.col(key) / block).alias("__block")
    counts = df.groupBy(at).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = df.withColumn("__block", at).withColumn("__nth", F.row_number().over(Window.partitionBy("__block").orderBy(key)))
    return numbered.join(counts.select("__block", before.alias("__before")), "__block").withColumn(out, F.col("__before") + F.col("__nth") - 1).drop("__block", "__nth", "__before")


def number_in_name(name: str) -> Column:
    """The number at the end of a name's stem, bare or in round brackets; null if there is none."""
    stem = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")
    found = F.regexp_extract(stem, r"(\d+)\)?$", 1)
    return F.when(stem.rlike(r"(\(\d+\)|\d)$"), found.cast("long"))


def ranges(text: str) -> list[tuple[int, int, int]]:
    """Parts (first, last, step) of an expression such as 1-10,20,30-40:5; both ends belong."""
    out = []
    for part in text.split(","):
        if not (m := re.fullmatch(r"\s*(\d+)(?:-(\d+)(?::(\d+))?)?\s*", part)):
            raise ValueError(f"not a range: {part!r}")
        a, b, step = int(m[1]), int(m[2] or m[1]), int(m[3] or 1)
        if b < a or step < 1:
            raise ValueError(f"not a range: {part!r}")
        out.append((a, b, step))
    return out


def in_ranges(number: Column, text: str) -> Column:
    hit = F.lit(False)
    for a, b, step in ranges(text):
        hit = hit | (number.between(a, b) & ((number - a) % step == 0))
    return hit


def include_range(df: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose name has a number of the ranges."""
    n = number_in_name(name)
    return df.where(n.isNotNull() & in_ranges(n, text))


def exclude_range(df: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose name has no number of the ranges; those without a number stay."""
    n = number_in_name(name)
    return df.where(n.isNull() | ~in_ranges(n, text))


def glob(text: str) -> str:
    """A file pattern (* ? [..] [!..]) as a regular expression for the whole name."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def matching(df: DataFrame, name: str, pattern: str, keep: bool = True) -> DataFrame:
    hit = F.col(name).rlike(glob(pattern))
    return df.where(hit if keep else ~hit)
