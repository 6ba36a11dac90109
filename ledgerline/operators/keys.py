"""Operators on keys: deduplication, upserts, anti joins, coalescing joins, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by arrival order.  Nulls are a key of their own."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def keep_first_by_url(df: DataFrame, url: str = "url", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The first row of each url; rows without url are all kept and not shuffled together."""
    has = df.filter(F.col(url).isNotNull())
    first = Window.partitionBy(url).orderBy(*order)
    kept = has.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return kept.unionByName(df.filter(F.col(url).isNull()))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Stored rows replaced or extended by the batch; of equal keys within the batch the last counts.

    An anti join and a union: the stored side is never ranked, only matched by key.
    """
    new = keep_last(batch, keys, [ordinal]).drop(ordinal)
    same = reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    old = stored.alias("s").join(new.select(*keys).alias("n"), same, "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def upsert_columns(stored: DataFrame, batch: DataFrame, key: str, changed: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Upsert in which only `changed` columns of an existing row take the batch's values."""
    new = keep_last(batch, [key], [ordinal]).drop(ordinal).withColumn("__new", F.lit(True))
    old = stored.withColumn("__old", F.lit(True)).alias("o")
    both = old.join(new.alias("n"), key, "full")
    pick = lambda c: F.when(
        F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in changed)), F.col(f"n.{c}")
    ).otherwise(F.col(f"o.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in stored.columns if c != key))


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in other's; rows with a null key stay."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def known_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids that are neither null nor blank."""
    return df.filter(F.length(F.trim(column)) > 0).select(column).distinct()


def coalescing_update(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Left rows with new values where the right side's last row of a key has them, the old ones elsewhere."""
    new = keep_last(right, keys, order).select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    have = set(left.columns)
    value = lambda c: F.coalesce(f"__{c}", c) if c in have else F.col(f"__{c}")
    out = left.join(new, keys, "left").withColumns({c: value(c) for c in columns})
    return out.drop(*(f"__{c}" for c in columns))


def merge_statements(frames: list[DataFrame], keys: list[str], order: str = "ordinal") -> DataFrame:
    """Full outer merge of statement sets, each with its last row of a key; nulls of a later row stay nulls."""
    sides = [keep_last(f, keys, [order]).drop(order) for f in frames]
    return reduce(lambda a, b: a.join(b, keys, "full"), sides)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def map_to_wide(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), *(F.col(column).getItem(n).alias(n) for n in names))


def wide_to_map(df: DataFrame, names: list[str], column: str) -> DataFrame:
    """Named columns as one map without its null entries."""
    entries = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))
    return df.select(*(c for c in df.columns if c not in names), F.map_filter(entries, lambda k, v: v.isNotNull()).alias(column))
