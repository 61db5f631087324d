"""Zero-filled, conditional and latest-of aggregates, and the joins that carry them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str, out: str = "n", blanks: bool = False) -> DataFrame:
    """Rows per key; blank and missing keys are left out unless ``blanks``."""
    if not blanks:
        df = df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return df.groupBy(key).agg(F.count("*").alias(out))


def completed(dimension: DataFrame, facts: DataFrame, on: Sequence[str], fills: Mapping[str, object]) -> DataFrame:
    """Every row of the dimension, with 0 (or the given fill) where the facts have none."""
    out = dimension.join(facts, list(on), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def total_and_sum(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Rows and the sum of an amount, 0 where all are missing."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))


def star_counts(rating: str, stars: Sequence[int] = (1, 2, 3, 4, 5)) -> list[Column]:
    return [F.count_if(F.col(rating) == s).alias(f"star_{s}") for s in stars]


def star_mean(rating: str) -> Column:
    """Sum of star times count over count, of valid stars only, not rounded."""
    valid = F.when(F.col(rating).between(1, 5), F.col(rating))
    return F.try_divide(F.sum(valid).cast("double"), F.count(valid).cast("double"))


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, *aggregates: Column, zero: Sequence[str] = ()) -> DataFrame:
    """Per-parent aggregates of child rows by one pre-aggregation and a left join; those in ``zero`` are 0 if absent."""
    facts = children.groupBy(F.col(child_key).alias("_key")).agg(*aggregates)
    out = parents.join(facts, F.col(parent_key) == F.col("_key"), "left").drop("_key")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def latest(df: DataFrame, keys: Sequence[str], order: str, *fields: str, where: Column | None = None) -> DataFrame:
    """The fields of each group's row with the greatest ``order``, by one partial aggregate instead of a sort."""
    if where is not None:
        df = df.where(where)
    return df.groupBy(*keys).agg(F.max_by(F.struct(order, *fields), order).alias("_last")).select(*keys, "_last.*")


def duplicate_groups(df: DataFrame, keys: Sequence[str], member: str, distinct: bool = False) -> DataFrame:
    """Keys with more than one row (or distinct member): the count, and the first and last member.

    Members aren't collected, so a group of any size is one row.
    """
    count = F.count_distinct(member) if distinct else F.count("*")
    return df.groupBy(*keys).agg(count.alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n > 1")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def newest_snapshot(df: DataFrame, year: str) -> DataFrame:
    """Rows of the greatest numeric year; text that isn't a number counts as year 0."""
    number = F.coalesce(F.col(year).try_cast("int"), F.lit(0))
    top = df.agg(F.max(number).alias("_top"))
    return df.join(F.broadcast(top), number == F.col("_top"), "left_semi")
