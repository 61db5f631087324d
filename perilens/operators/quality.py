"""Data-quality rules: each gives rows (issue_type, severity, entity_id, district, raw_value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilens.functions.scalars import coordinates_valid, rating_valid

#: Severities from the gravest on.
SEVERITIES = ("CRITICAL", "HIGH", "WARNING", "INFO")


def issues(df: DataFrame, bad: Column, kind: str | Column, severity: str, entity: str, district: str | None, raw: Column) -> DataFrame:
    name = F.lit(kind) if isinstance(kind, str) else kind
    where = F.lit(None).cast("string") if district is None else F.col(district)
    return df.where(F.coalesce(bad, F.lit(False))).select(
        name.alias("issue_type"), F.lit(severity).alias("severity"), F.col(entity).cast("string").alias("entity_id"), where.alias("district"), raw.cast("string").alias("raw_value")
    )


def contamination(df: DataFrame, public: str, own_class: str, entity: str, district: str) -> DataFrame:
    """Marked public but classified as private, quasi-public or non-profit."""
    bad = F.col(public) & F.col(own_class).isin("PRIVATE", "QUASI_PUBLIC", "NONPROFIT")
    return issues(df, bad, F.concat(F.col(own_class), F.lit("_CONTAMINATION")), "CRITICAL", entity, district, F.col(own_class))


def missing(df: DataFrame, column: str, kind: str, severity: str, entity: str, district: str | None) -> DataFrame:
    return issues(df, F.coalesce(F.trim(F.col(column)), F.lit("")) == "", kind, severity, entity, district, F.col(column))


def invalid_district(df: DataFrame, column: str, listed: Sequence[str], entity: str) -> DataFrame:
    d = F.col(column)
    return issues(df, (F.trim(d) != "") & ~d.isin(*listed), "INVALID_DISTRICT", "HIGH", entity, column, d)


def invalid_coordinates(df: DataFrame, lat: str, lng: str, entity: str, district: str | None, box: tuple = (21.0, 26.0, 119.0, 123.0)) -> DataFrame:
    raw = F.concat_ws(",", F.col(lat).cast("string"), F.col(lng).cast("string"))
    return issues(df, ~coordinates_valid(lat, lng, box), "INVALID_COORDINATE", "WARNING", entity, district, raw)


def district_mismatch(df: DataFrame, district: str, address: str, status: str, entity: str) -> DataFrame:
    d, a = F.coalesce(district, F.lit("")), F.coalesce(address, F.lit(""))
    bad = (d != "") & (a != "") & ~a.contains(d) & ~F.col(status).isin("REJECTED", "PENDING")
    return issues(df, bad, "DISTRICT_MISMATCH", "WARNING", entity, district, F.col(address))


def duplicates(df: DataFrame, keys: Sequence[str], kind: str, severity: str, entity: str, distinct: bool = False) -> DataFrame:
    """One issue per repeated key: the first entity, and the count as raw value."""
    n = F.count_distinct(entity) if distinct else F.count("*")
    found = df.groupBy(*keys).agg(n.alias("_n"), F.min(entity).alias("_first")).where("_n > 1")
    return issues(found, F.lit(True), kind, severity, "_first", None, F.col("_n"))


def invalid_rating(df: DataFrame, rating: str, entity: str, district: str | None = None) -> DataFrame:
    return issues(df, ~rating_valid(rating), "INVALID_RATING", "HIGH", entity, district, F.col(rating))


def missing_match(entities: DataFrame, matches: DataFrame, key: str, entity: str, district: str) -> DataFrame:
    lacking = entities.join(matches.select(F.col(key).alias(entity)), entity, "left_anti")
    return issues(lacking, F.lit(True), "MISSING_PLACE", "INFO", entity, district, F.lit(None))


def together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def gate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: total, a count per check, and whether any check found something."""
    out = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    return out.withColumn("failed", reduce(lambda a, b: a | b, [F.col(k) > 0 for k in checks]))


def identities(df: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """One row per accounting identity: sum of the left columns (missing as 0), right column, and whether they agree."""
    parts = F.array(
        *[F.struct(F.lit(k).alias("rule"), sum((F.coalesce(F.col(c), F.lit(0.0)) for c in left), F.lit(0.0)).alias("left_side"), F.col(right).cast("double").alias("right_side")) for k, (left, right) in rules.items()]
    )
    out = df.select(*keys, F.explode(parts).alias("_r")).select(*keys, "_r.*")
    return out.withColumn("result", F.when(F.coalesce(F.abs(F.col("left_side") - F.col("right_side")) < 0.005, F.lit(False)), "pass").otherwise("differs"))


def statement_checks(df: DataFrame, keys: Sequence[str], name: str, amount: str, order: str, income: str = "income", expense: str = "expense", surplus: str = "surplus") -> DataFrame:
    """Per statement: do all amounts parse, is there a surplus line, and is income - expense the surplus.

    First hits by order count; a missing income or expense is 0, a missing surplus agrees with nothing, a missing line checks nothing.
    """
    first = lambda word: F.min_by(F.when(F.col(name).contains(word), F.col(amount)), F.when(F.col(name).contains(word), F.col(order)))
    out = df.groupBy(*keys).agg(
        (F.count(amount) == F.count("*")).alias("all_parse"), (F.count_if(F.col(name).contains(surplus)) > 0).alias("has_surplus"), first(income).alias("_i"), first(expense).alias("_e"), first(surplus).alias("_s"),
        *[(F.count_if(F.col(name).contains(word)) > 0).alias(f"_has_{word}") for word in (income, expense, surplus)],
    )
    zero = F.lit(0.0)
    agree = F.coalesce(F.abs(F.coalesce("_i", zero) - F.coalesce("_e", zero) - F.col("_s")) < 0.005, F.lit(False))
    balanced = F.when(F.col(f"_has_{income}") & F.col(f"_has_{expense}") & F.col(f"_has_{surplus}"), agree)
    return out.select(*keys, "all_parse", "has_surplus", balanced.alias("balanced"))


def valid_record(public_type: Column, in_city: Column, address: Column, public: Sequence[str] = ("PUBLIC", "PUBLIC_ATTACHED")) -> Column:
    """Reason of the first failure (type, city, address), missing for a valid record."""
    kind = F.coalesce(public_type, F.lit("UNKNOWN"))
    return F.coalesce(
        F.when(~kind.isin(*public), F.concat(F.lit("not_public:"), F.lower(kind))), F.when(~F.coalesce(in_city, F.lit(False)), "other_city"), F.when(F.coalesce(F.trim(address), F.lit("")) == "", "missing_address")
    )


def in_city(raw_city: Column, address: Column, district: Column, city: str, districts: Sequence[str], others: Sequence[str]) -> Column:
    """City named, listed district, no other city named, or a listed district in the address, in this order."""
    c, a = F.coalesce(raw_city, F.lit("")), F.coalesce(address, F.lit(""))
    other = reduce(lambda x, y: x | y, [c.contains(o) | a.contains(o) for o in others], F.lit(False))
    near = reduce(lambda x, y: x | y, [a.contains(d) for d in districts], F.lit(False))
    return F.when(c.contains(city) | a.contains(city) | F.coalesce(district.isin(*districts), F.lit(False)), True).when(other, False).otherwise(near)
