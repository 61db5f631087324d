"""Scoped, filtered, sorted and paged lists over any DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Column = value for each value that is given; None and the empty text are no condition."""
    for c, v in wanted.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


def contains(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows where any of the columns contains the text literally (no wildcards)."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(text), F.lit(False))
    return df.where(hit)


def one_of(df: DataFrame, column: str, wanted: Sequence[str] | None, allowed: Sequence[str]) -> DataFrame:
    """Whitelisted values only; if none is left, all allowed ones."""
    kept = [w for w in wanted or () if w in allowed]
    return df.where(F.col(column).isin(*(kept or allowed)))


def allowed_or_any(df: DataFrame, column: str, wanted: str | None, allowed: Sequence[str]) -> DataFrame:
    """One whitelisted value; an unknown one is no condition."""
    return df.where(F.col(column) == wanted) if wanted in allowed else df


def parse_day(text: str | None) -> date | None:
    """A y-m-d day parameter; a malformed one counts as not given."""
    try:
        return date.fromisoformat(text) if text else None
    except ValueError:
        return None


def between_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """From the first day on, to the end of the last day; the column stays bare so that the scan can prune."""
    a, b = parse_day(first), parse_day(last)
    if a:
        df = df.where(F.col(column) >= F.lit(a))
    if b:
        df = df.where(F.col(column) < F.date_add(F.lit(b), 1))
    return df


def assigned_to(df: DataFrame, column: str, who: str | None) -> DataFrame:
    if not who:
        return df
    return df.where(F.col(column).isNull() if who == "unassigned" else F.col(column) == who)


def scoped(df: DataFrame, role: str, own: str | None, requested: str | None, column: str = "county") -> DataFrame:
    """Staff see their own county whatever they ask for, and nothing without one; an administrator may choose."""
    if role == "admin":
        return equals(df, **{column: requested})
    return df.where(F.col(column) == own) if own else df.where(F.lit(False))


def order_columns(sort: str | None, direction: str | None, allowed: Mapping[str, str], default: str, tie: str) -> list[Column]:
    """Whitelisted sort key and a tie-break; unknown keys give the default; missing values count as least."""
    c = F.col(allowed.get(sort or "", default))
    return [c.desc_nulls_last() if (direction or "").lower() == "desc" else c.asc_nulls_first(), F.col(tie).asc()]


def page_bounds(page, size, default: int = 20, most: int = 100, last_page: int = 10000) -> tuple[int, int]:
    """(offset, limit) from text or numbers; what isn't a number gives the default, what is out of range is clamped."""

    def whole(value, fallback: int, low: int, high: int) -> int:
        try:
            return min(max(int(value), low), high)
        except (TypeError, ValueError):
            return fallback

    limit = whole(size, default, 1, most)
    return (whole(page, 1, 1, last_page) - 1) * limit, limit


def paged(df: DataFrame, order: Sequence[Column], page=1, size=20) -> DataFrame:
    """One page of a total order: the plan keeps offset + limit rows per task, it never sorts everything in one."""
    offset, limit = page_bounds(page, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], size: int = 20, token: Sequence | None = None) -> DataFrame:
    """The ``size`` rows that follow ``token`` in a total order of (column, descending) pairs; the first ones without a token.

    The token holds the order columns of the last row of the page before (``token_of``), so a page reads on from there whatever its
    number. The condition on the first column stands by itself and reaches the scan, where a table ``in_order`` leaves out what lies
    before. Missing values come first, in descending order last.
    """
    def beyond(column: str, falls: bool, value) -> Column:
        c, t = F.col(column), F.lit(value)
        if value is None:
            return F.lit(False) if falls else c.isNotNull()
        return (c < t) | c.isNull() if falls else c > t

    if token is not None:
        (first, falls), value = order[0], token[0]
        if value is not None:
            df = df.where((F.col(first) <= F.lit(value)) | F.col(first).isNull() if falls else F.col(first) >= F.lit(value))
        later = F.lit(False)
        for (column, falls), value in reversed(list(zip(order, token))):
            later = beyond(column, falls, value) | (F.col(column).eqNullSafe(F.lit(value)) & later)
        df = df.where(later)
    return df.orderBy(*[F.desc(c) if falls else F.asc(c) for c, falls in order]).limit(size)


def token_of(page: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple | None:
    """Where the page after this one starts; none after an empty page, which is the end."""
    rows = page.select(*[c for c, _ in order]).collect()  # one page
    return tuple(rows[-1]) if rows else None


def in_order(df: DataFrame, order: Sequence[tuple[str, bool]], path: str, files: int) -> None:
    """Writes a table in ranges of the order, so that a page's condition on the first column leaves out whole files and row groups."""
    by = [F.desc(c) if falls else F.asc(c) for c, falls in order]
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def custom_order(column: str, values: Sequence[str]) -> Column:
    """Place of a value in a list, from 1; others 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)), F.lit(0))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group; the limit is applied before the shuffle as well."""
    out = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n)
    return out.withColumnRenamed("_place", place) if place else out.drop("_place")


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, keys, order, 1)


def by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key table: a keyed read for many keys at once."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def pending(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Work that isn't in the done table yet."""
    return df.join(done.select(*on), list(on), "left_anti")


def known_columns(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """The columns that a target knows, in its order; helper columns that start with _ never pass."""
    return df.select(*[c for c in target if c in df.columns and not c.startswith("_")])


def thread(messages: DataFrame, key: str, order: Sequence[str], *fields: str, out: str = "messages") -> DataFrame:
    """Child rows of each key as one array in order (a thread is small; its length isn't a matter of the data's size)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return messages.groupBy(key).agg(rows.alias(out))
