"""Operators on annual panels: one row per entity and year, missing years allowed, missing never zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilens.functions.scalars import growth, safe_divide

#: Spread below this share of the mean counts as none: sums in another order leave such remainders.
NO_SPREAD = 1e-12


def optional(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with those of ``columns`` that it lacks as missing doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def spread(std: Column, mean: Column) -> Column:
    """A standard deviation, missing where it is zero or only rounding."""
    return F.when(std > NO_SPREAD * F.greatest(F.abs(mean), F.lit(NO_SPREAD)), std)


def _by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def row_growth(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """``<c>_growth``: against the previous row of the entity, whatever year it is of."""
    w = _by(keys, order)
    return df.withColumns({f"{c}_growth": growth(c, F.lag(c).over(w)) for c in columns})


def growth_run(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """``<c>_run``: length of the run of growing rows that ends here.

    A row grows if x / prev - 1 > 0, so the sign follows prev; prev = 0 with x > 0 grows; missing doesn't.
    """
    w = _by(keys, order)
    for c in columns:
        prev = F.lag(c).over(w)
        grew = F.coalesce(F.when(prev == 0, F.col(c) > 0).otherwise(F.col(c) / F.nullif(prev, F.lit(0.0)) - 1 > 0), F.lit(False))
        df = df.withColumn("_grew", grew).withColumn("_island", F.sum((~F.col("_grew")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inside = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"{c}_run", F.sum(F.col("_grew").cast("int")).over(inside).cast("int")).drop("_grew", "_island")
    return df


def volatility(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``<c>_volatility``: stddev / |mean| over all rows of the entity, if it has two values and a mean."""
    w = Window.partitionBy(*keys)
    return df.withColumns(
        {f"{c}_volatility": F.when(F.count(c).over(w) >= 2, safe_divide(F.stddev_samp(c).over(w), F.abs(F.avg(c).over(w)))) for c in columns}
    )


def row_change(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str) -> DataFrame:
    """``<c>_change``: difference from the previous row of the entity."""
    w = _by(keys, order)
    return df.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in columns})


def self_z(column: str, keys: Sequence[str], order: str, least: int = 2) -> Column:
    """z against strictly earlier rows of the entity, of which ``least`` must have a value."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    mean, std = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return F.when(F.count(column).over(w) >= least, safe_divide(F.col(column) - mean, spread(std, mean)))


def with_peer_z(df: DataFrame, columns: Mapping[str, str], year: str, county: str, size: str, band: int = 20, least: int = 3) -> DataFrame:
    """``columns`` maps value columns to names of their z among peers of the same year.

    Groups from fine to coarse: (year, size band, county), (year, county), (year, band), (year); the finest one with
    ``least`` values and a spread counts. A missing key makes a level void. The panel is aggregated once, to its cells
    (year, band, county), and the columns of a cell become rows, so that one set of windows serves all columns; the coarser
    levels merge the cells' counts, means and squared deviations, each cell picks its level, and one join brings
    two numbers a column back to the rows. Windows see cells only, never rows.
    """
    cell, zero = [year, "_band", county], F.lit(0.0)
    df = df.withColumn("_band", F.floor(F.col(size) / band))
    facts = [F.struct(F.lit(c).alias("_c"), F.count(c).alias("_n"), F.coalesce(F.avg(c), zero).alias("_m"), F.coalesce(F.var_samp(c) * (F.count(c) - 1), zero).alias("_q")) for c in columns]
    cells = df.groupBy(*cell).agg(F.array(*facts).alias("_facts")).select(*cell, F.inline("_facts"))
    levels = [cell, [year, county], [year, "_band"], [year]]
    over = [Window.partitionBy("_c", *keys) for keys in levels]
    void = [reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys if k != year], F.lit(False)) for keys in levels]
    cells = cells.withColumns({f"_n{i}": F.sum("_n").over(w) for i, w in enumerate(over)})
    cells = cells.withColumns({f"_m{i}": safe_divide(F.sum(F.col("_n") * F.col("_m")).over(w), f"_n{i}") for i, w in enumerate(over)})
    squares = lambda i: F.col("_q") + F.col("_n") * F.pow(F.col("_m") - F.col(f"_m{i}"), 2)
    cells = cells.withColumns({f"_s{i}": F.sqrt(safe_divide(F.sum(squares(i)).over(w), F.col(f"_n{i}") - 1)) for i, w in enumerate(over)})
    fit = [
        F.when(~void[i] & (F.col(f"_n{i}") >= least) & spread(F.col(f"_s{i}"), F.col(f"_m{i}")).isNotNull(), F.struct(F.col(f"_m{i}").alias("m"), F.col(f"_s{i}").alias("s")))
        for i in range(len(levels))
    ]
    picks = cells.groupBy(*[F.col(k).alias(f"_key_{k}") for k in cell]).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.coalesce(*fit)))).alias("_picks"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in cell])
    out = df.join(picks, same, "left")
    pick = lambda c: F.col("_picks")[c]
    out = out.withColumns({name: safe_divide(F.col(c) - pick(c)["m"], pick(c)["s"]) for c, name in columns.items()})
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def prior_year(df: DataFrame, keys: Sequence[str], year: str, value: str, out: str = "prior") -> DataFrame:
    """``out``: the value of the year before (a gap gives missing, repeated keys fan out)."""
    before = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias(out))
    return df.join(before, [*keys, year], "left")


def yoy(df: DataFrame, keys: Sequence[str], year: str, value: str, category: str, earliest: Mapping[str, int]) -> DataFrame:
    """prior, change and rate against the year before; blank in a category's first legal year."""
    out = prior_year(df, keys, year, value)
    first = reduce(lambda a, kv: a | ((F.col(category) == kv[0]) & (F.col(year) == kv[1])), earliest.items(), F.lit(False))
    prior = F.when(~F.coalesce(first, F.lit(False)), F.col("prior"))
    out = out.withColumn("prior", prior)
    return out.withColumns({"change": F.col(value) - F.col("prior"), "rate": growth(value, "prior")})


def history_z(df: DataFrame, keys: Sequence[str], year: str, value: str, category: str, earliest: Mapping[str, int], window: int = 3) -> DataFrame:
    """Inclusive history mean and deviation, z, and a moving mean; years before the category's first are dropped."""
    first = F.create_map(*[F.lit(x) for kv in earliest.items() for x in kv])[F.col(category)]
    out = df.where(first.isNull() | (F.col(year) >= first))
    w = _by(keys, year)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns(
        {"history_mean": F.avg(value).over(past), "history_std": F.stddev_samp(value).over(past), "moving_mean": F.avg(value).over(w.rowsBetween(1 - window, 0))}
    )
    return out.withColumn("z", safe_divide(F.col(value) - F.col("history_mean"), spread(F.col("history_std"), F.col("history_mean"))))


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, metrics: Sequence[str], order: str) -> DataFrame:
    """One column per metric: its first value by ``order`` that isn't missing. The list makes the pivot one pass."""
    picked = [
        F.min_by(F.when(F.col(name) == m, F.col(value)), F.when((F.col(name) == m) & F.col(value).isNotNull(), F.col(order))).alias(m) for m in metrics
    ]
    return df.where(F.col(name).isin(*metrics)).groupBy(*keys).agg(*picked)


def first_matching(name: str, value: str, order: str, *patterns: str) -> Column:
    """Aggregate: the first value, by ``order``, of a metric whose name matches all patterns."""
    fits = reduce(lambda a, p: a & F.col(name).rlike(p), patterns, F.col(value).isNotNull())
    return F.min_by(F.when(fits, F.col(value)), F.when(fits, F.col(order)))


def merge_metrics(base: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """Outer (or left) merge on the keys; gaps stay missing."""
    return base.join(other, list(keys), how)


def merge_events(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join of each source on those of ``keys`` that it has; one without rows or keys changes nothing."""
    for source in sources:
        on = [k for k in keys if k in source.columns]
        if on:
            base = base.join(source, on, "left")
    return base


def over_budget_share(items: Mapping[str, tuple[str, str]]) -> Column:
    """Share of items whose actual is above budget, among those with both and a budget that isn't 0."""
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(b) != 0) for a, b in items.values()]
    over = [(x & (F.col(a) > F.col(b))).cast("int") for x, (a, b) in zip(both, items.values())]
    zero = F.lit(0)
    return safe_divide(sum((F.coalesce(x, zero) for x in over), zero), sum((F.coalesce(x.cast("int"), zero) for x in both), zero))


def over_rate_share(rate: str, limit: float = 100.0) -> Column:
    """Aggregate: share of execution rates above ``limit`` among those that are there."""
    return safe_divide(F.count_if(F.col(rate) > limit), F.count(rate))


def budget_from_rate(actual: str, rate: str) -> tuple[Column, Column]:
    """(deviation, budget) worked back from an execution rate in percent."""
    part = F.col(rate) / 100
    return part - 1, safe_divide(F.col(actual), part)


def keyword_count(text: Column, keyword: str) -> Column:
    """Occurrences that don't overlap."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))
    return (gone / len(keyword)).cast("int")


def note_keywords(notes: DataFrame, keys: Sequence[str], text: str, keywords: Sequence[str]) -> DataFrame:
    """Keyword counts over all notes of an entity and year.

    Counted note by note and summed: a keyword holds no line end, so it can't span two notes of a joined text. A
    missing note counts for nothing.
    """
    counts = {k: F.sum(F.coalesce(keyword_count(F.col(text), k), F.lit(0))).cast("int") for k in keywords}
    return notes.groupBy(*keys).agg(*[c.alias(f"n_{k}") for k, c in counts.items()])


def series_z(df: DataFrame, column: str, least: int = 2, out: str = "z") -> DataFrame:
    """z over the whole column, if it has ``least`` values: one row of statistics, joined back."""
    stats = df.agg(F.count(column).alias("_n"), F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.when(F.col("_n") >= least, safe_divide(F.col(column) - F.col("_m"), spread(F.col("_s"), F.col("_m"))))
    return df.join(F.broadcast(stats)).withColumn(out, z).drop("_n", "_m", "_s")


def label_age(df: DataFrame, keys: Sequence[str], label: str, order: str, out: str = "years_back") -> DataFrame:
    """0 for rows of the first label to appear in a file, 1 for rows of any later one."""
    first = F.min(order).over(Window.partitionBy(*keys, label))
    df = df.withColumn("_first", first)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    return df.withColumn(out, F.least(rank - 1, F.lit(1))).drop("_first")


def last_amounts(df: DataFrame, keys: Sequence[str], name: str, value: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """One column per subject: its last amount by ``order`` in a file, year and section."""
    return df.where(F.col(name).isin(*metrics)).groupBy(*keys).agg(
        *[F.max_by(F.when(F.col(name) == m, F.col(value)), F.when(F.col(name) == m, F.col(order))).alias(m) for m in metrics]
    )
