"""Write semantics as joins: the new state of a keyed table, to be written beside the one that was read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilens.operators.rounds import first_come


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``: what a sequence of overwrites would leave."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def overwrite(existing: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Insert, or overwrite all but the keys and the ``keep`` columns (such as created_at), which stay as they were.

    ``new`` has one row per key (see ``last_per_key``). Existing rows with other keys pass untouched.
    """
    untouched = existing.join(new.select(*keys), list(keys), "left_anti")
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(old, list(keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return untouched.unionByName(new.select(*existing.columns))


def touch(existing: DataFrame, new: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """A known key only moves its ``last`` time; unknown ones come in whole. Running it twice changes nothing."""
    fresh = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), first).alias("_n"), F.max(last).alias("_last"))
    both = existing.select(F.col(key), F.struct(*existing.columns).alias("_o")).join(fresh, key, "full")
    column = lambda c: F.coalesce(F.greatest(f"_o.{last}", "_last") if c == last else F.col(f"_o.{c}"), F.col(f"_n.{c}"))
    return both.select(*[(F.col(key) if c == key else column(c)).alias(c) for c in existing.columns])


def match_then_touch(existing: DataFrame, new: DataFrame, ids: Sequence[str], key: str, first: str, last: str) -> DataFrame:
    """The earlier rule: a row is known by its resource name if it has one, else by place and hash."""
    name, *rest = ids
    known = existing.where(F.col(name).isNotNull()).select(F.col(name), F.col(key).alias("_by_name"))
    by_rest = existing.groupBy(*rest).agg(F.min(key).alias("_by_rest"))
    found = new.join(known, name, "left").join(by_rest, list(rest), "left").withColumn(key, F.coalesce("_by_name", "_by_rest", key))
    return touch(existing, found.select(*existing.columns), key, first, last)


def overwrite_some(existing: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Insert, or overwrite only the listed columns of a known key."""
    both = existing.select(*keys, F.struct(*existing.columns).alias("_o")).join(new.select(*keys, F.struct(*existing.columns).alias("_n")), list(keys), "full")
    pick = {c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")) if c in columns else F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")) for c in existing.columns if c not in keys}
    return both.select(*keys, *[x.alias(c) for c, x in pick.items()]).select(*existing.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, unique: Sequence[str], order: str) -> DataFrame:
    """Rows that go in one after the other by ``order``, each unless it clashes on a unique key with the table or with one that went in.

    What clashes with the table goes first, on every key; a row that doesn't go in blocks no other.
    """
    for key in unique:
        new = new.join(existing.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return first_come(new, [[k] for k in unique], order)


def with_parent(children: DataFrame, parents: DataFrame, key: str, label: str) -> DataFrame:
    """Child rows of the parents that went in, each (parent, label) once: the tags that an insert-ignore writes with its rows."""
    return children.join(parents.select(key), key, "left_semi").dropDuplicates([key, label])


def replace_slice(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the slices that ``new`` touches give way to its rows."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_open(existing: DataFrame, new: DataFrame, resolved: str = "resolved") -> DataFrame:
    """Resolved rows stay, all others give way to the new ones."""
    return existing.where(F.col(resolved)).unionByName(new)


def cascade(parents: DataFrame, children: DataFrame, key: str, child_key: str, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after the deletion of the doomed parents; a condition that is missing dooms nothing."""
    left = parents.where(~F.coalesce(doomed, F.lit(False)))
    return left, children.join(left.select(F.col(key).alias(child_key)), child_key, "left_semi")


def with_attempts(state: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], attempts: str = "attempts") -> DataFrame:
    """Fields take the update where it has one; every update counts as an attempt."""
    u = updates.select(key, F.struct(*fields).alias("_u"))
    out = state.join(u, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_u.{c}"), F.col(c)) for c in fields})
    return out.withColumn(attempts, F.col(attempts) + F.col("_u").isNotNull().cast("int")).drop("_u")


def sentinels(entities: DataFrame, matches: DataFrame, key: str, values: Mapping[str, object]) -> DataFrame:
    """``matches`` and a row with literal values for every entity that has none, so that it isn't tried again."""
    lacking = entities.select(key).join(matches.select(key), key, "left_anti")
    return matches.unionByName(lacking.withColumns({c: F.lit(v) for c, v in values.items()}), allowMissingColumns=True)


def scope_snapshot(rows: DataFrame, key: str, filters: Mapping[str, str]) -> DataFrame:
    """(filters, bucket, bits): a selection of whole-number ids as a bitmap for each bucket of 32,768 of them, with the filters it came from.

    No row holds all ids, however many there are; ten million dense ids are some 300 rows of 4 KB. An empty selection has no rows.
    """
    table = F.create_map(*[F.lit(x) for kv in filters.items() for x in kv])
    ids = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits")
    return ids.groupBy(F.bitmap_bucket_number("_id").alias("bucket")).agg(bits).select(table.alias("filters"), "bucket", "bits")


def in_scope(rows: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The rows whose id is in the snapshot: an equi-join on the bucket and a test of the bit; a small snapshot is broadcast by its size."""
    number = F.col(key).cast("long")
    held = rows.join(scope.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), F.bitmap_bucket_number(number) == F.col("_bucket"))
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits")


def latest_state(log: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Current state by an append-only log: the fields of the newest entry."""
    return log.groupBy(key).agg(F.max_by(F.struct(order, *fields), order).alias("_s"), F.count("*").alias("entries")).select(key, "_s.*", "entries")
