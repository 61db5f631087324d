"""Operator 5: a reproducible shuffle into shards by a keyed permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def permuted(position: str, total: str, seed: int, rounds: int = 8, walk: int = 64):
    """``position`` (0 <= position < total) sent to its place in a random-looking permutation of the same range.

    An alternating Feistel network over pairs (l, r) with l < a, r < b, where a = ceil(sqrt(total)) and
    b = ceil(total / a); what lands at ``total`` or beyond walks on along its cycle until it is inside. The
    pairs exceed the range by fewer than a numbers, so up to total = 4096 no walk is longer than 64 steps, and
    beyond that one is with a chance below 64 ** -64 (it then fails loudly, it never gives a wrong place).
    """
    a, b = "bigint(ceil(sqrt({t})))", "bigint(ceil({t} / bigint(ceil(sqrt({t})))))"
    a, b = a.format(t=total), b.format(t=total)
    network = f"""aggregate(sequence(1, {rounds}), named_struct('l', {{x}} div {b}, 'r', {{x}} % {b}),
        (s, i) -> if(i % 2 = 1,
            named_struct('l', pmod(s.l + pmod(xxhash64({seed}, i, s.r), {a}), {a}), 'r', s.r),
            named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64({seed}, i, s.l), {b}), {b}))),
        s -> s.l * {b} + s.r)"""
    walked = f"aggregate(sequence(1, {walk}), {network.format(x=position)}, (x, k) -> if(x < {total}, x, {network.format(x='x')}))"
    return F.expr(f"transform(array({walked}), x -> if({total} <= 0 or x < {total}, x, raise_error('a cycle walk was too long; raise walk')))[0]")


#: Copies of one row that are written out together.
COPIES = 10_000


def numbered(rows: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """(keys, row_no, total) for every row: row_no from 0 to total - 1, decided by the keys' values alone.

    Rows with the same keys are interchangeable: they are counted first, numbered as one, and written out again in lots
    of COPIES that Spark spreads over its tasks, so that a row which a third of all rows repeat is no hot task.
    The distinct keys are dealt into ``buckets`` by a hash and numbered inside each (no task sees more than a bucket); the
    buckets' counts, a table of ``buckets`` rows at most and therefore safe to broadcast, give each one its offset.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = counted.groupBy("_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(everything).alias("total"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket")
    lots = placed.select(*keys, "total", "_n", (F.col("_offset") + F.col("_inside")).alias("_first"), F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")).alias("_lot"))
    lots = lots.select(*keys, "total", (F.col("_first") + F.col("_lot") * COPIES).alias("_first"), F.least(F.col("_n") - F.col("_lot") * COPIES, F.lit(COPIES)).alias("_n")).hint("rebalance")
    return lots.select(*keys, "total", F.explode(F.expr("sequence(_first, _first + _n - 1)")).alias("row_no"))


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 20, bucket_rows: int = 1 << 20
) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there, under the law ``rows``.

    The permuted row number p gives shard = p mod n_shards and slot = p div n_shards, so counts differ by one
    at most, slots have no gaps, and anyone can compute the place of row number i from (i, total, seed) alone.
    Size: UTF-8 bytes plus 1. A null text counts as empty (size 1, crc 0); null or repeated ids are kept, each
    row in a slot of its own; an empty table gives an empty one; other columns are not carried. The rows are counted
    first, and numbered in 1,024 buckets or as many as take about ``bucket_rows`` each.
    ``grown_shard`` is null: this law moves rows when the number of shards grows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(rows, ["doc_id", "text_crc32", "size"], max(1024, docs.count() // bucket_rows))
    rows = rows.withColumn("_p", permuted("row_no", "total", seed))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.expr(f"_p div {int(n_shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
