"""Rules that depend on order, settled in rounds of joins instead of one row after the other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; unset on a single machine, a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that a round starts from a table and not from all rounds before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _classes(open_: DataFrame, names: Sequence[str]) -> DataFrame:
    """(_at, _class): rows that a chain of shared keys connects have one class, the least ``_at`` among them.

    In a round a row takes the least class of all rows that share a key with it, and then the class of the row that this names:
    what the first step moves by one row along a chain, the second doubles.
    """
    at = written(open_.select("_at", F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.to_json(n).alias("k")) for n in names]), lambda x: x["k"].isNotNull())).alias("_key")))
    classes = written(open_.select("_at", F.col("_at").alias("_class")))
    while True:
        seen = at.join(classes, "_at")
        near = seen.join(seen.groupBy("_key").agg(F.min("_class").alias("_m")), "_key").groupBy("_at").agg(F.min("_m").alias("_m"))
        near = written(near)
        jumped = near.join(near.select(F.col("_at").alias("_m"), F.col("_m").alias("_mm")), "_m", "left")
        after = written(jumped.select("_at", F.coalesce("_mm", "_m").alias("_class")))
        if after.exceptAll(classes).isEmpty():
            return after
        classes = after


def _in_order(rows: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """The rows of each ``group`` that are taken, one after the other, in one task a group."""
    keys = F.array(*[F.to_json(n) for n in names])
    numbered = rows.withColumns({"_n": F.row_number().over(Window.partitionBy(group).orderBy("_at")), "_keys": keys})

    def settle(_, held):
        taken, keep = set(), np.zeros(held.num_rows, bool)
        of = held.column("_keys").to_pylist()
        for i in np.argsort(held.column("_n").to_numpy()).tolist():
            own = [(k, x) for k, x in enumerate(of[i]) if x is not None]
            if not any(x in taken for x in own):
                keep[i] = True
                taken.update(own)
        return held.filter(pa.array(keep)).select(["_row"])

    return numbered.select(group, "_n", "_keys", "_row").groupBy(group).applyInArrow(settle, numbered.select("_row").schema)


def first_come(rows: DataFrame, keys: Sequence[Sequence[str]], order: str, pass_rows: int = 100_000, rounds: int = 6) -> DataFrame:
    """The rows that stay if they come by ``order`` and each is taken unless it shares a key with a row taken before.

    A key is a group of columns and blocks nothing where one of them is missing; a row that isn't taken blocks none of its
    keys. Rows of equal order come by a hash of the row; of rows that are equal in all columns and have a key one is taken.

    In a round, a row that is the first of all the open rows on each of its keys is taken, and what shares a key with it
    goes. Most rows are settled in few rounds, but a chain of n clashes takes n / 2. So once ``pass_rows`` or fewer rows are open, a
    single ordered pass settles them; if more are open after ``rounds`` rounds, the open rows are cut into classes that no key connects,
    and each class of up to ``pass_rows`` rows has an ordered pass of its own, in parallel. Only larger classes go on in rounds. Rows that
    agree on all keys are one row before that, so a key that a third of all rows share doesn't meet in one task.
    """
    columns, names = rows.columns, [f"_k{i}" for i in range(len(keys))]
    whole = {n: F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]), F.struct(*key)) for n, key in zip(names, keys)}
    open_ = rows.withColumns({"_at": F.struct(F.col(order).alias("order"), F.xxhash64(*columns).alias("hash")), **whole})
    free = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in names])
    out = open_.where(free).select(*columns)
    grouped = open_.where(~free).groupBy(*names).agg(F.min_by(F.struct(*columns), "_at").alias("_row"), F.min("_at").alias("_at"))
    open_, made = written(grouped), 0
    while (left := open_.count()) > pass_rows:
        if made and made % rounds == 0:
            classed = written(open_.join(_classes(open_, names), "_at"))
            sizes = classed.groupBy("_class").count()
            small = classed.join(sizes.where(F.col("count") <= pass_rows), "_class", "left_semi")
            out = out.unionByName(written(_in_order(small, "_class", names)).select("_row.*"))
            open_ = written(classed.join(sizes.where(F.col("count") > pass_rows), "_class", "left_semi").drop("_class"))
            made += 1
            continue
        made += 1
        marked = open_
        for n in names:
            marked = marked.join(open_.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_at").alias(f"_first{n}")), n, "left")
        first = reduce(lambda a, b: a & b, [F.col(n).isNull() | (F.col("_at") == F.col(f"_first{n}")) for n in names])
        taken = written(marked.where(first).select(*names, "_at", "_row"))
        out = out.unionByName(taken.select("_row.*"))
        rest = open_
        for n in names:
            rest = rest.join(taken.where(F.col(n).isNotNull()).select(n), n, "left_anti")
        open_ = written(rest)
    if left:
        out = out.unionByName(written(_in_order(open_.withColumn("_class", F.lit(0)), "_class", names)).select("_row.*"))
    return out
