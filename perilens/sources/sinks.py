"""Exports and run logs. Every sink writes a folder; a table that was read is never rewritten in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from perilens.functions.text import aliases


def to_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The listed columns with a header; others are left out (no byte order mark is written)."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def to_jsonl(df: DataFrame, path: str, leave_out: Sequence[str] = ("raw_json",)) -> None:
    df.drop(*leave_out).write.mode("overwrite").json(path)


def by_partition(df: DataFrame, path: str, column: str, kind: str = "json") -> None:
    """One folder per value, in one write: rows of a value may come from many tasks, so a large one isn't one file."""
    df.write.mode("overwrite").partitionBy(column).format(kind).save(path)


def archive(df: DataFrame, path: str, *columns: str, run: str | None = None) -> None:
    """Raw payloads by source, district or day; earlier days stay. With a ``run`` they are also kept by run, and the same run again replaces its own."""
    if run is None:
        df.write.mode("append").partitionBy(*columns).json(path)
    else:
        df.write.mode("overwrite").partitionBy(*columns).json(f"{path}/run={run}")


def export_slices(df: DataFrame, path: str, column: str, kind: str = "json") -> dict[str, str]:
    """One folder per value of ``column``, each there whole or not at all; {value: "ok" or "failed: ..."}.

    Rows are first written to a staging folder beside the others, and a value's folder is put in its place, replacing an earlier
    one, when all its rows are written. One job writes all values. If it fails, the values are halved and each half is written by
    itself, so a few bad values cost a few jobs each and leave no file, while the others are exported whole. Values are districts
    or the like: their number is that of the folders.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    files = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = df.withColumn("_slice", F.coalesce(F.col(column).cast("string"), F.lit("__none__")))
    values = sorted(r[0] for r in named.select("_slice").distinct().collect())
    out: dict[str, str] = {}

    def export(some: list[str]) -> None:
        staging = f"{path}/_staging_{uuid.uuid4().hex}"
        try:
            held = named if len(some) == len(values) else named.where(F.col("_slice").isin(some))
            held.write.partitionBy("_slice").format(kind).save(staging)
            made = {s.getPath().getName(): s.getPath() for s in files.listStatus(where(staging)) if s.isDirectory()}
            for name, folder in made.items():
                place = where(f"{path}/{name.replace('_slice=', column + '=', 1)}")
                files.delete(place, True)
                if not files.rename(folder, place):
                    raise OSError(f"could not put {name} in its place")
            out.update(dict.fromkeys(some, "ok"))
        except Exception as problem:  # noqa: BLE001 - the status reports it
            if len(some) == 1:
                out[some[0]] = f"failed: {str(problem)[:200]}"
        finally:
            files.delete(where(staging), True)
        if not all(v in out for v in some):
            export(some[: len(some) // 2])
            export(some[len(some) // 2 :])

    if values:
        export(values)
    return out


def split(df: DataFrame, reason: str, valid: Sequence[str], rejected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows with their own columns; a missing reason is valid."""
    return df.where(F.col(reason).isNull()).select(*valid), df.where(F.col(reason).isNotNull()).select(*rejected)


def rejects(*parts: DataFrame) -> DataFrame:
    """Rejected rows of several steps with all columns that any of them has."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def replace_slices(df: DataFrame, path: str, *columns: str) -> None:
    """Overwrites only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def keywords(institutions: DataFrame, key: str, name: str) -> DataFrame:
    """The dictionary of comparison names of every institution."""
    return institutions.select(key, name, aliases(name).alias("aliases"))


def logged(spark: SparkSession, job: str, df: DataFrame, counts: Mapping[str, Column], write: Callable[[DataFrame], None], log_path: str) -> dict:
    """Writes ``df`` and appends one run-log row: counts taken during the write, status and error."""
    seen = Observation()
    status, error = "success", None
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in counts.items()]))
        found = seen.get
    except Exception as problem:  # noqa: BLE001 - the log reports it, and it is raised again
        status, error, found = "failed", str(problem)[:500], {}
        raise
    finally:
        row = {"job": job, "status": status, "error": error, "total": found.get("total"), "counts": {k: found.get(k) for k in counts}}
        frame = spark.createDataFrame([(job, status, error, row["total"], row["counts"])], "job string, status string, error string, total long, counts map<string,long>")
        frame.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(log_path)
    return row


def export_all(jobs: Mapping[str, Callable[[], None]]) -> dict[str, str]:
    """Runs every export; one that fails doesn't stop the others. Status by name."""
    out = {}
    for name, job in jobs.items():
        try:
            job()
            out[name] = "ok"
        except Exception as problem:  # noqa: BLE001 - the status reports it
            out[name] = f"failed: {type(problem).__name__}"
    return out
