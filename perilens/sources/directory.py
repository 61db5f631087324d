"""Directory files: header aliases, encodings, nested lists, and the overrides kept by hand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "Big5")
STANDARD = ("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "US-ASCII", "ISO-8859-1")


def pick(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that isn't blank; columns that the file lacks are passed over."""
    found = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """A directory file under canonical names. The first encoding whose header has a known name is taken (one line is read)."""
    known = {n for names in aliases.values() for n in names}
    df = None
    for encoding in encodings:
        if encoding.upper() not in STANDARD:  # Spark reads other charsets only with this setting, which stays on
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.option("header", True).option("encoding", encoding).csv(path)
        df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
        if known & set(df.columns):
            break
    return df.select(*[pick(df, names).alias(c) for c, names in aliases.items()])


def read_json(spark: SparkSession, paths: str | Sequence[str], row: str) -> DataFrame:
    """Rows of JSON files that hold a bare list, or one under data, result or records (``row`` is the rows' schema)."""
    text = spark.read.option("wholetext", True).text(paths)
    wrapped = F.from_json("value", f"data array<struct<{row}>>, result array<struct<{row}>>, records array<struct<{row}>>")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{row}>>")).otherwise(F.coalesce(wrapped["data"], wrapped["result"], wrapped["records"]))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def overrides(df: DataFrame, key: str, line: str, numbers: Sequence[str]) -> DataFrame:
    """Manual overrides: rows without a whole id are skipped, bad numbers are missing, the last line of an id counts."""
    rows = df.withColumns({key: F.col(key).try_cast("long"), **{n: F.col(n).try_cast("double") for n in numbers}}).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), line).alias("_r")).select(key, "_r.*")


def read_table(spark: SparkSession, source: str, **jdbc: str) -> DataFrame:
    """A relational table: a parquet folder, or with ``url`` and further options a JDBC source."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    return spark.read.parquet(source)
