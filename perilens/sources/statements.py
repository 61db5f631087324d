"""Financial statement files to one long table: (code, name, year, table, metric, value, category, source)."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perilens.functions.scalars import money

#: File name patterns, table names and column names of the statement files.
KINDS = {
    "income": r"_\d{3}學年度收支餘絀表\.csv$", "balance": r"_資產負債表\.csv$", "cash": r"_現金流量表\.csv$",
    "appendix2": "_附表二_", "appendix3": "_附表三_", "appendix4": "_附表四_",
}
TABLES = {"income": "收支餘絀表", "balance": "資產負債表", "cash": "現金流量表", "appendix2": "附表二", "appendix3": "附表三", "appendix4": "附表四"}
SKIPPED = "驗證|page_index|checkpoint"
LONG = ["code", "name", "year", "table", "metric", "value", "category", "source"]


def path_keys(path: Column) -> dict[str, Column]:
    """Code and name from the file name's front, year from the folder; without a code the folder gives the name."""
    decoded = F.try_url_decode(path)
    file = F.regexp_extract(decoded, "([^/]+)$", 1)
    code = F.nullif(F.regexp_extract(file, r"^(N\d+)(.+?)_", 1), F.lit(""))
    folder = F.regexp_extract(decoded, "([^/]+)/[^/]+$", 1)
    name = F.coalesce(F.nullif(F.regexp_extract(file, r"^(N\d+)(.+?)_", 2), F.lit("")), folder)
    return {"code": code, "name": name, "year": F.nullif(F.regexp_extract(decoded, r"(\d{3})學年度", 1), F.lit("")).cast("int"), "source": file}


def kind_of(path: Column) -> Column:
    """The kind of a statement file by its path: the first pattern that fits; missing for other files and for those to skip."""
    kind = F.coalesce(*[F.when(path.rlike(p), k) for k, p in KINDS.items()])
    return F.when(~path.rlike(SKIPPED), kind)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind) of the statement files below a folder, listed by Spark; the first pattern that fits decides."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    path = F.try_url_decode("path")
    return listed.select(path.alias("path"), kind_of(path).alias("kind")).where("kind is not null")


def _long(df: DataFrame, metric: Column, value: Column, table: str, category: str) -> DataFrame:
    rows = df.select("code", "name", "year", F.lit(table).alias("table"), F.trim(metric).alias("metric"), value.alias("value"), F.lit(category).alias("category"), "source")
    return rows.where(F.coalesce("metric", F.lit("")) != "")


def income(df: DataFrame) -> DataFrame:
    return _long(df, F.col("科目"), money("金額"), TABLES["income"], "income")


def balance(df: DataFrame) -> DataFrame:
    """Rows of the current year only; a blank year mark passes."""
    return _long(df.where(F.coalesce("年度類別", F.lit("")).isin("", "本年度")), F.col("科目"), money("金額"), TABLES["balance"], "other")


def _first_column(df: DataFrame, pattern: str) -> str | None:
    return next((c for c in df.columns if re.search(pattern, c)), None)


def cash_flow(df: DataFrame) -> DataFrame | None:
    """The first column whose name ends in the amount suffix is the current year."""
    c = _first_column(df, "學年度金額$")
    return c and _long(df, F.col("項目"), money(f"`{c}`"), TABLES["cash"], "other")


def _stacked(df: DataFrame, parts: dict[str, str], table: str) -> DataFrame | None:
    rows = [_long(df.where(F.trim("項目") != ""), F.concat(F.trim("項目"), F.lit(f"-{label}")), money(f"`{c}`"), table, "other") for label, c in parts.items() if c]
    return reduce(DataFrame.unionByName, rows) if rows else None


def appendix2(df: DataFrame) -> DataFrame | None:
    return _stacked(df, {"actual": "決算數", "rate": "差異率"}, TABLES["appendix2"])


def appendix3(df: DataFrame) -> DataFrame | None:
    parts = {"actual": _first_column(df, r"\d{3}學年度決算數$"), "rate": _first_column(df, r"\d{3}學年度執行率$")}
    return _stacked(df, parts, TABLES["appendix3"])


def appendix4(df: DataFrame) -> DataFrame:
    """Two metrics per file: number of rows and sum of book values, what doesn't parse counting 0."""
    sums = df.groupBy("code", "name", "year", "source").agg(F.count("*").cast("double").alias("rows"), F.sum(F.coalesce(money("帳面價值"), F.lit(0.0))).alias("book_value"))
    long = sums.unpivot(["code", "name", "year", "source"], ["rows", "book_value"], "metric", "value")
    return long.select("code", "name", "year", F.lit(TABLES["appendix4"]).alias("table"), "metric", "value", F.lit("other").alias("category"), "source")


LOADERS = {"income": income, "balance": balance, "cash": cash_flow, "appendix2": appendix2, "appendix3": appendix3, "appendix4": appendix4}


#: Cells that the reference reader takes for missing.
MISSING = frozenset("#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null".split("|"))


def _read(content: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and lines of a file. What is regular is read by the csv module; anything else is left to pandas, which decides whether it is an error.

    A quote without end is an error to both, unless a line starts with a blank, after which only pandas opens quotes.
    """
    text = ""
    try:
        text = content.decode("utf-8-sig")
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]
        names = rows[0] if rows else []
        blank = any(len(r) == 1 and not r[0].strip() for r in rows)
        if names and not blank and all(names) and len(set(names)) == len(names) and max(map(len, rows)) == len(names):
            return names, [["" if c in MISSING else c for c in r] + [""] * (len(names) - len(r)) for r in rows[1:]]
    except (csv.Error, UnicodeDecodeError) as problem:
        if str(problem) == "unexpected end of data" and not re.search(r"(?:^|[\r\n])[ \t]|\0", text):
            raise ValueError("a quote without end") from None
    import pandas as pd

    held = pd.read_csv(io.BytesIO(content), dtype=str).fillna("")
    return [str(c) for c in held.columns], held.to_numpy().tolist()


def parsed(files: DataFrame) -> DataFrame:
    """(path, kind, at, cells, book, error) of files (path, kind, content), with their further columns: every file read by its own header.

    A file gives a row at -1 with its header's names, and one for each line with all its cells by name, '' for what is blank or
    marked as missing. A byte order mark is no part of the first name, lines that end early have blanks, blank lines don't count. A file that
    isn't UTF-8, has no header, a line of more cells than the lines before or a quote without end gives a single row with the error. Where
    the first line already has a cell more than names, the first cells are taken for labels of the lines. The row at -1 of an appendix 4 has
    the book values of all lines in ``book``, missing ones where there is no such column. Rows of many files share a batch.
    """
    more = [f for f in files.schema if f.name not in ("path", "kind", "content")]
    carried = [f.name for f in more]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("kind").to_pylist()
            of, at, ends, keys, cells, books, errors = [], [], [0], [], [], [], []

            def full() -> pa.RecordBatch:
                maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(cells, pa.string()))
                path, kind, *own = (b.column(c).take(pa.array(of, pa.int64())) for c in ("path", "kind", *carried))
                columns = [path, kind, pa.array(at, pa.int64()), maps, pa.array(books, pa.list_(pa.string())), pa.array(errors, pa.string()), *own]
                for x in (of, at, keys, cells, books, errors):
                    x.clear()
                ends[:] = [0]
                return pa.RecordBatch.from_arrays(columns, names=["path", "kind", "at", "cells", "book", "error", *carried])

            for i, content in enumerate(b.column("content")):
                try:
                    (names, lines), error = _read(content.as_py() or b""), None
                except ValueError as problem:  # pandas' errors of parsing and decoding are such
                    names, lines, error = [], [], str(problem)
                book = None
                if kinds[i] == "appendix4":
                    where = names.index("帳面價值") if "帳面價值" in names else None
                    book = [None if where is None else line[where] for line in lines]
                for k, line in enumerate([[""] * len(names), *lines], -1):
                    of.append(i)
                    at.append(k)
                    keys.extend(names)
                    cells.extend(line)
                    ends.append(len(keys))
                    books.append(book if k < 0 else None)
                    errors.append(error)
                    if len(at) == 10_000:
                        yield full()
            if at:
                yield full()

    schema = StructType.fromDDL("path string, kind string, at long, cells map<string,string>, book array<string>, error string")
    return files.select("path", "kind", "content", *carried).mapInArrow(read, StructType([*schema, *more]))


def keyed(files: DataFrame) -> DataFrame:
    """Files with code, name, year and source of their paths, which ``parsed`` hands on: found once a file and not once a line."""
    escaped = F.replace(F.replace(F.col("path"), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return files.withColumns(path_keys(escaped))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The statement files below ``root``, parsed; Spark lists them, deals them in lots, and reads them from any store that it can read.

    Its readers pass over files of no bytes, which hold no rows.
    """
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return parsed(keyed(held.select("path", kind_of(F.col("path")).alias("kind"), "content").where("kind is not null")))


def bad_files(rows: DataFrame) -> DataFrame:
    """(path, kind, error) of the files that could not be parsed."""
    return rows.where("error is not null").select("path", "kind", "error")


def long_rows(rows: DataFrame) -> DataFrame:
    """Parsed files as the long table, in one pass and without a shuffle; a file gives nothing for a column that its header hasn't.

    The present year's amounts are under the first name that ends as they do. Files without a code in their name are left out.
    """
    cell = lambda name: F.element_at("cells", F.lit(name) if isinstance(name, str) else name)
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    first = lambda pattern: cell(F.get(F.filter(F.map_keys("cells"), lambda c: c.rlike(pattern)), F.lit(0)))
    entry = lambda metric, raw, value=F.lit(None): F.struct(metric.alias("metric"), raw.cast("string").alias("raw"), value.cast("double").alias("value"))
    item, label = bare(cell("項目")), lambda end: F.when(bare(cell("項目")) != "", F.concat(bare(cell("項目")), F.lit("-" + end)))
    there = lambda entries, raw: F.when(raw.isNotNull(), entries).otherwise(F.array().cast("array<struct<metric:string,raw:string,value:double>>"))
    amount, done, rate = first("學年度金額$"), first(r"\d{3}學年度決算數$"), first(r"\d{3}學年度執行率$")
    kind, single = F.col("kind"), F.array(entry(bare(cell("科目")), cell("金額")))
    total = F.aggregate("book", F.lit(0.0), lambda so_far, x: so_far + F.coalesce(money(x), F.lit(0.0)))
    books = F.array(*[entry(F.lit(metric), F.lit(None), value) for metric, value in (("rows", F.size("book")), ("book_value", total))])
    entries = (
        F.when(F.col("at") < 0, F.when(kind == "appendix4", books))
        .when(kind == "income", single)
        .when((kind == "balance") & F.coalesce(cell("年度類別"), F.lit("")).isin("", "本年度"), single)
        .when((kind == "cash") & amount.isNotNull(), F.array(entry(item, amount)))
        .when(kind == "appendix2", F.array(entry(label("actual"), cell("決算數")), entry(label("rate"), cell("差異率"))))
        .when(kind == "appendix3", F.concat(there(F.array(entry(label("actual"), done)), done), there(F.array(entry(label("rate"), rate)), rate)))
    )
    table = F.coalesce(*[F.when(kind == k, t) for k, t in TABLES.items()])
    rows = rows if "code" in rows.columns else keyed(rows)
    good = rows.where("error is null and code is not null").withColumn("table", table)
    lines = good.select("code", "name", "year", "table", "kind", "source", F.explode(entries).alias("e")).where("e.metric <> ''")
    value = F.when(kind == "appendix4", F.col("e.value")).otherwise(money("e.raw"))
    return lines.select("code", "name", "year", "table", "e.metric", value.alias("value"), F.when(kind == "income", "income").otherwise("other").alias("category"), "source")


def long_table(spark: SparkSession, root: str) -> DataFrame:
    """All statement files below ``root`` that can be parsed as one long table; ``bad_files`` lists the others."""
    return long_rows(read_files(spark, root))


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """A stored long table; values that aren't numbers are missing."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({"value": F.col("value").try_cast("double"), "year": F.col("year").try_cast("int")})


def page_index(documents: DataFrame, name: str, pages: str, left_out: int = 5) -> DataFrame:
    """One row per page of a document but the one left out, with its section and whether it shows this year or the last."""
    rows = documents.select(name, F.explode(F.sequence(F.lit(1), F.col(pages))).alias("page")).where(F.col("page") != left_out)
    section = F.when(F.col("page") <= 2, "cover").when(F.col("page") <= 4, "income").when(F.col("page") <= 8, "balance").otherwise("appendix")
    return rows.withColumns({"section": section, "year_mark": F.when(F.col("page") % 2 == 0, "previous").otherwise("current")})


def stamped(long: DataFrame, keys: Sequence[str], year: str, field: str, value: str, years: Sequence[int], fields: Sequence[str]) -> DataFrame:
    """Long statement rows with year-stamped column names, for export: the names are given, so the pivot is one pass."""
    names = [f"{y}_{f}" for y in years for f in fields]
    stamped_rows = long.withColumn("_c", F.concat(F.col(year).cast("string"), F.lit("_"), F.col(field)))
    return stamped_rows.groupBy(*keys).pivot("_c", names).agg(F.first(value, ignorenulls=True))
