"""Runs registered queries beside their SQL in DuckDB. ``python -m tests.oracle [sf_dir] [name ...]`` prints a table."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, dict):
        return tuple((k, cell(v)) for k, v in sorted(x.items()))
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return float(x) + 0.0
    return x


def difference(spark_df, con, text):
    """Empty if both give the same columns and rows, else what differs."""
    names = sorted(spark_df.columns)
    got = [tuple(cell(r[c]) for c in names) for r in (r.asDict(recursive=True) for r in spark_df.collect())]
    cur = con.execute(text)
    head = [c[0] for c in cur.description]
    if sorted(head) != names:
        return f"columns {names} and {sorted(head)}"
    want = [tuple(cell(dict(zip(head, r))[c]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {names}: {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder, names = (sys.argv[1], sys.argv[2:]) if len(sys.argv) > 1 else ("/root/testdata/sf0.01", [])
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if names and not any(name.startswith(n) for n in names) or not names and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            df = f(spark, folder)
            said = difference(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
        except Exception as x:
            said = "ERROR " + str(x).strip().splitlines()[0][:600]
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
    print("wrong:", bad)
