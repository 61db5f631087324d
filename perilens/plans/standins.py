"""The library's tables as views of the star-schema test tables: each as a DataFrame and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One SQL text for both engines where they agree; it names only tables of the test data.
SQL = {
    "institution": """SELECT c_custkey AS id, c_name AS name, r_name AS county, n_name AS district, c_mktsegment AS ownership, c_acctbal AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "penalty": """SELECT o_orderkey AS id, o_custkey AS institution_id, CAST(o_orderdate AS DATE) AS penalty_date, o_orderpriority AS rule,
        o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS fine_amount FROM orders""",
    "report": """SELECT event_id AS id, user_id AS institution_id, ts AS created_at, value,
        CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'submitted' WHEN 'signup' THEN 'investigating' WHEN 'purchase' THEN 'closed' ELSE 'rejected' END AS status,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('staff', CAST(user_id % 7 AS VARCHAR(9))) END AS assignee FROM events""",
    "scan": """SELECT event_id AS id, user_id AS institution_id, ts AS finished_at, CAST(floor(value) AS DOUBLE) AS opinion_score,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'searching' END AS status FROM events""",
    "review": """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS institution_id, l_partkey AS place_id, l_linenumber AS rating, l_returnflag AS author,
        CAST(l_shipdate AS DATE) AS publish_date, l_quantity AS helpful FROM lineitem""",
    "panel": """SELECT s.id, s.county, p.year, p.personnel_actual, p.personnel_budget, p.material_actual, p.material_budget, p.students, p.teachers, p.leavers, p.overtime, p.misconduct_reports FROM
        (SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INT) AS year,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS personnel_actual,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS personnel_budget,
            CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS material_actual,
            CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE) AS material_budget,
            CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS students, CAST(count(*) AS DOUBLE) AS teachers,
            CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS leavers,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_tax AS DECIMAL(4, 2))) AS DOUBLE) AS overtime,
            CAST(nullif(sum(CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS misconduct_reports
         FROM lineitem GROUP BY l_suppkey, year(l_shipdate)) p
        JOIN (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE r_name END AS county FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) s
        ON s.id = p.id WHERE (p.id + p.year) % 13 <> 0""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view, or a test table itself; columns and filters reach the scan."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace("VARCHAR(9)", "STRING")
    used = [t for t in TABLES if t in text]
    return spark.sql(_bound(text, used), args={}, **{t: view(spark, sf_dir, t) for t in used})


def _bound(text: str, tables: list[str]) -> str:
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return text


def sql(query: str, *views: str) -> str:
    """A DuckDB query with the stand-in views that it uses in front."""
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    head = f"WITH {ctes} " if ctes else ""
    body = query.strip()
    if body.upper().startswith("WITH "):
        return f"{head.rstrip()}, {body[5:]}" if head else body
    return head + body


def section() -> tuple[dict, dict, object]:
    """Two registries and the decorator that fills them: ``@query(oracle_sql, *views)`` on a query function."""
    queries, oracle = {}, {}

    def query(text: str | None = None, *views: str):
        def add(f):
            queries[f.__name__] = f
            if text:
                oracle[f.__name__] = sql(text, *views)
            return f

        return add

    return queries, oracle, query


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, -0 as 0, so that another summation order gives the same row."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
