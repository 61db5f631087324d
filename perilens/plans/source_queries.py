"""Queries of files, run logs, archives and live gates, and of the small functions that only other queries used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilens.functions import scalars as S
from perilens.functions import text as T
from perilens.functions.udfs import compact_exact
from perilens.operators import linkage as K
from perilens.operators import opinion as O
from perilens.operators.rounds import drop_folder, shared_folder, written
from perilens.sources import sinks, statements
from perilens.sources.directory import read_table
from perilens.streaming import jobs

from .standins import section, view

QUERIES, ORACLE, query = section()

ENDINGS = ("_113學年度收支餘絀表.csv", "_資產負債表.csv", "_現金流量表.csv", "_附表二_1.csv", "_附表三_1.csv", "_附表四_1.csv", "_驗證_附表四_1.csv", "_other.csv")


@query(
    f"""WITH p AS (SELECT p_partkey, 'root/113學年度/N01' || p_name || [{", ".join(f"'{e}'" for e in ENDINGS)}][1 + p_partkey % 8] AS path FROM part)
    SELECT p_partkey, path, CASE p_partkey % 8 WHEN 0 THEN 'income' WHEN 1 THEN 'balance' WHEN 2 THEN 'cash' WHEN 3 THEN 'appendix2' WHEN 4 THEN 'appendix3' WHEN 5 THEN 'appendix4' END AS kind FROM p"""
)
def a1_statement_scan(spark: SparkSession, d: str) -> DataFrame:
    """A1's rule over a table of paths: the first pattern decides, names to skip and others have no kind."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    paths = view(spark, d, "part").select("p_partkey", F.concat(F.lit("root/113學年度/N01"), "p_name", ending).alias("path"))
    return paths.select("p_partkey", "path", statements.kind_of(F.col("path")).alias("kind"))


def _statement_files(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a statement file, one after the other of five kinds; headers differ in order, in columns more or less and in a byte
    order mark, and every eleventh file is cut off within a quote."""
    k, line = F.col("l_orderkey"), lambda *cells: F.concat_ws(",", *cells)
    item, value, wide = F.concat(F.lit("m"), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string"), F.lit('"1,000"')
    forms = [
        ("_113學年度收支餘絀表.csv", "科目,金額", line(item, value)),
        ("_資產負債表.csv", "\ufeff金額,年度類別,科目", line(value, F.when(F.col("l_linenumber") % 2 == 0, "前一年度").otherwise("本年度"), item)),
        ("_現金流量表.csv", "頁碼,項目,113學年度金額,112學年度金額", line(F.lit("1"), item, value, F.lit("7"))),
        ("_附表二_1.csv", "差異率,項目", line(F.lit("-"), item)),
        ("_附表四_1.csv", "帳面價值,財產名稱", line(wide, item)),
    ]
    pick = lambda i: F.coalesce(*[F.when(k % 5 == n, F.lit(f[i]) if isinstance(f[i], str) else f[i]) for n, f in enumerate(forms)])
    rows = view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pick(2).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n")
    files = rows.groupBy("l_orderkey").agg(body.alias("body")).withColumns({"head": pick(1), "ending": pick(0)})
    path = F.concat(F.lit("in/113學年度/N"), k.cast("string"), F.lit("甲"), "ending")
    text = F.concat("head", F.lit("\n"), "body", F.when(k % 11 == 0, '\n"cut').otherwise(""))
    return files.select(path.alias("path"), statements.kind_of(path).alias("kind"), text.cast("binary").alias("content"))


LINE_SQL = "SELECT l_orderkey AS k, 'N' || l_orderkey AS code, 'm' || l_linenumber AS m, CAST(l_partkey AS DOUBLE) AS v, l_linenumber AS n FROM lineitem WHERE l_orderkey % 11 <> 0"


@query(
    f"""WITH x AS ({LINE_SQL}) SELECT code, '甲' AS name, 113 AS year, "table", metric, value, category FROM (
        SELECT code, '收支餘絀表' AS "table", m AS metric, v AS value, 'income' AS category FROM x WHERE k % 5 = 0
        UNION ALL SELECT code, '資產負債表', m, v, 'other' FROM x WHERE k % 5 = 1 AND n % 2 = 1
        UNION ALL SELECT code, '現金流量表', m, v, 'other' FROM x WHERE k % 5 = 2
        UNION ALL SELECT code, '附表二', m || unnest(['-actual', '-rate']), NULL, 'other' FROM x WHERE k % 5 = 3
        UNION ALL SELECT code, '附表四', 'rows', CAST(count(*) AS DOUBLE), 'other' FROM x WHERE k % 5 = 4 GROUP BY code
        UNION ALL SELECT code, '附表四', 'book_value', 1000.0 * count(*), 'other' FROM x WHERE k % 5 = 4 GROUP BY code)"""
)
def a3_statement_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose headers differ, each read by its own."""
    return statements.long_rows(statements.parsed(statements.keyed(_statement_files(spark, d)))).drop("source")


@query("SELECT 'in/113學年度/N' || l_orderkey || '甲' || ['_113學年度收支餘絀表.csv', '_資產負債表.csv', '_現金流量表.csv', '_附表二_1.csv', '_附表四_1.csv'][1 + l_orderkey % 5] AS path FROM lineitem WHERE l_orderkey % 11 = 0 GROUP BY l_orderkey")
def a1_bad_files(spark: SparkSession, d: str) -> DataFrame:
    """A1: the files that can't be parsed are listed, and the others' rows stay."""
    return statements.bad_files(statements.parsed(_statement_files(spark, d))).select("path")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def a14_table_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/supplier.parquet").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("SELECT 'load' AS job, 'success' AS status, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM orders")
def b15_run_log(spark: SparkSession, d: str) -> DataFrame:
    """A write's counts, taken while it runs, as one row of the log."""
    path = f"{shared_folder(spark)}/run_log_{uuid.uuid4().hex}"
    status = F.col("o_orderstatus")
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    sinks.logged(spark, "load", view(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"done": status == "F", "skipped": status == "P"}, write, path)
    log = spark.read.parquet(path)
    out = written(log.select("job", "status", "total", F.col("counts")["done"].alias("done"), F.col("counts")["skipped"].alias("skipped")))
    drop_folder(spark, path)
    return out


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS payloads, CAST(sum(length(props)) AS BIGINT) AS characters FROM events GROUP BY 1, 2")
def b19_archive(spark: SparkSession, d: str) -> DataFrame:
    """Raw payloads by source and day, and what the archive then holds."""
    path = f"{shared_folder(spark)}/archive_{uuid.uuid4().hex}"
    payloads = view(spark, d, "events").select("props", "event_type", F.to_date("ts").alias("day"))
    sinks.archive(payloads, path, "event_type", "day")
    held = spark.read.schema("props string, event_type string, day date").json(path)
    out = written(held.groupBy("event_type", "day").agg(F.count("*").alias("payloads"), F.sum(F.length("props")).alias("characters")))
    drop_folder(spark, path)
    return out


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 'ok' AS status FROM events GROUP BY 1")
def b3_slice_export(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each value, put in its place when it is whole, and what the folders then hold."""
    path = f"{shared_folder(spark)}/export_{uuid.uuid4().hex}"
    status = sinks.export_slices(view(spark, d, "events").select("event_type", "event_id"), path, "event_type")
    held = spark.read.schema("event_id long, event_type string").json(path)
    said = spark.createDataFrame(sorted(status.items()), "event_type string, status string")
    out = written(held.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).join(said, "event_type"))
    drop_folder(spark, path)
    return out.select("event_type", "n", "ids", "status")


@query("SELECT l_orderkey, l_linenumber, least(greatest(round(l_quantity * 3 - 20, 2), 0.0), 100.0) AS score FROM lineitem")
def i13_clamped_score(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp(F.col("l_quantity") * 3 - 20).alias("score"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', '', 'g')) || 'abc1台' AS quick, lower(regexp_replace(p_name, '\\s+', '', 'g')) || 'abc1台' AS exact FROM part")
def i15_compact_names(spark: SparkSession, d: str) -> DataFrame:
    """Full-width letters, spaces and 臺 fold alike in SQL and by the exact rule."""
    name = F.concat("p_name", F.lit("\u3000ＡＢ ｃ１臺"))
    return view(spark, d, "part").select("p_partkey", T.compact(name).alias("quick"), compact_exact(name).alias("exact"))


@query(
    """WITH c AS (SELECT institution_id, count(*) AS n, sum(CASE WHEN status = 'closed' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN status = 'submitted' THEN 1 ELSE 0 END) AS a,
    array_to_string(list_sort(list(DISTINCT CASE WHEN status = 'closed' THEN coalesce(assignee, 'nobody') END)), ', ') AS tags FROM report GROUP BY 1)
    SELECT institution_id, CASE WHEN c = 0 AND a = 0 THEN CAST(n AS VARCHAR) || ' items, none about this institution.' ELSE CAST(n AS VARCHAR) || ' items, ' || CAST(c AS VARCHAR) || ' confirmed, ' || CAST(a AS VARCHAR) || ' to be checked'
    || CASE WHEN coalesce(tags, '') <> '' THEN '; tags: ' || tags ELSE '' END || '.' END AS summary FROM c""",
    "report",
)
def i39_summary(spark: SparkSession, d: str) -> DataFrame:
    """The rule-based sentence from counts and names."""
    closed = F.col("status") == "closed"
    c = view(spark, d, "report").groupBy("institution_id").agg(
        F.count("*").alias("n"), F.count_if(closed).alias("c"), F.count_if(F.col("status") == "submitted").alias("a"), F.collect_set(F.when(closed, F.coalesce("assignee", F.lit("nobody")))).alias("tags")
    )
    return c.select("institution_id", O.summary(F.col("n"), F.col("c"), F.col("a"), F.col("tags")).alias("summary"))


@query("SELECT institution_id, count(*) AS reports, CAST(sum(CASE WHEN status = 'closed' THEN 1 ELSE 0 END) AS BIGINT) AS closed FROM report WHERE institution_id IN (SELECT institution_id FROM report WHERE status = 'investigating') GROUP BY 1", "report")
def k2_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of K2: only institutions that a change names are counted anew."""
    reports = view(spark, d, "report")
    counts = lambda ids: reports.join(ids, "institution_id", "left_semi").groupBy("institution_id").agg(F.count("*").alias("reports"), F.count_if(F.col("status") == "closed").alias("closed"))
    return jobs.rescored(reports.where("status = 'investigating'"), "institution_id", counts)


@query("SELECT user_id, CAST(sum(s) AS BIGINT) AS entries, CAST(sum(s * event_id) AS BIGINT) AS total FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS s FROM events WHERE user_id IS NOT NULL) GROUP BY 1 HAVING sum(s) > 0")
def k2_score_sums(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of K2's kept sums: every event is a signed change, errors are retractions."""
    changes = view(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"))
    return jobs.summed(changes, "user_id", "sign", ["event_id"]).where("entries > 0").withColumnRenamed("event_id", "total")


@query(
    """SELECT id, institution_id, CASE WHEN epoch_us(t1) - epoch_us(t0) < 518400000000 THEN 'cooldown' ELSE 'start' END AS decision FROM (SELECT id, institution_id, created_at AS t1,
    max(CASE WHEN status = 'closed' THEN created_at END) OVER (PARTITION BY institution_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0 FROM report)""",
    "report",
)
def k4_cooldown_gate(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of K4: the gate over the whole log of requests."""
    requests = view(spark, d, "report").select("id", "institution_id", F.col("created_at").cast("timestamp").alias("at"), F.when(F.col("status") == "closed", "done").otherwise("queued").alias("status"))
    return jobs.gated(requests, "institution_id", 6 * 86_400)


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 AND (c_custkey % 101) / 100.0 >= 0.95 THEN 'AUTO_ACCEPT' WHEN c_custkey % 3 = 0 AND (c_custkey % 101) / 100.0 >= 0.3 THEN 'DISTRICT_MISMATCH'
    WHEN (c_custkey % 101) / 100.0 >= 0.8 THEN 'MANUAL_REVIEW' ELSE 'REJECTED' END AS status FROM customer"""
)
def l6_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The status ladder with other thresholds than the usual ones."""
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 101) / 100.0).alias("score"), F.when(F.col("c_custkey") % 3 == 0, "elsewhere").otherwise(F.concat("c_mktsegment", F.lit(" road"))).alias("address"), "c_mktsegment")
    return c.select("id", K.match_status(F.col("score"), F.col("c_mktsegment"), F.col("address"), auto=0.95, manual=0.8, plausible=0.3).alias("status"))
