"""Queries of whole jobs and the remaining small rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilens.functions import scalars as S
from perilens.functions import text as T
from perilens.operators import linkage as K
from perilens.operators import listing as L
from perilens.operators import opinion as O
from perilens.operators import panel, quality, upsert
from perilens.sources import payloads as P
from perilens.sources import statements

from .standins import section, view

QUERIES, ORACLE, query = section()


@query("SELECT rating, count(*) AS n, count(*) FILTER (rating BETWEEN 1 AND 5) AS valid, count(*) FILTER (trim(CAST(rating AS VARCHAR)) IN ('1', '2', '3', '4', '5')) AS valid_text FROM review GROUP BY 1", "review")
def c11_valid_ratings(spark: SparkSession, d: str) -> DataFrame:
    text = S.rating_from_text(F.concat(F.lit(" "), F.col("rating").cast("string")))
    return view(spark, d, "review").groupBy("rating").agg(F.count("*").alias("n"), F.count_if(S.rating_valid("rating")).alias("valid"), F.count_if(text.isNotNull()).alias("valid_text"))


@query(
    """SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')) AS flagged FROM orders GROUP BY 1"""
)
def c15_flagged_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Array elements of a level of 2 or more."""
    score = F.when(F.col("o_orderstatus") == "F", 3).otherwise(1)
    one = view(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(score).alias("score"))
    g = one.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("key"), "score"))).alias("indicators"))
    hit = F.transform(F.filter("indicators", lambda x: x["score"] >= 2), lambda x: x["key"])
    return g.select("o_custkey", F.when(F.size(hit) > 0, hit).alias("flagged"))


STATEMENT_SQL = """SELECT code, name, year, '收支餘絀表' AS "table", metric, value, 'income' AS category FROM (SELECT 'N' || s AS code, b AS name, 113 AS year, CASE WHEN k % 10 = 0 THEN '' ELSE 'm' || k % 4 END AS metric, CAST(k AS DOUBLE) AS value FROM x) WHERE metric <> ''
    UNION ALL SELECT 'N' || s, b, 113, '資產負債表', 'm' || k % 4, -CAST(k AS DOUBLE), 'other' FROM x WHERE k % 3 <> 1
    UNION ALL SELECT 'N' || s, b, 113, '現金流量表', 'm' || k % 4, CAST(k AS DOUBLE), 'other' FROM x
    UNION ALL SELECT 'N' || s, b, 113, '附表二', 'm' || k % 4 || '-actual', CAST(k AS DOUBLE), 'other' FROM x UNION ALL SELECT 'N' || s, b, 113, '附表二', 'm' || k % 4 || '-rate', NULL, 'other' FROM x
    UNION ALL SELECT 'N' || s, b, 113, '附表四', 'rows', CAST(count(*) AS DOUBLE), 'other' FROM x GROUP BY s, b UNION ALL SELECT 'N' || s, b, 113, '附表四', 'book_value', CAST(sum(CASE WHEN k % 3 = 1 THEN 0 ELSE k END) AS DOUBLE), 'other' FROM x GROUP BY s, b"""


@query(f"WITH x AS (SELECT p_size AS s, p_brand AS b, p_partkey AS k FROM part) SELECT code, name, year, \"table\", metric, count(*) AS n, count(value) AS n_values, sum(value) AS total FROM ({STATEMENT_SQL}) GROUP BY 1, 2, 3, 4, 5")
def m1_long_table(spark: SparkSession, d: str) -> DataFrame:
    """Raw statement rows of five kinds reshaped to the long table."""
    k = F.col("p_partkey")
    raw = view(spark, d, "part").select(
        F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("code"), F.col("p_brand").alias("name"), F.lit(113).alias("year"), F.concat("p_size", F.lit(".csv")).alias("source"),
        F.concat(F.lit("m"), (k % 4).cast("string")).alias("項目"), F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("m"), (k % 4).cast("string"))).alias("科目"), k.cast("string").alias("金額"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "前一年度").otherwise("本年度").alias("年度類別"), k.cast("string").alias("113學年度金額"), k.cast("string").alias("決算數"), F.lit("-").alias("差異率"),
        F.when(k % 3 == 1, "abc").otherwise(k.cast("string")).alias("帳面價值"),
    )
    balance = statements.balance(raw.withColumns({"金額": F.concat(F.lit("("), "金額", F.lit(")")), "科目": F.col("項目")}))
    parts = [statements.income(raw), balance, statements.cash_flow(raw), statements.appendix2(raw), statements.appendix4(raw.withColumn("source", F.lit("one")))]
    long = reduce(DataFrame.unionByName, parts).where("code is not null")
    return long.groupBy("code", "name", "year", "table", "metric").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"))


@query("SELECT o_custkey AS id, len(list(o_orderkey)) AS n, list_sort(list(o_orderkey))[1] AS first_key FROM orders GROUP BY 1")
def a10_json_lists(spark: SparkSession, d: str) -> DataFrame:
    """A10: a list under data, result or records, whichever a payload has, exploded again."""
    g = view(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"))).alias("rows"))
    name = F.when(F.col("o_custkey") % 3 == 0, F.to_json(F.struct(F.col("rows").alias("data")))).when(F.col("o_custkey") % 3 == 1, F.to_json(F.struct(F.col("rows").alias("records")))).otherwise(F.to_json("rows"))
    rows = "array<struct<k:long>>"
    body = g.select(F.col("o_custkey").alias("id"), name.alias("body"))
    wrapped = F.from_json("body", f"data {rows}, result {rows}, records {rows}")
    found = F.when(F.col("body").startswith("["), F.from_json("body", rows)).otherwise(F.coalesce(wrapped["data"], wrapped["result"], wrapped["records"]))
    return body.select("id", F.explode(found).alias("r")).groupBy("id").agg(F.count("*").alias("n"), F.min("r.k").alias("first_key"))


@query("SELECT doc_id, 'http://base#' || sha1(text) AS url FROM documents WHERE contains(text, 'idiot') OR contains(text, 'licen')")
def a19_announcements(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "documents").select(F.col("doc_id").alias("DOC_ID"), F.col("text").alias("Subject"), F.lit(" ").alias("Attachment"))
    return P.announcements(df, "subject", ("idiot", "licen"), "http://base").select("doc_id", "url")


@query("SELECT page_id, count(*) AS n_rows, CAST(sum(len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS n_cells FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 6 GROUP BY 1")
def a24_html_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells per row of a page's grid (menus rewritten as one table row behind a header), short rows dropped."""
    grid = F.concat(F.lit("<tr><th>h</th></tr><tr>"), F.array_join(F.transform(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1)), lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    rows = P.grid_rows(view(spark, d, "pages").select("page_id", grid.alias("g")), "page_id", "g", 6)
    return rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))


@query("SELECT c_custkey, replace(replace(c_name, '#', '\\#'), '.', '\\.') AS escaped, c_custkey % 7 = 0 OR contains(c_name, '9') AS confirmed FROM customer")
def i22_i40_small_rules(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "customer")
    hit = O.attribution(F.col("c_custkey") % 7 == 0, F.col("c_name").contains("9")) == "confirmed"
    return c.select("c_custkey", T.escape_markdown("c_name").alias("escaped"), hit.alias("confirmed"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey || '國小' END AS school, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey || '國小附設幼兒園' ELSE 'S' || s_suppkey || '幼兒園' END AS own FROM supplier")
def i28_name_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("[01]S"), k.cast("string"), F.when(k % 2 == 0, "國小附設幼兒園").otherwise("幼兒園"))
    return view(spark, d, "supplier").select("s_suppkey", T.name_parts(name).alias("p")).select("s_suppkey", "p.school", "p.own")


INGEST_SQL = """WITH i AS (SELECT doc_id, source, lang, text, contains(text, 'MIT') AS alias FROM documents WHERE contains(text, 'Licen') OR contains(text, 'licen')),
    g AS (SELECT *, CASE WHEN contains(text, 'idiot') THEN 25.0 ELSE 0.0 END + CASE WHEN contains(text, 'Apache') THEN 10.0 ELSE 0.0 END AS risk FROM i WHERE alias OR lang = 'en'),
    u AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM g) SELECT doc_id, source, risk FROM u WHERE k = 1"""


@query(INGEST_SQL)
def m6_item_ingest(spark: SparkSession, d: str) -> DataFrame:
    """M6: gate, tags, score, and insert under a unique hash."""
    rules = {"insult": (25, ("idiot",)), "licence": (10, ("Apache",))}
    gate = O.relevance(F.col("text"), F.col("text").contains("MIT"), F.col("lang") == "en", F.lit(True), ("licen", "Licen"), ())
    items = view(spark, d, "documents").withColumn("r", gate).where("r.relevant")
    items = items.withColumns({"risk": O.item_score(T.rule_tags("text", rules), rules), "h": F.sha2(F.col("text").cast("binary"), 256)})
    return upsert.insert_ignore(items.limit(0), items, ["h"], "doc_id").select("doc_id", "source", "risk")


@query(
    """WITH x AS (SELECT c_custkey AS k, trim(c_name) AS name, 'N' || c_nationkey % 3 AS address, CASE WHEN c_custkey % 4 = 3 THEN 'PRIVATE' ELSE 'PUBLIC' END AS t FROM customer),
    y AS (SELECT *, row_number() OVER (PARTITION BY left(name, 15), address ORDER BY k) AS dup FROM x)
    SELECT CASE WHEN t = 'PRIVATE' THEN 'not_public:private' WHEN dup > 1 THEN 'duplicate' ELSE 'valid' END AS outcome, count(*) AS n FROM y GROUP BY 1"""
)
def m7_directory_import(spark: SparkSession, d: str) -> DataFrame:
    """M7: ownership class, validity, duplicates by name and address kept as rejects with their reason."""
    from pyspark.sql import Window

    k = F.col("c_custkey")
    field = F.when(k % 4 == 3, "私立").otherwise("公立")
    x = view(spark, d, "customer").select(k.alias("k"), F.trim("c_name").alias("name"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string")).alias("address"), T.ownership(field, names=["c_name"]).alias("t"))
    reason = quality.valid_record(F.col("t"), F.lit(True), F.col("address"))
    again = F.row_number().over(Window.partitionBy(F.left("name", F.lit(15)), "address").orderBy("k")) > 1
    x = x.withColumn("again", again)
    return x.groupBy(F.coalesce(reason, F.when(F.col("again"), "duplicate"), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """SELECT (SELECT count(*) FROM customer) AS institutions, count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) AS accepted, count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) AS rejected FROM events"""
)
def m9_master_build(spark: SparkSession, d: str) -> DataFrame:
    """M9: upsert of the directory, referential filter of its children, and the audit counts."""
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    directory = upsert.overwrite(c.where("id % 2 = 0"), c.where("id % 3 <> 0"), ["id"]).unionByName(c.where("id % 2 = 1 and id % 3 = 0"))
    parents = c.where("id % 3 <> 0").select(F.col("id").alias("user_id"))
    events = view(spark, d, "events")
    counts = L.by_keys(events, parents, ["user_id"]).agg(F.count("*").alias("accepted")).join(L.pending(events, parents, ["user_id"]).agg(F.count("*").alias("rejected")))
    return directory.agg(F.count_distinct("id").alias("institutions")).join(counts)


@query(
    """WITH a AS (SELECT DISTINCT s_name AS alias FROM supplier), m AS (SELECT alias, min(s_suppkey) AS id FROM a JOIN supplier ON starts_with(s_name, alias) GROUP BY alias HAVING count(*) = 1)
    SELECT m.id, p.year, round(p.personnel_actual / nullif(p.students, 0), 2) AS cost, CASE WHEN p.personnel_actual > p.personnel_budget THEN 'high' ELSE '' END AS direction FROM m JOIN panel p ON p.id = m.id WHERE p.year >= 2000""",
    "panel",
)
def m13_finance_load(spark: SparkSession, d: str) -> DataFrame:
    """Scores joined to institutions by unique name prefix, direction codes to labels."""
    s = view(spark, d, "supplier")
    names = s.select(F.col("s_name").alias("alias")).distinct()
    found = K.unique_prefix(names, s.select("s_name", "s_suppkey"), "alias", "s_name", "s_suppkey", width=18).select(F.col("s_suppkey").alias("id"))
    codes = F.when(F.col("personnel_actual") > F.col("personnel_budget"), "HIGH+x").otherwise("y")
    p = view(spark, d, "panel").where("year >= 2000").join(found, "id")
    return p.select("id", "year", F.round(S.safe_divide("personnel_actual", "students"), 2).alias("cost"), S.direction_labels(codes).alias("direction"))


@query("SELECT id, name, district FROM institution WHERE county = 'ASIA'", "institution")
def b1_export_columns(spark: SparkSession, d: str) -> DataFrame:
    """What an export of a partition holds: listed columns in order, helper and raw columns left out."""
    df = view(spark, d, "institution").withColumns({"raw_json": F.lit("{}"), "_helper": F.lit(1)})
    return L.known_columns(L.equals(df, county="ASIA"), ["id", "name", "district", "_helper"])


@query("SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY 1")
def h9_distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    """H9: ordered distinct values of a short array."""
    g = view(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderpriority")).alias("all"))
    return g.select("id", F.array_distinct("all").alias("tags"))


@query("SELECT p.id, p.year, round(p.overtime, 4) AS overtime, o.leavers FROM panel p LEFT JOIN (SELECT id, year, leavers FROM panel WHERE id % 3 = 0) o ON o.id = p.id AND o.year = p.year", "panel")
def d9_left_merge(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "panel")
    return panel.merge_metrics(p.select("id", "year", F.round("overtime", 4).alias("overtime")), p.where("id % 3 = 0").select("id", "year", "leavers"), ["id", "year"], "left")
