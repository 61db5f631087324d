"""Queries of lists, counts, joins and the risk index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilens.functions import scalars as S
from perilens.operators import aggregate as A
from perilens.operators import listing as L
from perilens.operators import riskindex

from .standins import rounded, section, view

QUERIES, ORACLE, query = section()
SORTS = {"name": "name", "balance": "balance", "district": "district"}
OWNERSHIPS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "AUTOMOBILE")
STATUSES = ("submitted", "investigating", "closed", "rejected")


@query(
    "SELECT id, name, county, district, ownership FROM institution WHERE county = 'ASIA' AND contains(name, '00') AND ownership = 'BUILDING' ORDER BY balance DESC NULLS LAST, id LIMIT 20 OFFSET 20",
    "institution",
)
def c1_institution_list(spark: SparkSession, d: str) -> DataFrame:
    """Scope, optional filters, whitelisted sort, second page."""
    df = L.scoped(view(spark, d, "institution"), "staff", "ASIA", "EUROPE")
    df = L.allowed_or_any(L.contains(df, "00", "name"), "ownership", "BUILDING", OWNERSHIPS)
    return L.paged(df, L.order_columns("balance", "desc", SORTS, "name", "id"), "2", None).select("id", "name", "county", "district", "ownership")


@query("SELECT id, name, balance FROM institution ORDER BY balance DESC NULLS LAST, id LIMIT 20 OFFSET 40", "institution")
def g2_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page by the token of the second one; no page reads those before it."""
    df, order, token = view(spark, d, "institution").select("id", "name", "balance"), [("balance", True), ("id", False)], None
    for _ in range(2):
        token = L.token_of(L.page_after(df, order, 20, token), order)
        if token is None:
            return df.limit(0)
    return L.page_after(df, order, 20, token)


@query(
    """SELECT p.id, p.penalty_date, round(p.fine_amount, 2) AS fine_amount, i.name, i.county FROM penalty p LEFT JOIN institution i ON p.institution_id = i.id
    WHERE p.fine_amount > 0 AND p.penalty_date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' AND i.county = 'EUROPE'""",
    "penalty",
    "institution",
)
def c2_penalty_filter(spark: SparkSession, d: str) -> DataFrame:
    """A malformed day would count as not given."""
    p = L.between_days(view(spark, d, "penalty").where("fine_amount > 0"), "penalty_date", "1997-03-01", "1997-06-30")
    i = view(spark, d, "institution").select(F.col("id").alias("institution_id"), "name", "county", "district")
    out = L.equals(p.join(i, "institution_id", "left"), county="EUROPE", district="")
    return out.select("id", "penalty_date", F.round("fine_amount", 2).alias("fine_amount"), "name", "county")


@query(
    """SELECT r.id, r.status, r.assignee, i.name FROM report r JOIN institution i ON r.institution_id = i.id WHERE r.status IN ('submitted', 'closed') AND r.assignee IS NULL
    AND r.created_at >= TIMESTAMP '2024-01-05' AND r.created_at < TIMESTAMP '2024-01-21' AND (contains(i.name, '1') OR contains(r.status, 'sub'))""",
    "report",
    "institution",
)
def c3_report_filter(spark: SparkSession, d: str) -> DataFrame:
    """Status whitelist, unassigned, keyword in either text, whole days."""
    r = L.one_of(view(spark, d, "report"), "status", ["submitted", "closed", "pending", "x"], STATUSES)
    r = L.between_days(L.assigned_to(r, "assignee", "unassigned"), "created_at", "2024-01-05", "2024-01-20")
    i = view(spark, d, "institution").select(F.col("id").alias("institution_id"), "name")
    return L.contains(r.join(i, "institution_id"), "1", "name").unionByName(L.contains(r.join(i, "institution_id").where(~F.col("name").contains("1")), "sub", "status")).select("id", "status", "assignee", "name")


@query("SELECT id, status FROM report WHERE status IN ('submitted', 'investigating', 'closed', 'rejected') AND assignee = 'staff3'", "report")
def c4_status_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """No valid status asked for: all public ones."""
    return L.assigned_to(L.one_of(view(spark, d, "report"), "status", ["nonsense"], STATUSES), "assignee", "staff3").select("id", "status")


@query("SELECT count(*) AS own, (SELECT count(*) FROM institution) AS everything, CAST(0 AS BIGINT) AS nobody FROM institution WHERE county = 'AFRICA'", "institution")
def c5_county_scope(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "institution")
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(L.scoped(df, "staff", "AFRICA", "ASIA"), "own").join(n(L.scoped(df, "admin", None, None), "everything")).join(n(L.scoped(df, "staff", None, "ASIA"), "nobody"))


@query("SELECT id, name, district FROM institution WHERE contains(name, '77') OR contains(district, '_1') ORDER BY id LIMIT 100", "institution")
def c6_directory_search(spark: SparkSession, d: str) -> DataFrame:
    return L.contains(view(spark, d, "institution"), "77", "name").unionByName(L.contains(view(spark, d, "institution").where(~F.col("name").contains("77")), "_1", "district")).select("id", "name", "district").orderBy("id").limit(100)


@query("SELECT id, county, district FROM institution WHERE ownership = 'HOUSEHOLD' AND id NOT IN (SELECT institution_id FROM penalty WHERE status = 'F')", "institution", "penalty")
def c8_pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Selected rows whose key isn't in the done set, known columns only."""
    done = view(spark, d, "penalty").where("status = 'F'").select(F.col("institution_id").alias("id"))
    out = L.pending(L.equals(view(spark, d, "institution"), ownership="HOUSEHOLD"), done, ["id"])
    return L.known_columns(out.withColumn("_note", F.lit(1)), ["id", "county", "district", "_note", "absent"])


@query(
    """SELECT institution_id, CAST(count(*) AS BIGINT) AS n, max(created_at) AS last_reply, min(id) AS first_id FROM report WHERE status <> 'pending' AND institution_id IN (SELECT id FROM institution WHERE county = 'ASIA') GROUP BY institution_id""",
    "report",
    "institution",
)
def c19_c20_threads(spark: SparkSession, d: str) -> DataFrame:
    """Visible messages of a key set as threads in time order, summarised."""
    keys = L.equals(view(spark, d, "institution"), county="ASIA").select(F.col("id").alias("institution_id"))
    rows = L.by_keys(view(spark, d, "report").where("status <> 'pending'"), keys, ["institution_id"])
    t = L.thread(rows, "institution_id", ["created_at", "id"], "status")
    least = F.array_min(F.transform("messages", lambda m: m["id"]))
    return t.select("institution_id", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["created_at"].alias("last_reply"), least.alias("first_id"))


@query(
    "SELECT i.id, i.name, coalesce(c.n, 0) AS attachments, c.last_reply FROM institution i LEFT JOIN (SELECT institution_id, count(*) AS n, max(created_at) AS last_reply FROM report GROUP BY 1) c ON c.institution_id = i.id",
    "institution",
    "report",
)
def d3_child_counts(spark: SparkSession, d: str) -> DataFrame:
    aggregates = F.count("*").alias("attachments"), F.max("created_at").alias("last_reply")
    out = A.with_children(view(spark, d, "institution"), view(spark, d, "report"), "id", "institution_id", *aggregates, zero=["attachments"])
    return out.select("id", "name", "attachments", "last_reply")


@query("SELECT institution_id, id, finished_at, opinion_score FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY id DESC) AS k FROM scan WHERE status = 'done') WHERE k = 1", "scan")
def d4_last_done_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(view(spark, d, "scan"), ["institution_id"], "id", "finished_at", "opinion_score", where=F.col("status") == "done")


SIGNALS_SQL = """f AS (SELECT id AS institution_id, CAST(id % 40 AS DOUBLE) AS finance_index FROM institution WHERE id % 4 <> 0),
    sig AS (SELECT i.id, i.county, f.finance_index, coalesce(r.o, 0) AS open_reports, coalesce(r.t, 0) AS total_reports, s.opinion_score, coalesce(p.n, 0) AS penalty_count, coalesce(p.fines, 0) AS fine_total
    FROM institution i LEFT JOIN f ON f.institution_id = i.id
    LEFT JOIN (SELECT institution_id, count(*) FILTER (status IN ('submitted', 'investigating')) AS o, count(*) FILTER (status <> 'pending') AS t FROM report GROUP BY 1) r ON r.institution_id = i.id
    LEFT JOIN (SELECT institution_id, max_by(opinion_score, id) AS opinion_score FROM scan WHERE status = 'done' GROUP BY 1) s ON s.institution_id = i.id
    LEFT JOIN (SELECT institution_id, count(*) AS n, sum(fine_amount) AS fines FROM penalty GROUP BY 1) p ON p.institution_id = i.id)"""
SCORED_SQL = (
    SIGNALS_SQL
    + """, dims AS (SELECT *, CASE WHEN finance_index IS NOT NULL THEN least(greatest(round(finance_index * 4.0, 2), 0), 100) END AS a, CASE WHEN open_reports > 0 THEN 100.0 ELSE 0.0 END AS b, CASE WHEN opinion_score IS NOT NULL THEN least(greatest(round(opinion_score * 2.5, 2), 0), 100) END AS c,
        CASE WHEN fine_total > 100000 THEN 100.0 WHEN penalty_count > 0 THEN 50.0 ELSE 0.0 END AS e FROM sig),
    w AS (SELECT *, (CASE WHEN a IS NULL THEN 0.75 ELSE 0 END + CASE WHEN c IS NULL THEN 0.5 ELSE 0 END) / CAST(2 + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS share FROM dims),
    scored AS (SELECT *, least(greatest(round((coalesce(a, 0) * CASE WHEN a IS NULL THEN 0 ELSE round(0.75 + share, 4) END + b * round(1.0 + share, 4) + coalesce(c, 0) * CASE WHEN c IS NULL THEN 0 ELSE round(0.5 + share, 4) END
        + e * round(0.75 + share, 4)) / 3.0, 2), 0), 100) AS risk_score FROM w)"""
)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "institution").select("id", "county")
    finance = i.where("id % 4 <> 0").select(F.col("id").alias("institution_id"), (F.col("id") % 40).cast("double").alias("finance_index"))
    return riskindex.signals(i, finance, view(spark, d, "report"), view(spark, d, "scan"), view(spark, d, "penalty"))


@query(f"WITH {SIGNALS_SQL} SELECT id, county, finance_index, open_reports, total_reports, opinion_score, penalty_count, round(fine_total, 2) AS fine_total FROM sig", "institution", "report", "scan", "penalty")
def d5_signals(spark: SparkSession, d: str) -> DataFrame:
    """D5, E4, E5."""
    return _signals(spark, d).select("id", "county", "finance_index", "open_reports", "total_reports", "opinion_score", "penalty_count", F.round("fine_total", 2).alias("fine_total"))


@query(
    f"""WITH {SCORED_SQL} SELECT id, round(a, 2) AS finance_score, b AS parent_report_score, round(c, 2) AS opinion_score_, e AS compliance_score, CASE WHEN a IS NULL THEN 0 ELSE round(0.75 + share, 4) END AS finance_weight,
    round(1.0 + share, 4) AS parent_report_weight, round(risk_score, 1) AS risk_score, CASE WHEN risk_score >= 65 THEN 'high' WHEN risk_score >= 45 THEN 'medium' ELSE 'normal' END AS risk_level FROM scored""",
    "institution",
    "report",
    "scan",
    "penalty",
)
def m4_risk_index(spark: SparkSession, d: str) -> DataFrame:
    """M4: D5, E26, E27, E28."""
    out = riskindex.scored(_signals(spark, d).withColumnRenamed("opinion_score", "opinion_raw"), {**riskindex.dimension_scores(), "opinion": F.when(F.col("opinion_raw").isNotNull(), S.clamp(F.col("opinion_raw") * 2.5))})
    return out.select(
        "id", "finance_score", "parent_report_score", F.col("opinion_score").alias("opinion_score_"), "compliance_score", "finance_weight", "parent_report_weight", F.round("risk_score", 1).alias("risk_score"), "risk_level"
    )


@query(f"WITH {SCORED_SQL} SELECT CASE WHEN risk_score >= 65 THEN 'high' WHEN risk_score >= 45 THEN 'medium' ELSE 'normal' END AS risk_level, count(*) AS n FROM scored GROUP BY 1", "institution", "report", "scan", "penalty")
def e28_level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return m4_risk_index(spark, d).groupBy("risk_level").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT id, round(risk_score, 1) AS risk_score FROM scored WHERE risk_score > 0 ORDER BY round(risk_score, 1) DESC, id LIMIT 15", "institution", "report", "scan", "penalty")
def g4_riskiest(spark: SparkSession, d: str) -> DataFrame:
    return m4_risk_index(spark, d).where("risk_score > 0").orderBy(F.desc("risk_score"), "id").limit(15).select("id", "risk_score")


@query("SELECT count(*) AS total, (SELECT count(*) FROM institution) AS everything FROM institution WHERE contains(name, '5')", "institution")
def e1_filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "institution").agg(F.count_if(F.col("name").contains("5")).alias("total"), F.count("*").alias("everything"))


@query("SELECT county, count(*) AS n FROM institution WHERE trim(county) <> '' GROUP BY 1 ORDER BY n DESC, county", "institution")
def e2_by_county(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(view(spark, d, "institution"), "county").orderBy(F.desc("n"), "county")


@query("SELECT CAST(year(penalty_date) AS VARCHAR) AS academic_year, count(*) AS n FROM penalty GROUP BY 1 ORDER BY CAST(academic_year AS INT) DESC", "penalty")
def e3_by_year(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "penalty").withColumn("academic_year", F.year("penalty_date").cast("string"))
    return A.count_by(df, "academic_year").orderBy(F.col("academic_year").try_cast("int").desc())


@query("SELECT institution_id, count(*) AS n, round(coalesce(sum(fine_amount), 0), 2) AS total FROM penalty GROUP BY 1", "penalty")
def e4_penalty_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.total_and_sum(view(spark, d, "penalty"), ["institution_id"], "fine_amount"), 2)


@query("SELECT institution_id, count(*) FILTER (status IN ('submitted', 'investigating')) AS open_reports, count(*) FILTER (status <> 'pending') AS total_reports FROM report GROUP BY 1", "report")
def e5_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return A.conditional_counts(view(spark, d, "report"), ["institution_id"], {"open_reports": s.isin(*riskindex.OPEN_STATUSES), "total_reports": s != "pending"})


@query(
    """SELECT d.status, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total FROM (VALUES ('submitted'), ('investigating'), ('closed'), ('rejected'), ('archived')) d(status)
    LEFT JOIN (SELECT status, count(*) AS n FROM report GROUP BY 1) r ON r.status = d.status""",
    "report",
)
def e6_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every status with zeros, and the grand total beside it."""
    statuses = spark.createDataFrame([(s,) for s in (*STATUSES, "archived")], "status string")
    out = A.completed(statuses, A.count_by(view(spark, d, "report"), "status"), ["status"], {"n": 0})
    return out.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("SELECT i.district, count(*) AS n FROM review r JOIN (SELECT s_suppkey AS id, n_name AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey) i ON i.id = r.institution_id GROUP BY 1", "review")
def e7_reviews_by_district(spark: SparkSession, d: str) -> DataFrame:
    return A.count_by(view(spark, d, "review").join(_suppliers(spark, d), "institution_id"), "district")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    nation = view(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("district"))
    return view(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("institution_id"), "district", F.col("s_name").alias("name"))


@query(
    f"""SELECT institution_id, {', '.join(f'count(*) FILTER (rating = {k}) AS star_{k}' for k in range(1, 6))}, round(sum(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END) / CAST(nullif(count(CASE WHEN rating BETWEEN 1 AND 5 THEN 1 END), 0) AS DOUBLE), 6) AS mean_rating
    FROM review GROUP BY 1""",
    "review",
)
def e8_star_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Invalid ratings count nowhere."""
    return rounded(view(spark, d, "review").groupBy("institution_id").agg(*A.star_counts("rating"), A.star_mean("rating").alias("mean_rating")), 6)


@query("SELECT coalesce(CASE WHEN id % 9 = 0 THEN NULL ELSE district END, 'unknown') AS district, count(*) AS n FROM institution WHERE ownership <> 'MACHINERY' GROUP BY 1", "institution")
def e12_district_breakdown(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "institution").where("ownership <> 'MACHINERY'").withColumn("district", F.coalesce(F.when(F.col("id") % 9 != 0, F.col("district")), F.lit("unknown")))
    return A.count_by(df, "district")


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def e13_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.table_counts({t: view(spark, d, t) for t in ("orders", "events", "documents")})


@query("SELECT text AS key_text, count(*) AS n, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def e30_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_groups(view(spark, d, "documents"), ["text"], "doc_id").withColumnRenamed("text", "key_text")


@query("SELECT place_id, count(DISTINCT institution_id) AS n, min(institution_id) AS first_member, max(institution_id) AS last_member FROM review GROUP BY 1 HAVING count(DISTINCT institution_id) > 1", "review")
def e30_duplicate_places(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_groups(view(spark, d, "review"), ["place_id"], "institution_id", distinct=True)


@query("SELECT count(DISTINCT o_custkey) AS institutions, count(DISTINCT year(o_orderdate)) AS years, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders")
def e31_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "orders")
    return df.agg(F.count_distinct("o_custkey").alias("institutions"), F.count_distinct(F.year("o_orderdate")).alias("years"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))


@query("SELECT institution_id, max(finished_at) AS last_seen, min(finished_at) AS first_seen FROM scan GROUP BY 1", "scan")
def e32_first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scan").groupBy("institution_id").agg(F.max("finished_at").alias("last_seen"), F.min("finished_at").alias("first_seen"))


@query("SELECT institution_id, id, rating, helpful FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY helpful DESC NULLS LAST, id) AS k FROM (SELECT DISTINCT * FROM review)) WHERE k = 1", "review")
def f9_best_row(spark: SparkSession, d: str) -> DataFrame:
    best = L.best_per(view(spark, d, "review").distinct(), ["institution_id"], [F.desc_nulls_last("helpful"), F.asc("id")])
    return best.select("institution_id", "id", "rating", "helpful")


@query("SELECT institution_id, rule, status, id FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, rule ORDER BY id DESC) AS k FROM penalty) WHERE k = 1", "penalty")
def f10_last_status(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(view(spark, d, "penalty"), ["institution_id", "rule"], "id", "status")


@query(
    """SELECT institution_id, max(id) AS last_id, max_by(status, id) AS last_status, CASE WHEN max_by(status, id) <> 'done' THEN max(id) FILTER (status = 'done') END AS last_done_id FROM scan GROUP BY 1""",
    "scan",
)
def f11_latest_and_latest_done(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "scan").groupBy("institution_id").agg(F.max("id").alias("last_id"), F.max_by("status", "id").alias("last_status"), F.max(F.when(F.col("status") == "done", F.col("id"))).alias("done"))
    return g.select("institution_id", "last_id", "last_status", F.when(F.col("last_status") != "done", F.col("done")).alias("last_done_id"))


@query(
    """SELECT id, institution_id, CASE WHEN last_done IS NULL THEN 'start' WHEN date_diff('second', last_done, finished_at) < 600 THEN 'cooldown' ELSE 'start' END AS decision FROM
    (SELECT *, max(CASE WHEN status = 'done' THEN finished_at END) OVER (PARTITION BY institution_id ORDER BY finished_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_done FROM
     (SELECT id, institution_id, status, date_trunc('second', finished_at) AS finished_at FROM scan))""",
    "scan",
)
def f13_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """A request is refused if the last done scan of its institution ended less than 600 s before."""
    w = Window.partitionBy("institution_id").orderBy("finished_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    df = view(spark, d, "scan").withColumn("finished_at", F.date_trunc("second", "finished_at"))
    df = df.withColumn("last_done", F.max(F.when(F.col("status") == "done", F.col("finished_at"))).over(w))
    waited = F.unix_timestamp("finished_at") - F.unix_timestamp("last_done")
    return df.select("id", "institution_id", F.when(waited < 600, "cooldown").otherwise("start").alias("decision"))


@query("SELECT id, status, value FROM report ORDER BY CASE status WHEN 'submitted' THEN 1 WHEN 'investigating' THEN 2 WHEN 'closed' THEN 3 ELSE 0 END, value DESC, created_at DESC, id DESC LIMIT 40", "report")
def g3_custom_order(spark: SparkSession, d: str) -> DataFrame:
    order = [L.custom_order("status", ["submitted", "investigating", "closed"]), F.desc("value"), F.desc("created_at"), F.desc("id")]
    return L.paged(view(spark, d, "report"), order, 1, 40).select("id", "status", "value")


@query("SELECT institution_id, id, penalty_date FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY penalty_date DESC, id DESC) AS k FROM penalty) WHERE k <= 10", "penalty")
def g5_latest_ten(spark: SparkSession, d: str) -> DataFrame:
    return L.top_per(view(spark, d, "penalty"), ["institution_id"], [F.desc("penalty_date"), F.desc("id")], 10).select("institution_id", "id", "penalty_date")


@query(
    """SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS tags, round(max(o_totalprice), 2) AS risk FROM orders GROUP BY 1 ORDER BY risk DESC, o_custkey LIMIT 100"""
)
def g8_items_by_risk(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"), F.round(F.max("o_totalprice"), 2).alias("risk"))
    return g.orderBy(F.desc("risk"), "o_custkey").limit(100)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d14_referential_filter(spark: SparkSession, d: str) -> DataFrame:
    parents = view(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return L.by_keys(view(spark, d, "events"), parents, ["user_id"]).select("event_id", "user_id")


@query("SELECT count(*) AS orphans, count(DISTINCT user_id) AS parents FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def d15_orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    orphans = L.pending(view(spark, d, "events"), view(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), ["user_id"])
    return orphans.agg(F.count("*").alias("orphans"), F.count_distinct("user_id").alias("parents"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def a15_newest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "orders").withColumn("academic_year", F.year("o_orderdate").cast("string"))
    return A.newest_snapshot(df, "academic_year").select("o_orderkey", "o_orderstatus")
