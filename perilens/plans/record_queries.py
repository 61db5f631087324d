"""Queries of writes, linkage, master statistics, quality and sources (A-, B-, C17, C18, D6, D7, D13, D18, D21, D22, E9, E10, E14, E34, Q-, K-, M6-M13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilens.functions import scalars as S
from perilens.functions import text as T
from perilens.operators import linkage as K
from perilens.operators import master, quality, upsert
from perilens.sources import payloads as P
from perilens.sources import sinks, statements
from perilens.sources.directory import overrides, pick
from perilens.streaming import jobs

from .standins import rounded, section, view

QUERIES, ORACLE, query = section()


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))


def _old(spark, d):
    return upsert.last_per_key(_orders(spark, d).where("v % 3 = 0"), ["id"], "v").withColumn("created", F.col("v"))


def _new(spark, d):
    return upsert.last_per_key(_orders(spark, d).where("v % 3 = 1"), ["id"], "v").withColumn("created", F.col("v"))


STATES_SQL = """o AS (SELECT o_custkey AS id, o_orderkey AS v, o_orderstatus AS status, o_orderpriority AS note FROM orders),
    old AS (SELECT id, max(v) AS v, max_by(status, v) AS status, max_by(note, v) AS note, max(v) AS created FROM o WHERE v % 3 = 0 GROUP BY id),
    new AS (SELECT id, max(v) AS v, max_by(status, v) AS status, max_by(note, v) AS note, max(v) AS created FROM o WHERE v % 3 = 1 GROUP BY id)"""


@query(f"WITH {STATES_SQL} SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v, coalesce(n.status, o.status) AS status, coalesce(n.note, o.note) AS note, coalesce(o.created, n.created) AS created FROM old o FULL JOIN new n ON n.id = o.id")
def b5_upsert(spark: SparkSession, d: str) -> DataFrame:
    return upsert.overwrite(_old(spark, d), _new(spark, d), ["id"], keep=["created"]).select("id", "v", "status", "note", "created")


@query(f"WITH {STATES_SQL} SELECT coalesce(o.id, n.id) AS id, coalesce(o.v, n.v) AS v, coalesce(n.status, o.status) AS status, coalesce(o.note, n.note) AS note, coalesce(o.created, n.created) AS created FROM old o FULL JOIN new n ON n.id = o.id")
def b7_partial_upsert(spark: SparkSession, d: str) -> DataFrame:
    return upsert.overwrite_some(_old(spark, d), _new(spark, d), ["id"], ["status"]).select("id", "v", "status", "note", "created")


@query(
    """WITH h AS (SELECT *, sha256(text) AS h FROM documents), o AS (SELECT h, min(doc_id) AS f, max(doc_id) AS l FROM h WHERE doc_id % 2 = 0 GROUP BY h), n AS (SELECT h, min(doc_id) AS f, max(doc_id) AS l FROM h WHERE doc_id % 2 = 1 GROUP BY h)
    SELECT coalesce(o.h, n.h) AS content_hash, coalesce(o.f, n.f) AS first_seen_at, greatest(o.l, n.l) AS last_seen_at FROM o FULL JOIN n ON n.h = o.h"""
)
def b6_k1_seen_again(spark: SparkSession, d: str) -> DataFrame:
    """B6 and the batch twin of K1: a known hash only moves its last time."""
    h = view(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    seen = lambda rows: rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_seen_at"), F.max("doc_id").alias("last_seen_at"))
    return upsert.touch(seen(h.where("doc_id % 2 = 0")), seen(h.where("doc_id % 2 = 1")), "content_hash", "first_seen_at", "last_seen_at")


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, sha256(text) AS h, left(text, 40) AS title FROM documents),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM t WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM t WHERE doc_id % 2 = 0 AND h IS NOT NULL) AND title NOT IN (SELECT title FROM t WHERE doc_id % 2 = 0 AND title IS NOT NULL)),
    r AS (SELECT CAST(0 AS BIGINT) AS k, [CAST('' AS VARCHAR)] AS hs, [CAST('' AS VARCHAR)] AS ts, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS VARCHAR) AS title
    UNION ALL SELECT n.k, CASE WHEN list_contains(hs, n.h) OR list_contains(ts, 't' || n.title) THEN hs ELSE list_append(hs, n.h) END, CASE WHEN list_contains(hs, n.h) OR list_contains(ts, 't' || n.title) THEN ts ELSE list_append(ts, 't' || n.title) END,
    CASE WHEN list_contains(hs, n.h) OR list_contains(ts, 't' || n.title) THEN NULL ELSE n.doc_id END, n.h, n.title FROM r JOIN n ON n.k = r.k + 1)
    SELECT doc_id, h, title FROM r WHERE doc_id IS NOT NULL"""
)
def b8_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """New rows go in by id unless they clash with the table or with one that went in."""
    rows = view(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.left("text", F.lit(40)).alias("title"))
    return upsert.insert_ignore(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["h", "title"], "doc_id")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F') UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F'")
def b9_replace_slice(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 2 = 1 and o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("new"))
    return upsert.replace_slice(o.where("o_orderkey % 2 = 0"), new, ["o_custkey"])


@query("SELECT o_orderkey, true AS resolved FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 2 = 1")
def b10_replace_open(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("resolved"))
    return upsert.replace_open(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumn("resolved", F.lit(False)))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal IS NULL)")
def b16_cascade(spark: SparkSession, d: str) -> DataFrame:
    _, children = upsert.cascade(view(spark, d, "customer"), view(spark, d, "events"), "c_custkey", "user_id", F.col("c_mktsegment") == "BUILDING")
    return children.select("event_id", "user_id")


@query("SELECT s.id, coalesce(u.status, s.status) AS status, CASE WHEN u.id IS NULL THEN 1 ELSE 2 END AS attempts FROM (SELECT c_custkey AS id, 'NEW' AS status FROM customer) s LEFT JOIN (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'DONE' END AS status FROM events) u ON u.id = s.id")
def b17_attempts(spark: SparkSession, d: str) -> DataFrame:
    state = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("status"), F.lit(1).alias("attempts"))
    updates = view(spark, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "DONE").alias("status")).distinct()
    return upsert.with_attempts(state, updates, "id", ["status"])


@query("SELECT c_custkey AS id, CASE WHEN e.user_id IS NULL THEN 'NO_MATCH' ELSE 'MATCHED' END AS status, CASE WHEN e.user_id IS NULL THEN 0.0 ELSE 1.0 END AS score FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = c_custkey")
def b18_sentinels(spark: SparkSession, d: str) -> DataFrame:
    customers = view(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    matches = view(spark, d, "events").select(F.col("user_id").alias("id")).distinct().join(customers, "id", "left_semi").withColumns({"status": F.lit("MATCHED"), "score": F.lit(1.0)})
    return upsert.sentinels(customers, matches, "id", {"status": "NO_MATCH", "score": 0.0})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_acctbal DESC, c_custkey LIMIT 50)")
def b20_scope_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A report's selection, kept as one row of ids (its limit is the feature), restricts later rows."""
    chosen = view(spark, d, "customer").where("c_mktsegment = 'FURNITURE'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("o_custkey"))
    return upsert.in_scope(view(spark, d, "orders"), upsert.scope_snapshot(chosen, "o_custkey", {"segment": "FURNITURE"}), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT institution_id, max(created_at) AS created_at, max_by(status, created_at) AS status, count(*) AS entries FROM report GROUP BY 1", "report")
def k3_states(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of K3: current state by the event log."""
    return upsert.latest_state(view(spark, d, "report"), "institution_id", "created_at", "status").select("institution_id", "created_at", "status", "entries")


@query("SELECT doc_id, reason, CASE WHEN reason IS NULL THEN lang END AS lang FROM (SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 400 THEN 'short' END AS reason FROM documents)")
def b11_b12_split(spark: SparkSession, d: str) -> DataFrame:
    """Valid and rejected rows with their own columns, put together again with all of them."""
    reason = F.when(F.col("lang") != "en", "language").when(F.col("n_chars") < 400, "short")
    valid, rejected = sinks.split(view(spark, d, "documents").withColumn("reason", reason), "reason", ["doc_id", "lang"], ["doc_id", "reason"])
    return sinks.rejects(valid, rejected).select("doc_id", "reason", "lang")


@query(
    """WITH t AS (SELECT min(c_custkey) AS cid, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2, 3, 4), loose AS (SELECT regexp_replace(c_name, '[\\s()]', '', 'g') AS bare, c_mktsegment, min(cid) AS cid FROM t GROUP BY 1, 2),
    r AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' ()' ELSE c_name END AS c_name, c_mktsegment, c_nationkey FROM customer)
    SELECT r.row_id, coalesce(a.cid, b.cid) AS cid FROM r LEFT JOIN t a ON a.c_name = r.c_name AND a.c_mktsegment = r.c_mktsegment AND a.c_nationkey = r.c_nationkey LEFT JOIN loose b ON b.bare = regexp_replace(r.c_name, '[\\s()]', '', 'g') AND b.c_mktsegment = r.c_mktsegment"""
)
def d6_two_stage_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    table = c.where("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "cid")
    rows = c.select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(" ()"))).otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment", "c_nationkey")
    return K.lookup(rows, table, ["c_nationkey", "c_mktsegment", "c_name"], ["c_mktsegment"], "c_name", "cid").select("row_id", "cid")


@query(
    """WITH a AS (SELECT DISTINCT left(c_name, CAST(15 + c_custkey % 4 AS INT)) AS alias FROM customer) SELECT alias, min(c_custkey) AS c_custkey FROM a JOIN customer ON starts_with(c_name, alias) GROUP BY alias HAVING count(*) = 1"""
)
def d7_unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "customer")
    names = c.select(F.expr("left(c_name, int(15 + c_custkey % 4))").alias("alias")).distinct()
    return K.unique_prefix(names, c.select("c_name", "c_custkey"), "alias", "c_name", "c_custkey", width=15)


PAIRS_SQL = """pairs AS (SELECT i.id, i.name, i.district, i.district || ' road ' || (i.id % 9) AS address, p.c_custkey AS place_id, p.c_name AS place_name, CASE WHEN p.c_custkey % 5 = 0 THEN 'elsewhere' ELSE n.n_name || ' road ' || (p.c_custkey % 9) END AS place_address
    FROM (SELECT s_suppkey AS id, s_name AS name, n_name AS district, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) i JOIN customer p ON p.c_nationkey = i.s_nationkey JOIN nation n ON n.n_nationkey = p.c_nationkey)"""


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("district"))
    i = view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).join(n, "nation")
    i = i.withColumn("address", F.concat("district", F.lit(" road "), (F.col("id") % 9).cast("string")))
    p = view(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("place_name"), F.col("c_nationkey").alias("nation"))
    p = p.join(n.withColumnRenamed("district", "_n"), "nation")
    p = p.withColumn("place_address", F.when(F.col("place_id") % 5 == 0, "elsewhere").otherwise(F.concat("_n", F.lit(" road "), (F.col("place_id") % 9).cast("string")))).drop("_n")
    return i, p


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    i, p = _both(spark, d)
    return i.join(p, "nation")


CHARS = "list_distinct(string_split({x}, ''))"


@query(
    f"""WITH {PAIRS_SQL}, s AS (SELECT *, CAST(len(list_intersect({CHARS.format(x='name')}, {CHARS.format(x='place_name')})) AS DOUBLE) / greatest(len({CHARS.format(x='name')}), len({CHARS.format(x='place_name')})) AS ns,
        CASE WHEN contains(address, place_address) OR contains(place_address, address) THEN 1.0 ELSE 0.0 END AS a, CASE WHEN contains(place_address, district) THEN 1.0 ELSE 0.0 END AS g FROM pairs),
    t AS (SELECT *, round(ns * 0.5 + a * 0.35 + g * 0.15, 4) AS m FROM s)
    SELECT id, place_id, m AS match_score, CASE WHEN m >= 0.88 AND contains(place_address, district) THEN 'AUTO_ACCEPT' WHEN NOT contains(place_address, district) AND m >= 0.5 THEN 'DISTRICT_MISMATCH' WHEN m >= 0.72 THEN 'MANUAL_REVIEW' ELSE 'REJECTED' END AS match_status
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m DESC, ns DESC, place_id) AS k FROM t WHERE m >= 0.45) WHERE k = 1"""
)
def d13_simple_matching(spark: SparkSession, d: str) -> DataFrame:
    """Pairs blocked by nation, scored in SQL by classes of like rows, best of each."""
    return K.best_matches_simple(*_both(spark, d), ["nation"], "id", "place_id", 0.45).select("id", "place_id", "match_score", "match_status")


@query()
def m8_place_matching(spark: SparkSession, d: str) -> DataFrame:
    """M8: D13 with the full scorer (I31), then manual overrides."""
    none = F.lit(None).cast("double")
    i, p = _both(spark, d)
    best = K.best_place_matches(i.withColumns({"lat": none, "lng": none}), p.withColumns({"place_lat": none, "place_lng": none}), ["nation"], "id", "place_id")
    best = best.select("id", "place_id", "match_score", "match_status")
    manual = view(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("id"), F.lit(0).cast("long").alias("place_id"))
    return K.overridden(best, manual, "id", ["place_id"])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE s_nationkey END AS place_id, CASE WHEN s_suppkey % 10 = 0 THEN 'MANUAL_OVERRIDE' ELSE 'AUTO_ACCEPT' END AS match_status FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 10 = 0")
def d21_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The last valid line of an id replaces the automatic match."""
    s = view(spark, d, "supplier")
    auto = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("place_id"), F.lit("AUTO_ACCEPT").alias("match_status"))
    lines = s.where("s_suppkey % 10 = 0").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.col("s_suppkey").cast("string").alias("id"))
    lines = lines.withColumn("place_id", F.when(F.col("line") == 2, "-1").otherwise("7")).union(spark.createDataFrame([(9, "x1", "5")], "line int, id string, place_id string"))
    manual = overrides(lines, "id", "line", ["place_id"]).select("id", F.col("place_id").cast("long").alias("place_id"))
    return K.overridden(auto, manual, "id", ["place_id"]).select("id", "place_id", "match_status")


@query(
    """WITH o AS (SELECT c_name AS name, c_nationkey AS city, count(*) AS n, first(c_custkey) AS id, first(c_mktsegment) AS phone FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2)
    SELECT c_name AS name, CASE WHEN o.n = 1 THEN o.id END AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '!' END, CASE WHEN o.n = 1 THEN o.phone END) AS phone, CASE WHEN o.n = 1 THEN ['old', 'new'] ELSE ['new'] END AS sources FROM customer LEFT JOIN o ON o.name = c_name AND o.city = c_nationkey"""
)
def d18_directory_merge(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("city"), F.col("c_mktsegment").alias("phone"))
    old = c.where("id % 3 <> 0").withColumn("sources", F.array(F.lit("old")))
    new = c.withColumn("phone", F.when(F.col("id") % 2 == 0, F.concat("phone", F.lit("!"))).otherwise(" ")).withColumn("sources", F.array(F.lit("new")))
    return K.merged_directory(old, new, ["name", "city"], "id", ["phone"], "sources").select("name", "id", "phone", "sources")


@query("SELECT c.c_custkey AS id, s.item, coalesce(o.level, 'N/A') AS level, coalesce(o.score, 0) AS score FROM customer c, (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) s(item) LEFT JOIN (SELECT o_custkey, o_orderpriority AS item, max(o_orderstatus) AS level, CAST(count(*) AS BIGINT) AS score FROM orders GROUP BY 1, 2) o ON o.o_custkey = c.c_custkey AND o.item = s.item")
def d22_catalogue_fill(spark: SparkSession, d: str) -> DataFrame:
    stored = view(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("item")).agg(F.max("o_orderstatus").alias("level"), F.count("*").alias("score"))
    items = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "item string")
    return K.catalogue_filled(view(spark, d, "customer").select(F.col("c_custkey").alias("id")), items, stored, ["id"], "item", "level", "score").select("id", "item", "level", "score")


INST_SQL = "inst AS (SELECT s_suppkey AS id, s_name AS name, n_name AS district, s_acctbal > 2000 AS is_public FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
PLACES_SQL = """places AS (SELECT l_suppkey AS institution_id, l_partkey AS place_id, max(n_name) AS district, max(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 10 END) AS rating, CAST(sum(l_linenumber) AS BIGINT) AS rating_count, max(l_discount) AS match_score,
    CASE WHEN max(l_returnflag) = 'A' THEN 'AUTO_ACCEPT' ELSE 'REJECTED' END AS match_status FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"""


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("district"))
    return view(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "district", (F.col("s_acctbal") > 2000).alias("is_public"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    where = _institutions(spark, d).select(F.col("id").alias("institution_id"), "district")
    g = view(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("institution_id"), F.col("l_partkey").alias("place_id")).agg(
        F.max(F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 10)).alias("rating"), F.sum("l_linenumber").alias("rating_count"), F.max("l_discount").alias("match_score"),
        F.when(F.max("l_returnflag") == "A", "AUTO_ACCEPT").otherwise("REJECTED").alias("match_status"),
    )
    return g.join(where, "institution_id")


STARS = ", ".join(f"count(*) FILTER (rating = {k}) AS star_{k}" for k in range(1, 6))


@query(
    f"""WITH {INST_SQL}, {PLACES_SQL}, d AS (SELECT n_name AS district FROM nation UNION ALL SELECT 'NOWHERE'), i AS (SELECT district, count(*) AS n FROM inst WHERE is_public GROUP BY 1),
    p AS (SELECT district, count(*) AS n, CAST(sum(rating_count) AS BIGINT) AS rc, avg(rating) AS r FROM places WHERE match_status = 'AUTO_ACCEPT' GROUP BY 1),
    r AS (SELECT district, count(*) AS n, avg(rating) AS m, {STARS} FROM review JOIN inst ON inst.id = review.institution_id GROUP BY 1)
    SELECT d.district, coalesce(i.n, 0) AS public_count, coalesce(p.n, 0) AS matched_count, greatest(0, coalesce(i.n, 0) - coalesce(p.n, 0)) AS unmatched_count, coalesce(p.rc, 0) AS place_review_count, round(p.r, 2) AS mean_place_rating, coalesce(r.n, 0) AS review_count, round(r.m, 2) AS mean_rating,
    {', '.join(f'coalesce(r.star_{k}, 0) AS star_{k}' for k in range(1, 6))} FROM d LEFT JOIN i ON i.district = d.district LEFT JOIN p ON p.district = d.district LEFT JOIN r ON r.district = d.district""",
    "review",
)
def e9_district_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every district, with zeros for an empty one."""
    i = _institutions(spark, d)
    districts = view(spark, d, "nation").select(F.col("n_name").alias("district")).union(spark.createDataFrame([("NOWHERE",)], "district string"))
    reviews = view(spark, d, "review").join(i.select(F.col("id").alias("institution_id"), "district"), "institution_id")
    return master.district_statistics(districts, i, _places(spark, d), reviews)


@query(
    f"""WITH {INST_SQL}, {PLACES_SQL}, b AS (SELECT institution_id, place_id, match_score, rating FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY match_score DESC, place_id) AS k FROM places WHERE match_status = 'AUTO_ACCEPT') WHERE k = 1),
    r AS (SELECT institution_id, count(*) AS n, avg(rating) AS m, min(publish_date) AS f, max(publish_date) AS l, {STARS} FROM review GROUP BY 1)
    SELECT inst.id, name, district, b.place_id, b.match_score, b.rating AS place_rating, coalesce(r.n, 0) AS review_count, round(r.m, 2) AS mean_rating, f AS first_review, l AS last_review, {', '.join(f'coalesce(r.star_{k}, 0) AS star_{k}' for k in range(1, 6))}
    FROM inst LEFT JOIN b ON b.institution_id = inst.id LEFT JOIN r ON r.institution_id = inst.id""",
    "review",
)
def e10_institution_statistics(spark: SparkSession, d: str) -> DataFrame:
    return master.institution_statistics(_institutions(spark, d), _places(spark, d), view(spark, d, "review"))


QUALITY_SQL = f"""WITH {INST_SQL}, x AS (SELECT id, CASE WHEN id % 17 = 0 THEN '' ELSE district END AS district, CASE WHEN id % 13 = 0 THEN NULL ELSE name END AS address, is_public, CASE id % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PUBLIC' ELSE 'NONPROFIT' END AS own_class, 20.0 + id % 4 AS lat, 121.0 AS lng FROM inst)
    SELECT own_class || '_CONTAMINATION' AS issue_type, 'CRITICAL' AS severity, CAST(id AS VARCHAR) AS entity_id, district, own_class AS raw_value FROM x WHERE is_public AND own_class <> 'PUBLIC'
    UNION ALL SELECT 'MISSING_DISTRICT', 'HIGH', CAST(id AS VARCHAR), district, district FROM x WHERE district = ''
    UNION ALL SELECT 'INVALID_DISTRICT', 'HIGH', CAST(id AS VARCHAR), district, district FROM x WHERE district <> '' AND district IN ('NATION_3', 'NATION_4')
    UNION ALL SELECT 'MISSING_ADDRESS', 'WARNING', CAST(id AS VARCHAR), district, NULL FROM x WHERE address IS NULL
    UNION ALL SELECT 'INVALID_COORDINATE', 'WARNING', CAST(id AS VARCHAR), district, CAST(lat AS VARCHAR) || ',' || CAST(lng AS VARCHAR) FROM x WHERE lat < 21
    UNION ALL SELECT 'DISTRICT_MISMATCH', 'WARNING', CAST(id AS VARCHAR), district, address FROM x WHERE district <> '' AND address IS NOT NULL AND id % 3 <> 0
    UNION ALL SELECT 'DUPLICATE_REVIEW', 'INFO', CAST(min(id) AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) FROM review GROUP BY place_id, institution_id, rating HAVING count(*) > 1
    UNION ALL SELECT 'INVALID_RATING', 'HIGH', CAST(id AS VARCHAR), NULL, CAST(rating AS VARCHAR) FROM review WHERE rating > 5
    UNION ALL SELECT 'MISSING_PLACE', 'INFO', CAST(id AS VARCHAR), district, NULL FROM x WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    x = _institutions(spark, d).select(
        "id", F.when(i % 17 == 0, "").otherwise(F.col("district")).alias("district"), F.when(i % 13 != 0, F.col("name")).alias("address"), "is_public",
        F.when(i % 4 == 0, "PRIVATE").when(i % 4 == 1, "PUBLIC").otherwise("NONPROFIT").alias("own_class"), (F.lit(20.0) + i % 4).alias("lat"), F.lit(121.0).alias("lng"), F.when(i % 3 == 0, "PENDING").otherwise("AUTO_ACCEPT").alias("status"),
    )
    reviews = view(spark, d, "review")
    listed = [f"NATION_{k}" for k in range(25) if k not in (3, 4)]
    done = view(spark, d, "orders").where("o_orderstatus = 'F'")
    return quality.together(
        [
            quality.contamination(x, "is_public", "own_class", "id", "district"), quality.missing(x, "district", "MISSING_DISTRICT", "HIGH", "id", "district"), quality.invalid_district(x, "district", listed, "id"),
            quality.missing(x, "address", "MISSING_ADDRESS", "WARNING", "id", "district"), quality.invalid_coordinates(x, "lat", "lng", "id", "district"), quality.district_mismatch(x, "district", "address", "status", "id"),
            quality.duplicates(reviews, ["place_id", "institution_id", "rating"], "DUPLICATE_REVIEW", "INFO", "id"), quality.invalid_rating(reviews, "rating", "id"), quality.missing_match(x, done, "o_custkey", "id", "district"),
        ]
    )


@query(QUALITY_SQL, "review")
def m10_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    """H8, M10, Q1-Q8."""
    return _issues(spark, d)


@query(f"SELECT severity, issue_type, count(*) AS n FROM ({QUALITY_SQL.replace(f'WITH {INST_SQL}, x AS', 'WITH inst AS (SELECT s_suppkey AS id, s_name AS name, n_name AS district, s_acctbal > 2000 AS is_public FROM supplier JOIN nation ON s_nationkey = n_nationkey), x AS')}) GROUP BY 1, 2", "review")
def g6_severity_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Issues by severity from the gravest on."""
    return _issues(spark, d).groupBy("severity", "issue_type").agg(F.count("*").alias("n")).orderBy(quality.severity_rank(F.col("severity")), "issue_type")


@query(f"WITH {INST_SQL} SELECT count(*) AS total, count(*) FILTER (district = 'NATION_1') AS bad_district, count(*) FILTER (NOT is_public) AS not_public, count(*) FILTER (district = 'NATION_1') > 0 OR count(*) FILTER (NOT is_public) > 0 AS failed FROM inst")
def q9_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(_institutions(spark, d), {"bad_district": F.col("district") == "NATION_1", "not_public": ~F.col("is_public")})


@query(
    """WITH p AS (SELECT id, year, personnel_actual AS a, material_actual AS b, CASE WHEN id % 3 = 0 THEN personnel_actual + coalesce(material_actual, 0) ELSE personnel_actual END AS total FROM panel)
    SELECT id, year, 'assets' AS rule, round(coalesce(a, 0) + coalesce(b, 0), 2) AS left_side, round(total, 2) AS right_side, CASE WHEN abs(coalesce(a, 0) + coalesce(b, 0) - total) < 0.005 THEN 'pass' ELSE 'differs' END AS result FROM p
    UNION ALL SELECT id, year, 'equity', round(coalesce(a, 0), 2), round(total, 2), CASE WHEN abs(coalesce(a, 0) - total) < 0.005 THEN 'pass' ELSE 'differs' END FROM p""",
    "panel",
)
def q10_identities(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d, "panel").withColumn("total", F.when(F.col("id") % 3 == 0, F.col("personnel_actual") + F.coalesce("material_actual", F.lit(0.0))).otherwise(F.col("personnel_actual")))
    return rounded(quality.identities(df, ["id", "year"], {"assets": (["personnel_actual", "material_actual"], "total"), "equity": (["personnel_actual"], "total")}), 2)


@query(
    """WITH l AS (SELECT o_custkey, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'income total' WHEN 1 THEN 'expense total' ELSE 'surplus of the year' END AS name, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders)
    SELECT o_custkey, count(amount) = count(*) AS all_parse, count(*) FILTER (contains(name, 'surplus')) > 0 AS has_surplus, CASE WHEN count(*) FILTER (contains(name, 'income')) > 0 AND count(*) FILTER (contains(name, 'expense')) > 0 AND count(*) FILTER (contains(name, 'surplus')) > 0 THEN coalesce(abs(coalesce(arg_min_null(amount, seq) FILTER (contains(name, 'income')), 0) - coalesce(arg_min_null(amount, seq) FILTER (contains(name, 'expense')), 0) - arg_min_null(amount, seq) FILTER (contains(name, 'surplus'))) < 0.005, false) END AS balanced FROM l GROUP BY 1"""
)
def q11_statement_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "income total").when(k % 3 == 1, "expense total").otherwise("surplus of the year")
    df = view(spark, d, "orders").select("o_custkey", k.alias("seq"), name.alias("name"), F.when(k % 50 != 0, F.col("o_totalprice")).alias("amount"))
    return quality.statement_checks(df, ["o_custkey"], "name", "amount", "seq")


@query(
    """WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PUBLIC_ATTACHED' WHEN 2 THEN 'PRIVATE' END AS t, CASE WHEN c_custkey % 5 = 0 THEN 'Other City' ELSE '' END AS raw, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'road in NATION_' || c_nationkey END AS address, CASE WHEN c_custkey % 6 = 0 THEN 'NATION_1' END AS district FROM customer),
    y AS (SELECT *, CASE WHEN district = 'NATION_1' THEN true WHEN contains(raw, 'Other City') THEN false ELSE contains(address, 'NATION_1') OR contains(address, 'NATION_2') END AS inside FROM x),
    z AS (SELECT *, CASE WHEN coalesce(t, 'UNKNOWN') NOT IN ('PUBLIC', 'PUBLIC_ATTACHED') THEN 'not_public:' || lower(coalesce(t, 'UNKNOWN')) WHEN NOT inside THEN 'other_city' WHEN trim(address) = '' THEN 'missing_address' END AS reason FROM y)
    SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM z GROUP BY 1"""
)
def e14_validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Decision per record and counts per reason."""
    k = F.col("c_custkey")
    x = view(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, "PUBLIC").when(k % 4 == 1, "PUBLIC_ATTACHED").when(k % 4 == 2, "PRIVATE").alias("t"), F.when(k % 5 == 0, "Other City").otherwise("").alias("raw"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("road in NATION_"), F.col("c_nationkey").cast("string"))).alias("address"), F.when(k % 6 == 0, "NATION_1").alias("district"),
    )
    inside = quality.in_city(F.col("raw"), F.col("address"), F.col("district"), "Home City", ["NATION_1", "NATION_2"], ["Other City"])
    reason = quality.valid_record(F.col("t"), inside, F.col("address"))
    return x.select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT institution_id, penalty_date, rule, sha1(concat_ws(chr(1), institution_id, strftime(penalty_date, '%Y-%m-%d'), rule)) AS record_hash, round(coalesce(max(fine_amount), 0), 2) AS fine FROM penalty GROUP BY 1, 2, 3""",
    "penalty",
)
def m12_penalty_load(spark: SparkSession, d: str) -> DataFrame:
    """Nested institutions flattened to records, one row per key, hashed."""
    p = view(spark, d, "penalty").withColumn("fine_amount", F.coalesce("fine_amount", F.lit(0.0)))
    nested = p.groupBy(F.col("institution_id").cast("string").alias("school_name")).agg(F.collect_list(F.struct("penalty_date", "rule", "fine_amount")).alias("records"))
    flat = P.penalty_records(nested.withColumns({"county": F.lit(None).cast("string"), "district": F.lit(None).cast("string")}))
    one = flat.groupBy("school_name", "penalty_date", "rule").agg(F.round(F.max("fine_amount"), 2).alias("fine"))
    return one.select(F.col("school_name").cast("long").alias("institution_id"), "penalty_date", "rule", T.key_hash("school_name", "penalty_date", "rule").alias("record_hash"), "fine")


@query(
    """SELECT p_partkey AS id, p_name AS place_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS rating, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS review_rating, p_brand AS original_text FROM part"""
)
def a11_a12_nested_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Typed fields of nested place and review payloads; what doesn't parse is missing, or 0 for a review."""
    rating = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    place = F.to_json(F.struct(F.struct(F.col("p_name").alias("text")).alias("displayName"), rating.alias("rating")))
    review = F.to_json(F.struct(rating.alias("rating"), F.struct(F.col("p_brand").alias("text")).alias("originalText")))
    df = view(spark, d, "part").select("p_partkey", place.alias("_p"), review.alias("_r"))
    flat = df.select("p_partkey", F.struct(*P.place_row("_p")).alias("p"), F.struct(*P.review_row("_r")).alias("r"))
    return flat.select(F.col("p_partkey").alias("id"), "p.place_name", F.col("p.rating").alias("rating"), F.col("r.rating").alias("review_rating"), "r.original_text")


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS name, try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS value FROM customer"""
)
def a8_a9_aliases_and_coercion(spark: SparkSession, d: str) -> DataFrame:
    """First non-blank of the aliased headers, numbers coerced."""
    k = F.col("c_custkey")
    df = view(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).otherwise("  ").alias("Name"), F.col("c_mktsegment").alias("Title"), F.when(k % 3 == 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("v"))
    return df.select("c_custkey", pick(df, ["Missing", "Name", "Title"]).alias("name"), F.col("v").try_cast("double").alias("value"))


@query(
    """SELECT p_partkey, 'N' || p_size AS code, p_brand AS name, CAST(100 + p_size AS INT) AS year FROM part"""
)
def a2_path_keys(spark: SparkSession, d: str) -> DataFrame:
    """A2: code, name and year out of file paths."""
    path = F.concat(F.lit("file:/x/"), (F.col("p_size") + 100).cast("string"), F.lit("學年度/some/N"), F.col("p_size").cast("string"), F.translate("p_brand", "#", "_").cast("string"), F.lit("_x.csv"))
    path = F.concat(F.lit("file:/x/"), (F.col("p_size") + 100).cast("string"), F.lit("學年度/some/N"), F.col("p_size").cast("string"), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit("_x.csv"))
    keys = statements.path_keys(path)
    return view(spark, d, "part").select("p_partkey", *[keys[k].alias(k) for k in ("code", "name", "year")])


@query(
    """SELECT p_partkey, page, CASE WHEN page <= 2 THEN 'cover' WHEN page <= 4 THEN 'income' WHEN page <= 8 THEN 'balance' ELSE 'appendix' END AS section, CASE WHEN page % 2 = 0 THEN 'previous' ELSE 'current' END AS year_mark FROM (SELECT p_partkey, CAST(unnest(range(1, p_size + 1)) AS INT) AS page FROM part) WHERE page <> 5"""
)
def a21_page_index(spark: SparkSession, d: str) -> DataFrame:
    return statements.page_index(view(spark, d, "part"), "p_partkey", "p_size")


@query(
    """SELECT l_suppkey, l_returnflag, round(sum(l_quantity) FILTER (year(l_shipdate) = 1999), 2) AS "1999_quantity", round(sum(l_quantity) FILTER (year(l_shipdate) = 1998), 2) AS "1998_quantity" FROM lineitem WHERE year(l_shipdate) IN (1998, 1999) GROUP BY 1, 2"""
)
def a22_year_stamped_export(spark: SparkSession, d: str) -> DataFrame:
    long = view(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_quantity"), 2).alias("value")).where("year in (1998, 1999)")
    return statements.stamped(long.withColumn("field", F.lit("quantity")), ["l_suppkey", "l_returnflag"], "year", "field", "value", [1999, 1998], ["quantity"])


@query("SELECT id, round(personnel_actual / nullif(students, 0), 2) AS per_student, round(100 * leavers / nullif(teachers, 0), 2) AS turnover_percent, 2 AS n_groups FROM panel WHERE year = 1999", "panel")
def e34_metric_groups(spark: SparkSession, d: str) -> DataFrame:
    """Nested display groups (ratios in percent, two places), read back from their JSON."""
    df = view(spark, d, "panel").where("year = 1999")
    item = lambda label, value, unit: F.struct(F.lit(label).alias("label"), F.round(value, 2).alias("value"), F.lit(unit).alias("unit"))
    groups = F.array(
        F.struct(F.lit("cost").alias("title"), F.array(item("per student", S.safe_divide("personnel_actual", "students"), "NT$")).alias("items")),
        F.struct(F.lit("staff").alias("title"), F.array(item("turnover", 100 * S.safe_divide("leavers", "teachers"), "%")).alias("items")),
    )
    back = F.from_json(F.to_json(groups), "array<struct<title:string,items:array<struct<label:string,value:double,unit:string>>>>")
    df = df.select("id", back.alias("g"))
    return df.select("id", F.col("g")[0]["items"][0]["value"].alias("per_student"), F.col("g")[1]["items"][0]["value"].alias("turnover_percent"), F.size("g").alias("n_groups"))


@query(
    """WITH c AS (SELECT c_custkey AS id, '新北市私立' || c_name || '幼兒園' AS name, lower(regexp_replace(c_name, '\\s+', '', 'g')) AS stem FROM customer)
    SELECT id, name, list_filter(['新北市私立' || stem || '幼兒園', stem || '幼兒園', stem], lambda x: length(x) >= 4) AS aliases FROM c"""
)
def b14_keyword_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Comparison names of every institution."""
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("新北市私立"), "c_name", F.lit("幼兒園")).alias("name"))
    return sinks.keywords(c, "id", "name")


@query("SELECT institution_id, status, changed_at, entries FROM (SELECT institution_id, max_by(status, created_at) AS status, max(created_at) AS changed_at, count(*) AS entries FROM report GROUP BY 1)", "report")
def k3_stream_states(spark: SparkSession, d: str) -> DataFrame:
    """K3 as the streaming plan's aggregate, run on the bounded log."""
    return jobs.states(view(spark, d, "report"), "institution_id", "created_at", "status")
