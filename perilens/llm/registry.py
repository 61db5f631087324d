"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, embeddings, html_text, language_model, licences, metric_tree, periodic_runs, sentencepiece, sharding, simhash, token_counts, toxicity
from .shared import EDGE, fold, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = token_counts.with_trees(docs).withColumn("edits", token_counts.sample_edits(F.col("text")))
    before = before.withColumn("n_before", F.col("n_tokens")).withColumn("n_pre_tokens", F.size("tree.length"))
    after = token_counts.apply_edits(before)
    return after.select(
        "doc_id",
        F.col("n_before").cast("long").alias("n_tokens"),
        F.col("n_tokens").cast("long").alias("n_tokens_edited"),
        F.col("n_pre_tokens").cast("long").alias("n_pre_tokens"),
        F.col("n_encoded_again").cast("long").alias("n_encoded_again"),
        F.crc32(F.col("text").cast("binary")).alias("edited_crc32"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(docs, toxicity.training(table(spark, sf_dir, "labels")))
    scored = toxicity.toxicity(docs, field)
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.to_json(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.round(s["p"], 6).alias("p")))).alias("spans"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece.encode(docs, decoded_col="decoded")
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("round_trip"),
    )


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licence_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        "status",
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), every tenth with a period planted in it: its words from the a-th on repeat the p words there.

    With h the crc32 of the decimal doc_id and g = h div 10: a = g mod n and p = 1 + (n - a) div (3 + g mod 8) for n words, if h mod 10
    is 0. Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    docs = docs.withColumn("_w", words).withColumn("_n", F.nullif(F.size("_w"), F.lit(0)))
    docs = docs.withColumn("_a", (g % F.col("_n")).cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    word = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1))
    return docs.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.transform("_w", word), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # By length / period as exact fractions, then by start and period, in which order the runs already are.
    more = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = lambda x, y: F.signum(F.coalesce(F.nullif(more(x, y), F.lit(0)), F.nullif(x["start"] - y["start"], F.lit(0)), x["period"] - y["period"])).cast("int")
    top = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    own = [
        op1_token_counts,
        op2_simhash,
        op3_html_text,
        op4_decontamination,
        op5_sharding,
        op6_language_model,
        op7_toxicity,
        op8_embeddings,
        op9_sentencepiece,
        op10_licences,
        op11_divergence,
        op12_metric_tree,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in own}


_WORDS = "list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(trim(w, '{edge}'))), lambda w: w <> '')"
_EDGE = EDGE.replace("'", "''")

OP4_SQL = f"""WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format(edge=_EDGE)} AS w FROM documents), b AS (SELECT DISTINCT item_id, {_WORDS.format(edge=_EDGE)} AS w FROM benchmark WHERE item_id IS NOT NULL),
    i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(5, len(w)) AS n FROM b WHERE len(w) > 0))),
    x AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
    m AS (SELECT doc_id, item_id, count(*) AS c FROM x JOIN i ON i.n = x.n AND i.s = x.s GROUP BY 1, 2), t AS (SELECT item_id, count(*) AS c FROM i GROUP BY 1)
    SELECT m.doc_id, m.item_id, CAST(m.c AS DOUBLE) / t.c AS containment, CAST(m.c AS INT) AS n_shared, CAST(t.c AS INT) AS n_shingles FROM m JOIN t ON t.item_id = m.item_id WHERE m.c >= 0.8 * t.c - 1e-9"""

OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
    r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y)
    SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) c ON c.x = v.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY 1) n ON n.x = v.vec_id"""


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, k.n AS m FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
    s AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER o + 5 * count(*) OVER o) AS p, 1 + (1000000000::HUGEINT * (m + 5)) // (sum(m) OVER o + 5 * count(*) OVER o) AS q FROM c WINDOW o AS (PARTITION BY lang, source)),
    f AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value, 'pair' AS part FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS l, y.source AS r, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) v ON v.lang = a.lang AND v.l = a.source AND v.r = b.source
        UNION ALL SELECT lang, source, term, p - q, 'term' FROM s WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50"""

OP12_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; hashes, models, DOM trees, permutations and runs are tested against brute force instead."""
    return {"op4_decontamination": OP4_SQL, "op8_embeddings": OP8_SQL, "op11_divergence": OP11_SQL, "op12_metric_tree": OP12_SQL}
