"""Opinion items: union of sources, greedy deduplication, tags, attribution, ranking, scores and annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilens.functions.text import any_of, canonical_url, compact, strip_tags, tag_weights, verified
from perilens.operators.rounds import first_come

#: Topic words, and the risk tags with weights and keywords.
TOPIC_WORDS = (
    "幼兒園", "幼兒", "幼童", "教保", "教保員", "園長", "托育", "兒童", "體罰", "虐童", "不當管教", "霸凌", "食安", "超收", "違法", "裁罰", "勒令停辦",
)
RULES = {
    "疑似體罰": (25, ("打小孩", "打學生", "體罰", "巴掌", "打人", "拉扯", "推倒")),
    "疑似不當管教": (20, ("辱罵", "吼小孩", "恐嚇", "罰站", "關廁所", "不當管教")),
    "疑似兒少傷害": (25, ("虐童", "受傷", "瘀青", "傷口")),
    "食安問題": (20, ("食物中毒", "過期", "發霉", "吃壞肚子")),
    "衛生問題": (10, ("蟑螂", "很髒", "環境髒亂")),
    "收退費爭議": (10, ("亂收費", "退費", "學費爭議")),
    "人力問題": (10, ("人力不足", "師生比", "無照教保", "缺老師")),
    "超收": (15, ("超收",)),
    "公安問題": (20, ("消防不合格", "公安", "逃生出口", "違建")),
    "行政裁罰": (20, ("裁罰", "罰鍰", "勒令停辦", "停招", "違反幼兒教育及照顧法")),
    "家長投訴": (10, ("投訴", "申訴", "家長抗議")),
}
#: Words that make a text relevant, and words that place it.
CONTEXT_WORDS = ("幼兒園", "幼稚園", "幼兒", "幼童", "教保", "教保員", "園長", "托嬰", "托育")
LABELS = ("confirmed", "ambiguous", "unrelated")
MOST_ITEMS = 36

Source = Callable[[SparkSession, Mapping], DataFrame]


def collect(spark: SparkSession, sources: Mapping[str, Source], config: Mapping, schema: str) -> tuple[DataFrame, dict[str, str]]:
    """Items of all sources with the source's key, and a status per source; one that fails doesn't stop the others."""
    parts, status = [], {}
    for key, read in sources.items():
        try:
            parts.append(read(spark, config).withColumn("source_key", F.lit(key)))
            status[key] = "ok"
        except Exception as problem:  # noqa: BLE001 - the status table reports it
            status[key] = f"failed: {type(problem).__name__}"
    if not parts:
        return spark.createDataFrame([], schema + ", source_key string"), status
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), status


def prepared(items: DataFrame, topic: Sequence[str] = TOPIC_WORDS) -> DataFrame:
    """Items with canonical url, cleaned title (300) and snippet (1000), text, hashes and the topic flag; bad URLs drop out."""
    url = F.when(F.coalesce("internal", F.lit(False)), F.col("url")).otherwise(canonical_url("url"))
    out = items.withColumn("url", url).where("url is not null")
    out = out.withColumns({"title": F.left(strip_tags("title"), F.lit(300)), "snippet": F.left(strip_tags("snippet"), F.lit(1000))})
    out = out.withColumn("text", F.concat_ws(" ", "title", "snippet"))
    on_topic = (F.col("title") != "") & any_of("text", topic)
    return out.withColumns(
        {"url_hash": F.sha2(F.col("url").cast("binary"), 256), "title_hash": F.sha2(compact("title").cast("binary"), 256), "on_topic": on_topic}
    )


def deduplicated(items: DataFrame, scan: str = "scan_id", order: str = "seq") -> DataFrame:
    """First-come deduplication within a scan: by URL, then topic, then title.

    A row that drops out for its topic or title doesn't block its URL, so the rule depends on order; it is settled in
    rounds over the (scan, url) and (scan, title) keys of all scans at once, and no scan is gathered in one task.
    """
    keys = items.where("on_topic").select(scan, order, "url_hash", "title_hash")
    chosen = first_come(keys, [[scan, "url_hash"], [scan, "title_hash"]], order)
    return items.where("on_topic").join(chosen.select(scan, order), [scan, order], "left_semi")


def attribution(forced: Column, name_hit: Column) -> Column:
    return F.when(F.coalesce(forced, F.lit(False)) | F.coalesce(name_hit, F.lit(False)), "confirmed").otherwise("unrelated")


def ranked(items: DataFrame, scan: str = "scan_id", order: str = "seq", most: int = MOST_ITEMS) -> DataFrame:
    """Confirmed first, then tagged, then newest, stable by order; the first ``most`` of a scan, with their place."""
    w = Window.partitionBy(scan).orderBy(F.col("attribution") != "confirmed", F.size("tags") == 0, F.desc_nulls_last("published_at"), order)
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def multiplier(is_verified: Column, negative: Column) -> Column:
    """1 for verified items; else 0.4 + 0.6 * negative score, taken as 0.5 where missing."""
    return F.when(F.coalesce(is_verified, F.lit(False)), 1.0).otherwise(0.4 + 0.6 * F.coalesce(negative, F.lit(0.5)))


def negative_signal(is_verified: Column, negative: Column, tags: Column) -> Column:
    return (F.coalesce(negative, F.lit(0.0)) >= 0.5) | (F.coalesce(is_verified, F.lit(False)) & (F.size(tags) > 0))


def scores(scans: DataFrame, items: DataFrame, rules: Mapping = RULES, scan: str = "scan_id") -> DataFrame:
    """opinion_score per scan: for each known tag the greatest weight times multiplier among confirmed items, summed, at most 100.

    Ten reports of one event count once. A scan without confirmed items scores 0 (it looked and found nothing).
    """
    weight = tag_weights(rules)
    rows = items.where("attribution = 'confirmed'").select(scan, multiplier(F.col("verified"), F.col("negative_score")).alias("m"), F.explode("tags").alias("tag"))
    best = rows.select(scan, "tag", (weight[F.col("tag")] * F.col("m")).alias("v")).where("v is not null").groupBy(scan, "tag").agg(F.max("v").alias("v"))
    total = best.groupBy(scan).agg(F.round(F.least(F.lit(100.0), F.sum("v")), 2).alias("opinion_score"))
    return scans.select(scan).distinct().join(total, scan, "left").withColumn("opinion_score", F.coalesce("opinion_score", F.lit(0.0)))


def counters(items: DataFrame, scan: str = "scan_id") -> DataFrame:
    confirmed = F.col("attribution") == "confirmed"
    negative = negative_signal(F.col("verified"), F.col("negative_score"), F.col("tags"))
    return items.groupBy(scan).agg(
        F.count("*").alias("items"), F.count_if(confirmed).alias("confirmed"), F.count_if(confirmed & negative).alias("negative"), F.count_if(F.col("attribution") == "ambiguous").alias("ambiguous")
    )


def item_score(tags: Column, rules: Mapping = RULES) -> Column:
    """Sum of the weights of an item's tags, at most 100; unknown tags weigh nothing."""
    weight = tag_weights(rules)
    return F.least(F.lit(100.0), F.aggregate(tags, F.lit(0.0), lambda a, t: a + F.coalesce(weight[t], F.lit(0.0))))


def annotated(items: DataFrame, notes: DataFrame, on: Sequence[str], most_tags: int = 8) -> DataFrame:
    """Items with a model's annotations: valid labels override, confidence is clamped to 0..1, tags join in order (first 8)."""
    n = notes.select(*on, F.col("attribution").alias("_a"), F.col("confidence").alias("_c"), F.col("tags").alias("_t"))
    out = items.join(n, list(on), "left")
    label = F.when(F.col("_a").isin(*LABELS), F.col("_a"))
    return out.withColumns(
        {
            "attribution": F.coalesce(label, "attribution"),
            "confidence": F.coalesce(F.when(F.col("_c").isNotNull(), F.least(F.greatest("_c", F.lit(0.0)), F.lit(1.0))), "confidence"),
            "tags": F.slice(F.array_distinct(F.concat("tags", F.coalesce("_t", F.array().cast("array<string>")))), 1, most_tags),
        }
    ).drop("_a", "_c", "_t")


def with_sentiment(items: DataFrame, sentiment: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sentiment of confirmed and ambiguous items only; others keep what they have."""
    s = sentiment.select(*on, F.col("negative_score").alias("_n"))
    wanted = F.col("attribution").isin("confirmed", "ambiguous")
    return items.join(s, list(on), "left").withColumn("negative_score", F.when(wanted, F.coalesce("_n", "negative_score")).otherwise(F.col("negative_score"))).drop("_n")


#: Base and modulus of the numbers that stand for blocks of characters; their products stay below 2 ** 63.
BASE, PRIME = 1_000_003, (1 << 31) - 1
#: Bits in one row of the table of blocks.
ROW_BITS = 1 << 15


def _block_number(block: str, width: int) -> Column:
    """A number for a block of ``width`` characters; ``_places`` computes the same for all blocks of a text."""
    number = F.lit(0).cast("long")
    for i in range(width):
        number = (number * BASE + F.ascii(F.substring(block, i + 1, 1))) % PRIME
    return number


def _anchors(aliases: DataFrame, width: int) -> DataFrame:
    """(_alias, _block, _at): of each alias the block of ``width`` characters that fewest aliases have, and where it is (from 0)."""
    blocks = aliases.select("_alias").distinct().select("_alias", F.posexplode(F.regexp_extract_all("_alias", F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))).alias("_at", "_block"))
    rare = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    best = blocks.join(rare, "_block").groupBy("_alias").agg(F.min_by(F.struct("_block", "_at"), F.struct("_n", "_at")).alias("_b"))
    return best.select("_alias", "_b.*")


def _places(texts: DataFrame, text_key: str, table: Broadcast, bits: int, width: int, longest: int) -> DataFrame:
    """(text_key, _block, _here, _window): where a text has a block whose bit is set, with what surrounds it; each text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = table.value
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            number = np.zeros(max(0, len(chars) - width + 1), np.int64)
            for i in range(width):
                number = (number * BASE + chars[i : i + len(number)]) % PRIME
            number %= bits
            at = np.flatnonzero(marks[number >> 3] >> (number & 7).astype(np.uint8) & 1)
            of = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[of] if len(at) else np.zeros(0, bool)
            at, of = at[inside], of[inside]
            for start in range(0, len(at), 20_000):
                some = of[start : start + 20_000]
                where = (at[start : start + 20_000] - (ends[some] - [len(texts[k]) for k in some])).tolist() if len(some) else []
                blocks, here, windows = [], [], []
                for k, p in zip(some.tolist(), where):
                    low = max(0, p - longest)
                    blocks.append(texts[k][p : p + width])
                    here.append(p - low)
                    windows.append(texts[k][low : p + longest])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(blocks, pa.string()), pa.array(here, pa.int32()), pa.array(windows, pa.string())], names=[text_key, "_block", "_here", "_window"])

    schema = texts.select(text_key, F.lit("").alias("_block"), F.lit(0).alias("_here"), F.lit("").alias("_window")).schema
    return texts.select(text_key, "_text").mapInArrow(run, schema)


def mentions(texts: DataFrame, entities: DataFrame, text_key: str, text: str, entity_key: str, alias_col: str = "aliases", gram: int = 4, scan_bytes: int = 8 << 20) -> DataFrame:
    """(text_key, entity_key) where the compacted text holds an alias of the entity.

    Every alias is anchored at the block of ``gram`` characters in it that fewest aliases have. A table of bits, 64 for each distinct
    block up to ``scan_bytes`` in all, tells where in a text a block may be one of these; it only filters, so a dictionary of any size takes the
    same plan and bounded memory. A text is read once. Places that pass join the aliases of their block and are verified
    in place. Aliases must have at least ``gram`` characters (as ``functions.text.aliases`` gives them).
    """
    t = texts.select(text_key, compact(text).alias("_text"))
    a = entities.select(entity_key, F.explode(alias_col).alias("_alias")).where(F.length("_alias") >= gram).distinct()
    anchors = _anchors(a, gram)
    count, longest = anchors.agg(F.count_distinct("_block"), F.coalesce(F.max(F.length("_alias")), F.lit(0))).first()
    bits = max(ROW_BITS, min(1 << (64 * count).bit_length(), 8 * scan_bytes // ROW_BITS * ROW_BITS))
    place = _block_number("_block", gram) % bits
    rows = anchors.groupBy((place / ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(place % ROW_BITS).alias("bits"))
    marks = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.toLocalIterator():
        marks[r.row] = np.frombuffer(r.bits, np.uint8)
    shipped = texts.sparkSession.sparkContext.broadcast(marks.reshape(-1))
    found = _places(t, text_key, shipped, bits, gram, longest).join(anchors, "_block")
    held = F.substring("_window", F.col("_here") - F.col("_at") + 1, F.length("_alias")) == F.col("_alias")
    found = found.where((F.col("_here") >= F.col("_at")) & held).select(text_key, "_alias").distinct()
    return found.join(a, "_alias").select(text_key, entity_key).distinct()


def linked(texts: DataFrame, found: DataFrame, text_key: str, entity_key: str) -> DataFrame:
    """One mention links; several leave the link missing and list the candidates in order."""
    c = found.groupBy(text_key).agg(F.array_sort(F.collect_set(entity_key)).alias("candidates"))
    out = texts.join(c, text_key, "left")
    return out.withColumn("entity", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))


def relevance(text: Column, alias_hit: Column, city_supported: Column, official: Column, context: Sequence[str] = CONTEXT_WORDS, places: Sequence[str] = ("新北",)) -> Column:
    """struct<relevant, location_valid, reason> of the gate: context first, then alias, city, location."""
    bare, alias, city = ~any_of(text, context), F.coalesce(alias_hit, F.lit(False)), F.coalesce(city_supported, F.lit(False))
    placed = F.coalesce(official, F.lit(False)) | any_of(text, places)
    reason = F.when(bare, "no context").when(alias, "known alias").when(~city, "unsupported city").when(~placed, "no location").otherwise("context and location")
    ok = ~bare & (alias | (city & placed))
    return F.struct(ok.alias("relevant"), ok.alias("location_valid"), reason.alias("reason"))


def gated(items: DataFrame, json_col: str) -> DataFrame:
    """Items whose overflow JSON says relevant and location_valid."""
    flag = lambda f: F.coalesce(F.get_json_object(json_col, f"$.{f}") == "true", F.lit(False))
    return items.where(flag("relevant") & flag("location_valid"))


def summary(items: Column, confirmed: Column, ambiguous: Column, tags: Column) -> Column:
    """The rule-based sentence on a scan."""
    named = F.array_join(F.array_sort(tags), ", ")
    return (
        F.when(items == 0, F.lit("No related items were found."))
        .when((confirmed == 0) & (ambiguous == 0), F.format_string("%d items, none about this institution.", items))
        .otherwise(F.concat(F.format_string("%d items, %d confirmed, %d to be checked", items, confirmed, ambiguous), F.when(named != "", F.concat(F.lit("; tags: "), named)).otherwise(""), F.lit(".")))
    )


def own_records(penalties: DataFrame, title: str, snippet: str, *fields: str) -> DataFrame:
    """Own table rows as items: pre-confirmed, verified and internal, with formatted title and snippet."""
    url = F.concat(F.lit("internal://record/"), F.col("id").cast("string"))
    return penalties.select(
        "institution_id", F.format_string(title, *fields).alias("title"), url.alias("url"), F.format_string(snippet, *fields).alias("snippet"), F.lit(True).alias("force_confirmed"), F.lit(True).alias("verified"), F.lit(True).alias("internal"),
    )


def checked(flag: str, internal: str, url: str) -> Column:
    return verified(flag, internal, url)
