"""Rows out of payloads kept in a column: feeds, result pages, nested JSON, HTML grids, page metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilens.functions.scalars import feed_date
from perilens.functions.text import strip_tags


def chunks(df: DataFrame, key: str, body: str, tag: str, most: int | None = None) -> DataFrame:
    """(key, pos, chunk): the elements of a tag in a payload, the first ``most`` if the source's rule has a limit."""
    found = F.regexp_extract_all(F.col(body), F.lit(rf"(?s)<{tag}\b.*?</{tag}>"), F.lit(0))
    if most:
        found = F.slice(found, 1, most)
    return df.select(key, F.posexplode(found).alias("pos", "chunk"))


def field(chunk: str, tag: str) -> Column:
    """Text of a child element, CDATA marks dropped."""
    inner = F.regexp_extract(F.col(chunk), rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


def feed_items(df: DataFrame, key: str, body: str, most: int = 80) -> DataFrame:
    """Feed items with title (a publisher after the last ' - ' cut off), link, date and description."""
    rows = chunks(df, key, body, "item", most)
    title = F.regexp_replace(strip_tags(field("chunk", "title")), r" - [^-]+$", "")
    return rows.select(
        key, "pos", title.alias("title"), F.trim(field("chunk", "link")).alias("url"), feed_date(field("chunk", "pubDate")).alias("published_at"), F.left(strip_tags(field("chunk", "description")), F.lit(400)).alias("snippet"),
    )


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, link, label) of the anchors of a page, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<a\b[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("pos", "_a"))
    return rows.select(key, "pos", F.regexp_extract("_a", 'href="([^"]*)"', 1).alias("link"), F.regexp_extract("_a", ">([^<]*)</a>", 1).alias("label"))


def search_results(df: DataFrame, key: str, body: str, parameter: str = "uddg") -> DataFrame:
    """Result rows of a stored result page: decoded target, http(s) only, first per URL, snippet by position (400)."""
    found = F.regexp_extract_all(F.col(body), F.lit(rf'(?s)<a\b[^>]*href="[^"]*{parameter}=[^"]*"[^>]*>.*?</a>'), F.lit(0))
    notes = F.regexp_extract_all(F.col(body), F.lit(r'(?s)class="result-snippet"[^>]*>(.*?)</td>'), F.lit(1))
    parts = F.transform(
        found,
        lambda a: F.struct(F.try_url_decode(F.regexp_extract(a, rf"{parameter}=([^&\"]+)", 1)).alias("url"), strip_tags(F.regexp_replace(a, r"(?s)^<a\b[^>]*>|</a>$", "")).alias("title")),
    )
    kept = F.filter(parts, lambda p: F.coalesce(p["url"].rlike("^https?://"), F.lit(False)) & (p["title"] != ""))
    urls = F.transform(kept, lambda p: p["url"])
    first = F.filter(kept, lambda p, i: F.array_position(urls, p["url"]) == i + 1)
    rows = df.select(key, notes.alias("_notes"), F.posexplode(first).alias("pos", "_r"))
    return rows.select(key, "pos", "_r.url", "_r.title", F.left(strip_tags(F.get("_notes", F.col("pos"))), F.lit(400)).alias("snippet"))


def meta(html: str, name: str) -> Column:
    """Content of a meta element by name, property or as a plain attribute; missing gives the empty text."""
    by_name = F.regexp_extract(F.col(html), rf'<meta\b[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
    plain = F.regexp_extract(F.col(html), rf'<meta\b[^>]*\b{name}="([^"]*)"', 1)
    return F.coalesce(F.nullif(by_name, F.lit("")), plain)


def resource_links(df: DataFrame, key: str, html: str, kinds: Sequence[str] = ("json", "csv")) -> DataFrame:
    """Links whose text or address mentions one of the kinds, each once per page."""
    wanted = F.lower(F.concat_ws(" ", "link", "label")).rlike("|".join(kinds))
    return links(df, key, html).where(wanted).groupBy(key, "link").agg(F.min("pos").alias("pos"))


def grid_rows(df: DataFrame, key: str, html: str, least: int = 7) -> DataFrame:
    """(key, pos, cells) of table rows: the header skipped, rows of fewer than ``least`` or only blank cells dropped."""
    rows = chunks(df, key, html, "tr").where("pos > 0")
    cells = F.transform(F.regexp_extract_all(F.col("chunk"), F.lit(r"(?s)<td\b[^>]*>(.*?)</td>"), F.lit(1)), strip_tags)
    rows = rows.select(key, "pos", cells.alias("cells"))
    return rows.where((F.size("cells") >= least) & F.exists("cells", lambda c: c != ""))


PLACE = "id string, displayName struct<text:string>, formattedAddress string, location struct<latitude:string,longitude:string>, rating string, userRatingCount string, googleMapsUri string, businessStatus string"
REVIEW = "name string, rating string, text struct<text:string,languageCode:string>, originalText struct<text:string,languageCode:string>, publishTime string, relativePublishTimeDescription string, authorAttribution struct<displayName:string,uri:string>"


def place_row(payload: str) -> list[Column]:
    """Columns of a nested place payload; numbers that don't parse are missing."""
    p = F.from_json(F.col(payload), PLACE)
    return [
        p["id"].alias("place_id"), p["displayName"]["text"].alias("place_name"), p["formattedAddress"].alias("place_address"), p["location"]["latitude"].try_cast("double").alias("lat"),
        p["location"]["longitude"].try_cast("double").alias("lng"), p["rating"].try_cast("double").alias("rating"), p["userRatingCount"].try_cast("int").alias("rating_count"), p["businessStatus"].alias("business_status"),
    ]


def review_row(payload: str) -> list[Column]:
    """Columns of a nested review payload: text falls back to the original text, a rating that doesn't parse is 0."""
    r = F.from_json(F.col(payload), REVIEW)
    return [
        r["name"].alias("resource_name"), r["authorAttribution"]["displayName"].alias("author"), F.coalesce(r["rating"].try_cast("int"), F.lit(0)).alias("rating"),
        F.coalesce(r["text"]["text"], r["originalText"]["text"]).alias("text"), F.coalesce(r["originalText"]["text"], r["text"]["text"]).alias("original_text"), r["publishTime"].alias("publish_time"),
    ]


def penalty_records(df: DataFrame) -> DataFrame:
    """One row per record of nested institutions (county, district, school_name, records[])."""
    return df.select("county", "district", "school_name", F.posexplode("records").alias("record_no", "r")).select("county", "district", "school_name", "record_no", "r.*")


def announcements(df: DataFrame, subject: str, words: Sequence[str], base: str) -> DataFrame:
    """Announcement rows with lower-case column names, kept if the subject is on topic; URL is the attachment or an anchor."""
    from perilens.functions.text import any_of

    df = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    link = F.nullif(F.trim(F.coalesce("attachment", F.lit(""))), F.lit(""))
    return df.where(any_of(subject, words)).withColumn("url", F.coalesce(link, F.concat(F.lit(base + "#"), F.sha1(F.col(subject).cast("binary")))))
