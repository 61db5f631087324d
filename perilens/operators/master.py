"""Statistics of the master tables, by district and by institution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import star_counts

#: The match statuses that count as accepted.
ACCEPTED = ("AUTO_ACCEPT", "MANUAL_OVERRIDE")


def district_statistics(districts: DataFrame, institutions: DataFrame, places: DataFrame, reviews: DataFrame, accepted: Sequence[str] = ACCEPTED) -> DataFrame:
    """One row for every district: public, matched and unmatched counts, ratings and star counts (0 where there are none).

    Three aggregates of their own tables are joined to the dimension; means are rounded to 2 places, missing when empty.
    """
    i = institutions.where("is_public").groupBy("district").agg(F.count("*").alias("public_count"))
    p = places.where(F.col("match_status").isin(*accepted)).groupBy("district").agg(
        F.count("*").alias("matched_count"), F.coalesce(F.sum("rating_count"), F.lit(0)).cast("long").alias("place_review_count"), F.round(F.avg("rating"), 2).alias("mean_place_rating")
    )
    r = reviews.groupBy("district").agg(F.count("*").alias("review_count"), F.round(F.avg("rating"), 2).alias("mean_rating"), *star_counts("rating"))
    out = districts
    for part in (i, p, r):
        out = out.join(part, "district", "left")
    counts = [c for c in out.columns if c.endswith("_count") or c.startswith("star_")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumn("unmatched_count", F.greatest(F.lit(0), F.col("public_count") - F.col("matched_count")))


def institution_statistics(institutions: DataFrame, places: DataFrame, reviews: DataFrame, accepted: Sequence[str] = ACCEPTED) -> DataFrame:
    """One row per institution: best accepted place (first on ties), review and star counts, mean, first and last day."""
    w = Window.partitionBy("institution_id").orderBy(F.desc("match_score"), "place_id")
    best = places.where(F.col("match_status").isin(*accepted)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    best = best.select(F.col("institution_id").alias("id"), "place_id", "match_score", F.col("rating").alias("place_rating"))
    r = reviews.groupBy(F.col("institution_id").alias("id")).agg(
        F.count("*").alias("review_count"), F.round(F.avg("rating"), 2).alias("mean_rating"), F.min("publish_date").alias("first_review"), F.max("publish_date").alias("last_review"), *star_counts("rating")
    )
    out = institutions.select("id", "name", "district").join(best, "id", "left").join(r, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c == "review_count" or c.startswith("star_")})
