"""The risk index: four dimension scores, with the weight of missing ones shared by those present."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilens.functions.scalars import clamp

#: Dimensions, weights and the constants that turn signals into scores.
WEIGHTS = {"finance": 0.75, "parent_report": 1.00, "opinion": 0.50, "compliance": 0.75}
FINANCE_TIMES, OPINION_TIMES = 4.0, 2.5
FINE_HIGH, FINE_ANY_SCORE = 100_000, 50.0
HIGH, MEDIUM = 65, 45
OPEN_STATUSES = ("submitted", "investigating")


def signals(institutions: DataFrame, finance: DataFrame, reports: DataFrame, scans: DataFrame, penalties: DataFrame) -> DataFrame:
    """Institutions with finance_index, open_reports, total_reports, opinion_score, penalty_count and fine_total.

    Each source is aggregated to one row per institution before its left join; absent counts are 0, absent scores stay
    missing. finance(institution_id, finance_index) holds one row per institution; the newest done scan counts.
    """
    r = reports.groupBy("institution_id").agg(
        F.count_if(F.col("status").isin(*OPEN_STATUSES)).alias("open_reports"), F.count_if(F.col("status") != "pending").alias("total_reports")
    )
    s = scans.where("status = 'done'").groupBy("institution_id").agg(F.max_by("opinion_score", "id").alias("opinion_score"))
    p = penalties.groupBy("institution_id").agg(F.count("*").alias("penalty_count"), F.coalesce(F.sum("fine_amount"), F.lit(0.0)).alias("fine_total"))
    out = institutions
    for source in (finance, r, s, p):
        out = out.join(source.withColumnRenamed("institution_id", "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("open_reports", "total_reports", "penalty_count", "fine_total")})


def dimension_scores() -> dict[str, Column]:
    """Score column of each dimension; missing where it has no data."""
    c = F.col
    return {
        "finance": F.when(c("finance_index").isNotNull(), clamp(c("finance_index") * FINANCE_TIMES)),
        "parent_report": F.when(c("open_reports") > 0, 100.0).otherwise(0.0),
        "opinion": F.when(c("opinion_score").isNotNull(), clamp(c("opinion_score") * OPINION_TIMES)),
        "compliance": F.when(c("fine_total") > FINE_HIGH, 100.0).when(c("penalty_count") > 0, FINE_ANY_SCORE).otherwise(0.0),
    }


def level(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "normal")


def scored(df: DataFrame, scores: Mapping[str, Column] | None = None, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``df`` with ``<dimension>_score``, ``<dimension>_weight``, ``risk_score`` and ``risk_level``.

    The weight of missing dimensions is shared equally by those present; the divisor stays the total weight. With
    no dimension present, score and level are missing.
    """
    scores = scores or dimension_scores()
    df = df.withColumns({f"{k}_score": x for k, x in scores.items()})
    here = {k: F.col(f"{k}_score").isNotNull() for k in scores}
    n = sum((x.cast("int") for x in here.values()), F.lit(0))
    lost = sum((F.when(x, 0.0).otherwise(weights[k]) for k, x in here.items()), F.lit(0.0))
    share = F.try_divide(lost, n)
    df = df.withColumns({f"{k}_weight": F.when(x, F.round(F.lit(weights[k]) + share, 4)).otherwise(0.0) for k, x in here.items()})
    total = sum((F.coalesce(F.col(f"{k}_score"), F.lit(0.0)) * F.col(f"{k}_weight") for k in scores), F.lit(0.0)) / sum(weights.values())
    df = df.withColumn("risk_score", F.when(n > 0, clamp(total)))
    return df.withColumn("risk_level", level(F.col("risk_score")))


def dimensions_array(scores: Mapping[str, float] = WEIGHTS) -> Column:
    """The dimensions as array<struct<key, score, base_weight, weight>>, in their order of display."""
    return F.array(
        *[F.struct(F.lit(k).alias("key"), F.col(f"{k}_score").alias("score"), F.lit(w).alias("base_weight"), F.col(f"{k}_weight").alias("weight")) for k, w in scores.items()]
    )
