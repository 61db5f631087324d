"""Compliance scoring: levels from two z-scores per indicator, an index, and warnings before an event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import optional, self_z, with_peer_z

#: Levels by rank (N/A is "no data", below GREEN) and their points.
LEVELS = ("N/A", "GREEN", "YELLOW", "RED")
POINTS = {"YELLOW": 1.0, "RED": 2.0}
#: Weights of the three aspects.
WEIGHTS = {"finance": 1.0, "operation": 1.2, "event": 2.0}


@dataclass(frozen=True)
class Indicator:
    key: str
    column: str
    aspect: str = "finance"
    higher_bad: bool = True


#: The eight default indicators.
CORE = (
    Indicator("cost_per_student", "cost_per_student"),
    Indicator("personnel_growth", "personnel_growth"),
    Indicator("budget_deviation", "budget_deviation"),
    Indicator("reallocation", "reallocation_ratio"),
    Indicator("pupil_teacher", "pupil_teacher_ratio", "operation"),
    Indicator("turnover", "turnover", "operation"),
    Indicator("overtime", "overtime_share", "operation"),
    Indicator("misconduct", "misconduct_reports", "event"),
)


def level_rank(z: Column, higher_bad: bool = True, yellow: float = 1.0, red: float = 2.0) -> Column:
    """0 for missing, 1 GREEN, 2 YELLOW, 3 RED, by the signed z."""
    signed = z if higher_bad else -z
    return F.when(z.isNull(), 0).when(signed >= red, 3).when(signed >= yellow, 2).otherwise(1)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def overall_level(index: Column) -> Column:
    return F.when(index.isNull(), "N/A").when(index >= 50, "high").when(index >= 25, "medium").otherwise("low")


def index_of(indicators: Sequence[Indicator], weights: Mapping[str, float]) -> Column:
    """Points times aspect weight over the greatest possible sum, times 100; N/A adds nothing but stays below the line."""
    most = sum(2.0 * weights.get(i.aspect, 1.0) for i in indicators)
    points = sum((F.greatest(F.col(f"{i.key}_rank") - 1, F.lit(0)) * weights.get(i.aspect, 1.0) for i in indicators), F.lit(0.0))
    return F.round(100 * points / most, 1)


def score(
    panel: DataFrame, entity: str = "id", year: str = "year", county: str = "county", size: str = "students", indicators: Sequence[Indicator] = CORE,
    yellow: float = 1.0, red: float = 2.0, band: int = 20, weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """The panel with, per indicator, ``_self_z``, ``_peer_z``, ``_rank`` and ``_level``; then index and overall level.

    An indicator whose column the panel lacks is N/A throughout. One shuffle by entity serves all self z-scores.
    """
    panel = optional(panel, *[i.column for i in indicators])
    out = panel.withColumns({f"{i.key}_self_z": self_z(i.column, [entity], year) for i in indicators})
    out = with_peer_z(out, {i.column: f"{i.key}_peer_z" for i in indicators}, year, county, size, band)
    out = out.withColumns(
        {f"{i.key}_rank": F.greatest(*[level_rank(F.col(f"{i.key}_{k}_z"), i.higher_bad, yellow, red) for k in ("self", "peer")]) for i in indicators}
    )
    out = out.withColumns({f"{i.key}_level": level_name(F.col(f"{i.key}_rank")) for i in indicators})
    out = out.withColumn("compliance_index", index_of(indicators, weights))
    return out.withColumn("overall_level", overall_level(F.col("compliance_index")))


def warnings_before(scored: DataFrame, event_year: int, lookback: int = 2, entity: str = "id", year: str = "year", indicators: Sequence[Indicator] = CORE, none: str = "(no warning before the event)") -> DataFrame:
    """``scored`` with ``warning``: indicators that were YELLOW or RED in the years before the event, with the worst level.

    An entity with rows there but no such level gets ``none``; one without rows there gets missing.
    """
    w = Window.partitionBy(entity)
    before = F.col(year).between(event_year - lookback, event_year - 1)
    worst = [F.max(F.when(before, F.col(f"{i.key}_rank"))).over(w) for i in indicators]
    parts = F.array(*[F.when(x >= 2, F.concat(F.lit(i.key + "("), level_name(x), F.lit(")"))) for i, x in zip(indicators, worst)])
    text = F.array_join(F.array_compact(parts), ", ")
    seen = F.max(before.cast("int")).over(w) == 1
    return scored.withColumns({"warning": F.when(seen, F.coalesce(F.nullif(text, F.lit("")), F.lit(none))), "event_year": F.lit(event_year)})
