"""All registered queries of the library, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perilens.plans import job_queries, listing_queries, panel_queries, record_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "m3_compliance_scoring"
SECTIONS = (panel_queries, listing_queries, text_queries, record_queries, job_queries, source_queries)


def queries() -> dict[str, Query]:
    return {name: f for section in SECTIONS for name, f in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for section in SECTIONS for name, text in section.ORACLE.items()}
