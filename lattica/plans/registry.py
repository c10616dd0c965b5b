"""Queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.operators import changepoints, consolidate, orphans, parsing, units
from lattica.plans import extended, oracles, reference  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": orphans.p1_found,
        "p1_orphans_by_month": orphans.p1_orphans_by_month,
        "p3_found": parsing.p3_found,
        "p3_errors": parsing.p3_errors,
        "p3_transforms": parsing.p3_transforms,
        "p3_records": parsing.p3_records,
        "p4_found": consolidate.p4_found,
        "p4_assignment": consolidate.p4_assignment,
        "p4_ranges": consolidate.p4_ranges,
        "p4_corners": consolidate.p4_corners,
        "p5_method": changepoints.p5_method,
        "p5_found": units.p5_found,
        "p5_agreement": changepoints.p5_agreement,
        **reference.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | oracles.with_transforms_sql(reference.parse_sql(reference.STOS_TEXTS)) | reference.SQL
