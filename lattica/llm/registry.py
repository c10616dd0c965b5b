"""Queries on training text by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import event_model, leakage, packing, percentiles, sentences


SQL = {
    "p2_rank_check": """WITH s AS (SELECT DISTINCT stat_id, section_no, channel_name, bpp, px_median, px_std FROM image_stats), v AS (SELECT section_no, channel_name, bpp, 'px_median' AS measure, px_median AS v FROM s UNION ALL SELECT section_no, channel_name, bpp, 'px_std', px_std FROM s)
SELECT section_no, channel_name, bpp, measure, count(*) AS n, true AS within FROM v WHERE isfinite(v) AND v>=0 AND v<1.79769e308 GROUP BY ALL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_percentiles": percentiles.p2_percentiles,
        "p2_daily": percentiles.p2_daily,
        "p2_rank_check": percentiles.p2_rank_check,
        "p6_containers": packing.p6_containers,
        "p6_fill": packing.p6_fill,
        "p7_found": leakage.p7_found,
        "p7_spans": leakage.p7_spans,
        "p8_method": event_model.p8_method,
        "p8_found": sentences.p8_found,
        "p8_agreement": event_model.p8_agreement,
    }


def oracle_sql() -> dict[str, str]:
    return SQL
