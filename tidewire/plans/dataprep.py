"""Data-preparation operators of the core over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import drift, instants, rolling
from tidewire.plans import json_oracles
from tidewire.runtime import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = read_table(spark, folder, "news_articles").select("record_no", "publish_time", "publish_date", "source")
    timed = instants.normalise_instants(articles, read_table(spark, folder, "news_sources"))
    return timed.where("utc_second is not null").select("record_no", "utc_second")


def _daily_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows equal in all but ``batch_index`` once: what is left is unique by stock and day."""
    profiles = read_table(spark, folder, "daily_profiles").withColumn("day", F.expr("try_cast(publish_date as date)"))
    return profiles.where("day is not null and ts_code is not null").groupBy("ts_code", "day").agg(F.min("net_sentiment_factor").alias("net"), F.min("negative_shock_factor").alias("shock"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    totals = rolling.rolling_totals(_daily_factors(spark, folder), "ts_code", "day", ["net", "shock"], (7, 30), scale=10_000)
    return totals.where("shock_units_7d >= 15000 and net_units_30d <= -20000").select("ts_code", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = rolling.rolling_totals(_daily_factors(spark, folder), "ts_code", "day", ["net", "shock"], (7, 30), scale=10_000)
    return totals.select("ts_code", F.date_format("day", "yyyy-MM-dd").alias("day"), *[c for c in totals.columns if "_total_" in c or "_avg_" in c])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.layout_changes(drift.file_footers(read_table(spark, folder, "raw_records")))


def p7_news(spark: SparkSession, folder: str) -> DataFrame:
    news = drift.unified_news(read_table(spark, folder, "raw_records"))
    return news.withColumn("further_fields", F.size("extras")).drop("extras")


def p7_typed_news(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, folder, "raw_records")
    return drift.typed_news(raw, drift.file_footers(raw))


def p7_casts(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, folder, "raw_records")
    return drift.cast_report(raw, drift.file_footers(raw))


def p7_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_lifespans(drift.file_footers(read_table(spark, folder, "raw_records"))).select("feed", "field", "kind", "first_file", "last_file")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [p3_found, p5_found, p5_totals, p7_found, p7_news, p7_typed_news, p7_casts, p7_lifespans]}


_ROLLING = """
    WITH facts AS (SELECT ts_code, TRY_CAST(publish_date AS DATE) AS day, min(net_sentiment_factor) AS net, min(negative_shock_factor) AS shock
        FROM daily_profiles WHERE ts_code IS NOT NULL AND TRY_CAST(publish_date AS DATE) IS NOT NULL GROUP BY 1, 2),
    units AS (SELECT ts_code, day, CAST(CASE WHEN net IS NULL OR isnan(net) THEN 0 ELSE round(net * 10000) END AS BIGINT) AS net,
        CAST(CASE WHEN shock IS NULL OR isnan(shock) THEN 0 ELSE round(shock * 10000) END AS BIGINT) AS shock FROM facts),
    spans AS (SELECT ts_code, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM units GROUP BY ts_code),
    dense AS (SELECT s.ts_code, s.day, coalesce(u.net, 0) AS net, coalesce(u.shock, 0) AS shock FROM spans s LEFT JOIN units u ON s.ts_code = u.ts_code AND s.day = u.day),
    totals AS (SELECT ts_code, day,
        CAST(sum(net) OVER a AS BIGINT) AS net7, CAST(sum(net) OVER b AS BIGINT) AS net30, CAST(sum(shock) OVER a AS BIGINT) AS shock7, CAST(sum(shock) OVER b AS BIGINT) AS shock30
        FROM dense WINDOW a AS (PARTITION BY ts_code ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY ts_code ORDER BY day ROWS 29 PRECEDING))
"""


def oracle_sql() -> dict[str, str]:
    value = lambda c, w: f"CAST({c}{w} AS DOUBLE) / 10000 AS {c}_total_{w}d, CAST({c}{w} AS DOUBLE) / {w}0000 AS {c}_avg_{w}d"
    return json_oracles.oracle_sql() | {
        "p5_found": _ROLLING + "SELECT ts_code, strftime(day, '%Y-%m-%d') AS day FROM totals WHERE shock7 >= 15000 AND net30 <= -20000",
        "p5_totals": _ROLLING + "SELECT ts_code, strftime(day, '%Y-%m-%d') AS day, " + ", ".join(value(c, w) for c in ("net", "shock") for w in (7, 30)) + " FROM totals",
    }
