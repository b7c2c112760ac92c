"""The operators of this subpackage over the test tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import leaks, mixing, near_text, nearest_time, pieces, rank_walk, top_runs
from tidewire.llm.oracles import oracle_sql  # noqa: F401 - for the driver's entry
from tidewire.runtime import cut, read_table

#: The four scores of a profile, and whether more of it is better.
PROFILE_SCORES = {"net_sentiment_factor": 1, "negative_shock_carry": -1, "attention_factor": 1, "operations_event_state": 1}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_walk.rank_walk(read_table(spark, folder, "daily_profiles"), "publish_date", "ts_code", PROFILE_SCORES, top=3)
    return ranked.select("publish_date", "ts_code")


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_walk.rank_walk(read_table(spark, folder, "daily_profiles"), "publish_date", "ts_code", PROFILE_SCORES)
    return ranked.withColumn("stationarity", F.round("stationarity", 6))


def _best_mentions(spark: SparkSession, folder: str) -> DataFrame:
    mentions = read_table(spark, folder, "article_mentions").where(F.col("publish_date") != "")
    return top_runs.top_n_per_group(mentions, ["ts_code", "publish_date"], "coarse_score", ["news_id"], 3)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _best_mentions(spark, folder).select("ts_code", "publish_date", "news_id")


def p2_top_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _best_mentions(spark, folder).select("ts_code", "publish_date", "news_id", "coarse_score", "place")


def _days(column: str):
    return F.unix_date(F.expr(f"try_cast({column} as date)"))


def _as_day(column: str):
    return F.date_format(F.date_from_unix_date(F.col(column).cast("int")), "yyyy-MM-dd")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    profiles = read_table(spark, folder, "daily_profiles").select("ts_code", "publish_date").distinct()
    found = nearest_time.nearest_in_time(profiles, read_table(spark, folder, "market_prices"), "ts_code", _days("publish_date"), _days("trade_date"), 3)
    return found.where("matched_time is not null").select("ts_code", "publish_date", _as_day("matched_time").alias("trade_date"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = near_text.similar_pairs(read_table(spark, folder, "news_articles", spread=True), "record_no", ["title", "body"])
    return near_text.all_pairs(cut(links), members)


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_text.similar_groups(read_table(spark, folder, "news_articles", spread=True), "record_no", ["title", "body"])
    return groups.select(F.col("_key").alias("record_no"), "group_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(read_table(spark, folder, "documents", spread=True), read_table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(read_table(spark, folder, "documents", spread=True), read_table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest").alias("longest"), F.max("item_share").alias("most_of_item"))


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.remove_leaks(read_table(spark, folder, "documents", spread=True), read_table(spark, folder, "eval_items"))


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, folder, "documents", spread=True), read_table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents, targets = read_table(spark, folder, "documents", spread=True), read_table(spark, folder, "mix_targets")
    counted = mixing.count_tokens(documents, "doc_id", "source", "text")
    return mixing.reached_shares(mixing.mix_sources(documents, targets, counted=counted), targets, counted)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(read_table(spark, folder, "documents", spread=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = [p1_found, p1_ranking, p2_found, p2_top_mentions, p4_found, p6_found, p6_groups, p8_found, p8_leaked_items, p8_cleaned, p9_mixed, p9_shares, p10_pieces]
    return {f.__name__: f for f in each}
