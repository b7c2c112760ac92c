"""The engine's operators over the test tables, one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import wordlists as W
from tidewire.functions.text import clamp, hits, join_bar, number, r4, squeeze, text, title_and_body
from tidewire.operators import drift, ingest, matching, mentions, profiles, ranking, relevance, returns, selection, validation
from tidewire.runtime import cut, read_table
from tidewire.sources.files import quarter_universe, uncovered, universe


def _news(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "news_articles", spread=True)


def _universe(spark: SparkSession, d: str) -> DataFrame:
    return universe(read_table(spark, d, "stock_universe"))


def _quarter_universe(spark: SparkSession, d: str) -> DataFrame:
    return quarter_universe(read_table(spark, d, "stock_universe"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return profiles.distinct_mentions(read_table(spark, d, "article_mentions", spread=True))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "daily_profiles")
    return rows.drop("batch_index").distinct()


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "market_prices")


def ref_s9_universe(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d).select("ts_code", "name", "industry", join_bar(F.col("aliases")).alias("aliases"))


def ref_p1_text(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("record_no", text("title").alias("title"), text("url").alias("url"), F.lower(text("language")).alias("language"), squeeze("title").alias("squeezed"), F.substring(text("publish_time"), 1, 10).alias("date_prefix"))


def ref_p6_surrogate_id(spark: SparkSession, d: str) -> DataFrame:
    key = ingest.surrogate_id(F.col("raw_source_file"), "record_no", F.col("title"), F.col("publish_time"))
    return _news(spark, d).select("record_no", F.when(text("id") != "", text("id")).otherwise(key).alias("id"))


def ref_p7_normalised_news(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "raw_records")
    return ingest.normalise_news(raw, ["zh"], read_table(spark, d, "news_sources"))


def ref_p8_raw_records(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalise_raw_record(read_table(spark, d, "raw_records"))


def ref_s3_lenient_lines(spark: SparkSession, d: str) -> DataFrame:
    footers = drift.file_footers(read_table(spark, d, "raw_records"))
    return footers.where("field is null and objects > 0").select("feed", "file_no", "objects")


def ref_p10_hits(spark: SparkSession, d: str) -> DataFrame:
    return _news(spark, d).select("record_no", join_bar(hits(F.lower(title_and_body()), W.STRONG)).alias("hits"))


def ref_f1_language(spark: SparkSession, d: str) -> DataFrame:
    return ingest.drop_empty(ingest.keep_languages(_news(spark, d), ["zh"])).select("record_no", "language")


def ref_f3_keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return relevance.keyword_filter(_news(spark, d), ["诉讼，库存", "Audit;audit"]).select("record_no")


def ref_f4_date_range(spark: SparkSession, d: str) -> DataFrame:
    return relevance.date_range(_news(spark, d), "2023-10-10", "2023-11-10").select("record_no", "publish_date")


def ref_f5_date_range_keeping_empty(spark: SparkSession, d: str) -> DataFrame:
    return relevance.date_range(_news(spark, d), "2023-10-10", "2023-11-10", "keep").select("record_no")


def ref_f6_date_range_dropping_empty(spark: SparkSession, d: str) -> DataFrame:
    return relevance.date_range(_news(spark, d), None, "2023-11-10", "drop").select("record_no")


_DECISION = ["record_no", "filter_score", "filter_keep", "strong_hits", "weak_hits", "exclude_hits"]


def ref_f7_broad_relevance(spark: SparkSession, d: str) -> DataFrame:
    return relevance.broad_relevance(_news(spark, d)).select(*_DECISION)


def ref_f8_strict_relevance(spark: SparkSession, d: str) -> DataFrame:
    return relevance.strict_relevance(_news(spark, d)).select(*_DECISION)


def _subset(spark: SparkSession, d: str) -> DataFrame:
    news = _news(spark, d)
    return selection.experiment_subset(news, matching.record_match(news, _universe(spark, d)), "record_no", ["record_no"], 0, 0)


def ref_f10_study_relevance(spark: SparkSession, d: str) -> DataFrame:
    return relevance.study_relevance(_subset(spark, d)).select("record_no", "primary_ts_code", "study_score", "study_keep", "study_finance_hits", "study_negative_hits", "study_has_full_name", "study_alias_only")


def ref_f12_alias_hits(spark: SparkSession, d: str) -> DataFrame:
    found = matching.alias_hits(_news(spark, d), "record_no", title_and_body(limit=1600), _quarter_universe(spark, d)).where("leading")
    return found.select(F.col("_key").alias("record_no"), "ts_code", "squeezed").distinct()


def ref_f13_quarter_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.quarter_match(_news(spark, d), _quarter_universe(spark, d)).select("record_no", "ts_code", "score", "title_hits", "body_hits", "has_full_name")


def ref_j1_coarse_match(spark: SparkSession, d: str) -> DataFrame:
    found = matching.coarse_match(_news(spark, d), _universe(spark, d))
    return found.select("record_no", "ts_code", "name", "industry", join_bar(F.col("matched_aliases")).alias("matched_aliases"), "coarse_score", "candidate_rank")


def ref_j2_record_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.record_match(_news(spark, d), _universe(spark, d))


def ref_j4_industry(spark: SparkSession, d: str) -> DataFrame:
    return profiles.with_industry(_profiles(spark, d).select("publish_date", "ts_code"), _universe(spark, d))


def ref_j8_uncovered_codes(spark: SparkSession, d: str) -> DataFrame:
    """Of the whole universe, whose codes aren't all quoted."""
    return uncovered(_prices(spark, d).where("close is not null and trade_date < date'2023-10-04'"), _universe(spark, d))


def ref_d1_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = ingest.surrogate_id(F.col("raw_source_file"), "record_no", F.col("title"), F.col("publish_time"))
    news = _news(spark, d).withColumn("id", F.when(text("id") != "", text("id")).otherwise(key))
    return ingest.dedup_in_file(news, ["record_no"]).select("record_no", "id")


def ref_d2_dedup_across_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedup_across_files(_news(spark, d), ["record_no"]).select("record_no")


def ref_d3_first_id(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_of(_news(spark, d), ["id"], ["record_no"], skip_empty=True).select("record_no")


def ref_d6_repaired_union(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "article_mentions")
    parts = [rows.select("news_id", "ts_code", "confidence", "coarse_score"), _prices(spark, d).select("ts_code", F.col("close").cast("string").alias("coarse_score"))]
    parts[0] = parts[0].withColumn("coarse_score", F.col("coarse_score").cast("string"))
    fixed = ingest.union_repaired(parts, ["confidence", "coarse_score"])
    nan0 = lambda c: F.round(F.sum(F.when(F.isnan(c), 0.0).otherwise(F.col(c))), 4)
    return fixed.groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"), nan0("confidence").alias("confidence"), nan0("coarse_score").alias("coarse_score"))


def ref_u1_rule_mentions(spark: SparkSession, d: str) -> DataFrame:
    news = _news(spark, d)
    told = mentions.rule_mentions(news, matching.coarse_match(news, _universe(spark, d)))
    return told.select("record_no", "ts_code", "stock_name", "event_type", "sentiment", "sentiment_strength", "confidence", "relevance", "event_importance", "risk_flag", "trend_signal", join_bar(F.col("keywords")).alias("keywords"))


def ref_u1_overview(spark: SparkSession, d: str) -> DataFrame:
    news = _news(spark, d)
    return mentions.article_overview(news, mentions.rule_mentions(news, matching.coarse_match(news, _universe(spark, d))))


def ref_u2_structured_news(spark: SparkSession, d: str) -> DataFrame:
    return mentions.structure_news(_news(spark, d), _universe(spark, d))[0]


def ref_u2_skipped_news(spark: SparkSession, d: str) -> DataFrame:
    return mentions.structure_news(_news(spark, d), _universe(spark, d))[1]


def ref_a1_merged_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("ts_code is not null").withColumn("event_summary", F.concat_ws("", "stock_name", "event_type"))
    return mentions.merge_mentions(rows).drop("event_summary")


def ref_p15_mention_weight(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("news_id", "ts_code", F.round(F.round(mentions.mention_weight(), 12), 8).alias("weight"))


def ref_a2_base_factors(spark: SparkSession, d: str) -> DataFrame:
    return profiles.base_factors(_mentions(spark, d))


def ref_a4_dominant_event(spark: SparkSession, d: str) -> DataFrame:
    return profiles.dominant_events(_mentions(spark, d))


def ref_a5_top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return profiles.top_keywords(_mentions(spark, d))


def ref_w1_states(spark: SparkSession, d: str) -> DataFrame:
    rows = profiles.with_states(profiles.base_factors(_mentions(spark, d)))
    names = ["sentiment_delta_1d", "sentiment_trend_factor", "sentiment_momentum_factor", "event_novelty_factor", "ema3_sentiment_state", "ema5_sentiment_state", "negative_shock_carry", "risk_event_state", "composite_score"]
    return rows.select(*profiles.GROUP, *[r4(F.col(c)).alias(c) for c in names])


def ref_a2_daily_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.daily_profiles(cut(_mentions(spark, d)), _universe(spark, d))


def ref_p20_diversity_score(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("news_id", "ts_code", selection.diversity_score().alias("diversity_score"))


def ref_p21_enhanced_demo(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_mentions(spark, d))
    return profiles.enhanced_demo(profiles.base_factors(rows), rows)


def ref_a12_event_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return profiles.event_crosstab(_mentions(spark, d))


def ref_a13_event_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return profiles.event_sentiment(_mentions(spark, d))


def ref_a14_column_means(spark: SparkSession, d: str) -> DataFrame:
    return profiles.column_means(_mentions(spark, d), ["sentiment", "confidence", "relevance", "coarse_score"])


def ref_a21_counters(spark: SparkSession, d: str) -> DataFrame:
    return selection.counts_by_stock(_mentions(spark, d).where("ts_code is not null and publish_date <> ''"))


def ref_p18_derived_features(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.add_derived(_profiles(spark, d))
    return rows.select("publish_date", "ts_code", r4(F.col("sentiment_confirmation_factor")).alias("confirmation"), r4(F.col("coverage_reliability_factor")).alias("coverage"), r4(ranking.reliability(rows)).alias("multiplier"))


def ref_w8_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.percentile(_profiles(spark, d).select("publish_date", "ts_code", "attention_factor"), {"attention": F.col("attention_factor")})
    return rows.select("publish_date", "ts_code", F.round("attention__signal", 8).alias("attention_signal"))


def _ranked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ranked = ranking.rank_stocks(_profiles(spark, d), ranking.preset(name), 5)
        return ranked.select("publish_date", "ts_code", F.round(F.round("base_ranking_score", 12), 8).alias("base_ranking_score"), F.round("ranking_score", 8).alias("ranking_score"), "rank_in_date", "selected_topk", *sorted(c for c in ranked.columns if c.endswith("_group_score")))

    return query


def ref_a11_ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_stocks(_profiles(spark, d), ranking.preset("optimized"), 5)
    summary = ranking.summarise(cut(ranked), ranking.preset("optimized"), 5)
    days = [(x["publish_date"], x["selected_count"], "|".join(s["ts_code"] for s in x["selected_stocks"]), summary["date_count"], summary["stock_count"], float(summary["avg_cross_section_size"])) for x in summary["topk_by_date"]]
    return spark.createDataFrame(days, "publish_date string, selected_count long, selected string, dates long, stocks long, mean_size double")


def ref_w7_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = returns.forward_returns(returns.one_quote_a_day(_prices(spark, d).select("ts_code", "trade_date", "close")))
    return rows.select("ts_code", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), *[F.round(f"fwd_return_{h}d", 8).alias(f"fwd_return_{h}d") for h in returns.HORIZONS])


def _panel(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return returns.asof_forward(rows, _prices(spark, d).select("ts_code", "trade_date", "close", *[f"fwd_return_{h}d" for h in returns.HORIZONS]))


def ref_j5_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = _panel(spark, d, _profiles(spark, d).select("publish_date", "ts_code"))
    return rows.select("publish_date", "ts_code", F.date_format("anchor_trade_date", "yyyy-MM-dd").alias("anchor_trade_date"), "anchor_close", "fwd_return_1d")


def _topk_panel(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.rank_stocks(_profiles(spark, d), ranking.preset("optimized"), 5)
    return _panel(spark, d, ranked.select("publish_date", "ts_code", "ranking_score", "rank_in_date", "selected_topk"))


def ref_a15_topk_performance(spark: SparkSession, d: str) -> DataFrame:
    return returns.evaluate_topk(_topk_panel(spark, d))


def ref_a16_performance_summary(spark: SparkSession, d: str) -> DataFrame:
    return returns.summarise_performance(cut(returns.evaluate_topk(_topk_panel(spark, d))))


def ref_a22_preset_grid(spark: SparkSession, d: str) -> DataFrame:
    return returns.preset_grid(_profiles(spark, d), _prices(spark, d), ["direct", "state", "event", "optimized"], [1, 3, 5])


def _validation_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, _profiles(spark, d).select("publish_date", "ts_code", *validation.FACTORS))


def ref_a17_time_series(spark: SparkSession, d: str) -> DataFrame:
    return validation.time_series(cut(_validation_panel(spark, d)))


def ref_a18_cross_section(spark: SparkSession, d: str) -> DataFrame:
    """The two stocks with the most profiles that have a return (ties by code), as a cross-section is a pair of stocks."""
    panel = cut(_validation_panel(spark, d))
    pair = [r[0] for r in panel.where("fwd_return_1d is not null and not isnan(fwd_return_1d)").groupBy("ts_code").count().orderBy(F.desc("count"), "ts_code").limit(2).collect()]
    return validation.cross_section(panel.where(F.col("ts_code").isin(pair)))


def ref_a19_direction(spark: SparkSession, d: str) -> DataFrame:
    return validation.direction(_validation_panel(spark, d))


def ref_w11_quota(spark: SparkSession, d: str) -> DataFrame:
    matches = matching.record_match(_news(spark, d), _universe(spark, d))
    return selection.quota_per_stock(matches, ["record_no"], 50).select("record_no", "ts_code")


def ref_t5_best_per_stock(spark: SparkSession, d: str) -> DataFrame:
    scored = relevance.study_relevance(_subset(spark, d))
    return selection.best_per_stock(scored, "study_score", 4.0, 20).select("record_no", "primary_ts_code", "study_score")


def ref_t6_daily_topk(spark: SparkSession, d: str) -> DataFrame:
    return selection.daily_topk(relevance.study_relevance(_subset(spark, d)), 3, order=["record_no"]).select("record_no", "publish_date", "primary_ts_code", "place_in_day")


def ref_t7_heap_topk(spark: SparkSession, d: str) -> DataFrame:
    news = _news(spark, d)
    dated = matching.quarter_match(news, _quarter_universe(spark, d)).join(news.select("record_no", "publish_date"), "record_no").where("publish_date <> ''")
    return selection.heap_topk(dated).select("record_no", "publish_date", "ts_code", "score", "place_in_day")


def ref_t9_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    return selection.diverse_topk(_mentions(spark, d)).select("publish_date", "ts_code", "news_id", "pick", "diversity_score")


def ref_p16_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _profiles(spark, d).na.fill(0.0)
    return rows.select("publish_date", "ts_code", profiles.profile_label().alias("label"))


def ref_p11_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("publish_date", "ts_code", r4(clamp(number("negative_shock_carry"), 0.0, 1.0)).alias("carry"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if n.startswith("ref_")}
    return own | {f"ref_a10_ranking_{p}": _ranked(p) for p in ("direct", "state", "event", "optimized")}
