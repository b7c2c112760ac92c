"""The whole way from raw news to a report, each step a lazy plan over the last one's table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import ingest, matching, mentions, profiles, ranking, relevance, returns, selection, validation
from tidewire.runtime import cut
from tidewire.sources import files, sinks


def load_news(spark: SparkSession, path: str, languages: list[str] | None = None, limit: int = 0, dedup_files: bool = True) -> DataFrame:
    """Normalised news of all files below ``path``, numbered as ``record_no``; with ``dedup_files`` rows that repeat across files once.

    ``limit`` is for small trials: files are read in turn, each up to the limit less the rows that those before it gave.
    """
    raw = files.read_raw_news(spark, path)
    if limit:
        parts, left = [], limit
        for file in [r[0] for r in raw.select("raw_source_file").distinct().orderBy("raw_source_file").collect()]:
            part = cut(ingest.normalise_news(raw.where(F.col("raw_source_file") == file).orderBy("line_no").limit(left), languages))
            parts.append(part)
            left -= part.count()
            if left <= 0:
                break
        news = reduce(DataFrame.unionByName, parts) if parts else ingest.normalise_news(raw, languages)
    else:
        news = ingest.normalise_news(raw, languages)
    if dedup_files:
        news = ingest.dedup_across_files(news, ["raw_source_file", "line_no"])
    return news.withColumn("record_no", F.xxhash64("raw_source_file", "line_no"))


def run_baseline(spark: SparkSession, news: DataFrame, universe: DataFrame, out: str | None = None, keywords: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 0, max_candidates: int = 8, max_body_chars: int = 1600, ask: Callable[[str, str, str], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Article mentions, daily profiles and skipped news; written as CSV under ``out`` if given."""
    chosen = relevance.date_range(relevance.keyword_filter(news, keywords), date_from, date_to)
    if limit:
        chosen = chosen.orderBy("raw_source_file", "line_no").limit(limit)
    told, skipped = mentions.structure_news(chosen, universe, "record_no", max_candidates, max_body_chars, ask)
    told = cut(told)
    daily = profiles.daily_profiles(told, universe)
    if out:
        sinks.write_baseline(told, daily, skipped, out)
    return told, daily, skipped


def experiment_set(news: DataFrame, universe: DataFrame, most_per_stock: int = 500, most_total: int = 2500, date_from: str | None = "2020-01-01", date_to: str | None = None) -> DataFrame:
    dated = relevance.date_range(news, date_from, date_to, "keep")
    return selection.experiment_subset(dated, matching.record_match(dated, universe), "record_no", ["raw_source_file", "line_no"], most_per_stock, most_total)


def experiment_counts(news: DataFrame, subset: DataFrame, most_total: int = 0, order: tuple[str, ...] = ("raw_source_file", "line_no")) -> dict[str, Any]:
    """Records looked at, kept and rejected, and kept ones by stock. A subset that is full at ``most_total`` ends the looking at its last record."""
    subset = cut(subset)
    kept = subset.count()
    seen = news
    if most_total and kept >= most_total:
        last = subset.agg(F.max(F.struct(*order)).alias("o")).first()["o"]
        seen = news.where(F.struct(*order) <= F.struct(*[F.lit(x) for x in last]))
    total = seen.count()
    stocks = subset.select(F.explode(F.split("matched_ts_codes", r"\|")).alias("c")).groupBy("c").count().orderBy("c").collect()
    return {"total": total, "kept": kept, "rejected": total - kept, "counts_by_stock": {r[0]: r[1] for r in stocks}, "files_scanned": seen.select("raw_source_file").distinct().count()}


def quarter_candidates(raw: DataFrame, universe: DataFrame, date_from: str, date_to: str, language: str = "zh", k: int = 10, body_limit: int = 1600) -> tuple[DataFrame, dict[str, Any]]:
    """The ``k`` best matches of each date and stock from raw lines, one row an article and stock, and the counts of the way there.

    ``universe`` is that of :func:`files.quarter_universe`. Articles of one id count once for a stock: the first in file order.
    """
    news = ingest.normalise_raw_record(raw).withColumn("record_no", F.xxhash64("raw_source_file", "line_no"))
    chosen = ingest.drop_empty(news.where((F.col("language") == language) & (F.col("publish_date") >= date_from) & (F.col("publish_date") <= date_to)))
    matched = matching.quarter_match(chosen, universe, "record_no", body_limit)
    article = chosen.select("record_no", F.col("id").alias("orig_news_id"), "title", "body", "publish_date", "language", "raw_source_file", "line_no")
    once = cut(ingest.first_of(matched.join(article, "record_no"), ["orig_news_id", "ts_code"], ["raw_source_file", "line_no"]))
    best = cut(selection.heap_topk(once, k))
    out = best.select(
        F.concat_ws("__", "orig_news_id", "ts_code").alias("id"), "orig_news_id", "title", "body", "publish_date", F.col("publish_date").alias("publish_time"), "language", F.lit("").alias("source"), F.lit("").alias("url"), "raw_source_file",
        F.col("ts_code").alias("primary_ts_code"), F.col("stock_name").alias("primary_stock_name"), "industry", "matched_aliases", F.lit(1).alias("matched_stock_count"), F.col("score").alias("study_score"), F.col("has_full_name").alias("study_has_full_name"),
        F.col("finance_hits").alias("study_finance_hits"), F.col("noise_hits").alias("study_negative_hits"), F.col("title_hits").alias("title_hit_count"), F.col("body_hits").alias("body_hit_count"), "place_in_day",
    )
    by_stock = selection.counts_by_stock(best).orderBy("ts_code").collect()
    counts = {
        "raw_articles_scanned": news.count(), "matched_articles": once.select("record_no").distinct().count(), "candidate_matches_before_topk": once.count(), "topk_records_written": best.count(),
        "group_count": best.select("publish_date", "ts_code").distinct().count(), "top_k": k, "date_from": date_from, "date_to": date_to,
        "counts_by_stock": {r["ts_code"]: r["records"] for r in by_stock}, "days_by_stock": {r["ts_code"]: r["days"] for r in by_stock},
    }
    return out, counts


def run_batches(spark: SparkSession, folder: str, universe: DataFrame, out: str, start: int = 0, end: int | None = None, skip_existing: bool = True, **baseline: Any) -> list[dict[str, Any]]:
    """The baseline for each batch of :func:`sinks.write_batches` in turn; a batch whose mentions are there already is passed over."""
    done = []
    for path in sorted(files.list_folders(spark, folder, "batch_index="), key=lambda p: int(p.rsplit("=", 1)[1])):
        n = int(path.rsplit("=", 1)[1])
        if n < start or (end is not None and n > end):
            continue
        target = f"{out}/batch_{n}"
        if skip_existing and files.exists(spark, f"{target}_article_mentions/_SUCCESS"):
            done.append({"batch_index": n, "status": "skipped"})
            continue
        told, daily, skipped = run_baseline(spark, spark.read.json(path), universe, target, **baseline)
        done.append({"batch_index": n, "status": "done", "mentions": told.count()})
    return done


def experiment_set_from_raw(raw: DataFrame, universe: DataFrame, languages: tuple[str, ...] = ("zh",), most_per_stock: int = 0, most_total: int = 0, date_from: str | None = "2023-01-01", date_to: str | None = "2023-12-31") -> DataFrame:
    """The same from raw lines: ids are kept as they are, and of matched records with one id the first counts."""
    news = ingest.drop_empty(ingest.keep_languages(ingest.normalise_raw_record(raw), list(languages)))
    news = relevance.date_range(news, date_from, date_to, "keep").withColumn("record_no", F.xxhash64("raw_source_file", "line_no"))
    matched = cut(matching.record_match(news, universe))
    first = ingest.first_of(news.join(matched.select("record_no").distinct(), "record_no", "left_semi"), ["id"], ["raw_source_file", "line_no"], skip_empty=True)
    return selection.experiment_subset(first, matched, "record_no", ["raw_source_file", "line_no"], most_per_stock, most_total)


def rebuild_profiles(batches: list[DataFrame], universe: DataFrame) -> DataFrame:
    """Profiles of all batches together; profiles of single batches must never be put together."""
    numeric = ["sentiment", "sentiment_strength", "confidence", "relevance", "event_importance", "risk_flag", "merged_event_count", "coarse_score"]
    merged = ingest.union_repaired(batches, numeric)
    return profiles.daily_profiles(profiles.distinct_mentions(merged), universe)


def evaluate(ranked: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel with later returns, performance by date and horizon, and its summary."""
    have = [c for c in prices.columns if c.startswith("fwd_return_")]
    prices = prices if have else returns.forward_returns(returns.one_quote_a_day(prices))
    panel = cut(returns.asof_forward(ranked, prices))
    daily = cut(returns.evaluate_topk(panel))
    return panel, daily, returns.summarise_performance(daily)


def run_pipeline(spark: SparkSession, news: DataFrame, universe: DataFrame, prices: DataFrame, preset: str = "optimized", top_k: int = 5, out: str | None = None, names: dict[str, str] | None = None, **baseline: Any) -> dict[str, Any]:
    """Baseline, ranking, evaluation and report; returns the summary, whose tables are under ``out``."""
    steps: list[dict[str, str]] = []

    def done(agent: str, message: str) -> None:
        steps.append({"agent_name": agent, "status": "success", "message": message})

    told, daily, skipped = run_baseline(spark, news, universe, f"{out}/baseline" if out else None, **baseline)
    done("sentiment_analysis_agent", f"{told.count()} mentions")
    daily = cut(daily)
    done("factor_agent", f"{daily.count()} profiles")
    factors = ranking.preset(preset)
    ranked = cut(ranking.rank_stocks(daily, factors, top_k))
    picked = ranking.summarise(ranked, factors, top_k)
    done("ranking_agent", f"{picked['date_count']} dates")
    if not files.covers(prices, ranked):
        done("price_check", "some codes have no quotes")
    panel, perf, summary = evaluate(ranked, prices)
    performance = returns.performance_dict(summary, perf.select("publish_date").distinct().count())
    done("evaluation_agent", f"{performance['date_count']} dates with a selection")
    result = {"ranking_preset": preset, "top_k": top_k, **(names or {}), "steps": steps, "ranking_summary": picked, "performance_summary": performance}
    result["report"] = sinks.run_report(result)
    if out:
        sinks.write_csv(ranking.ranking_columns(ranked), f"{out}/ranking")
        sinks.write_csv(ranking.ranking_columns(ranked.where("selected_topk = 1")), f"{out}/ranking_topk")
        sinks.write_csv(perf, f"{out}/topk_performance")
        sinks.write_summary(spark, picked, f"{out}/ranking_summary.json")
        sinks.write_summary(spark, performance, f"{out}/performance_summary.json")
        sinks.write_summary(spark, {k: v for k, v in result.items() if k != "report"}, f"{out}/pipeline_summary.json")
        sinks.write_text(spark, result["report"], f"{out}/report.md")
    return result


def validate_factors(daily: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """Time-series, cross-section and direction validation of daily profiles."""
    panel = cut(returns.asof_forward(daily.select("publish_date", "ts_code", *validation.FACTORS), prices))
    return {"time_series": validation.time_series(panel), "cross_section": validation.cross_section(panel), "direction": validation.direction(panel)}
