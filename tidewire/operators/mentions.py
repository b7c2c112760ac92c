"""Stock mentions: deterministic structuring of an article, results of an outside model, and their merge per stock."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wordlists as W
from tidewire.functions.text import any_of, clamp, hits_exact, join_bar, number, r4, split_bar, title_and_body, unique_texts
from tidewire.operators.matching import coarse_match

UNKNOWN_TREND, MIXED_TREND = "未知", "震荡"


def event_weight(event: Column) -> Column:
    w = F.lit(W.OTHER_WEIGHT)
    for name, value in W.EVENT_WEIGHTS.items():
        w = F.when(event == name, value).otherwise(w)
    return w


def mention_weight(of: Callable[[str], Column] = F.col) -> Column:
    """How much a mention counts: relevance, confidence, importance, strength and event together. Missing numbers count as 0."""
    return F.greatest(number(of("relevance")), F.lit(0.05)) * F.greatest(number(of("confidence")), F.lit(0.05)) * F.greatest(number(of("event_importance")), F.lit(0.1)) * (0.5 + 0.5 * F.greatest(number(of("sentiment_strength")), F.lit(0.0))) * event_weight(of("event_type"))


def event_type(content: Column) -> Column:
    """The first event whose words stand in the text."""
    out = F.lit(W.OTHER_EVENT)
    for name, listed in reversed(W.EVENTS.items()):
        out = F.when(any_of(content, listed), name).otherwise(out)
    return out


def rule_mentions(news: DataFrame, candidates: DataFrame, key: str = "record_no", body_limit: int = 1600) -> DataFrame:
    """One mention for each candidate stock of an article, by word lists alone; columns only, no Python.

    ``candidates`` is the result of :func:`coarse_match`. All word hits are of the article, so its stocks differ by their aliases.
    """
    content = F.col("_content")
    article = news.withColumn("_content", title_and_body(limit=body_limit)).select(F.col(key), F.coalesce("title", F.lit("")).alias("_title"), hits_exact(content, W.POSITIVE).alias("_up"), hits_exact(content, W.NEGATIVE).alias("_down"), hits_exact(content, W.RISK).alias("_risk"), event_type(content).alias("event_type"), any_of(content, W.TREND_UP).alias("_rises"), any_of(content, W.TREND_DOWN).alias("_falls"))
    rows = candidates.join(article, key)
    moved = (F.size("_up") + F.size("_down") > 0).cast("int")
    named = F.exists("matched_aliases", lambda a: F.contains(F.col("_title"), a))
    s = F.col("sentiment")
    rows = rows.withColumn("sentiment", r4(clamp(0.18 * F.size("_up") - 0.2 * F.size("_down") + F.when(named, 0.08).otherwise(0.0), -1.0, 1.0)))
    trend = (
        F.when(F.col("_rises"), F.when(s >= -0.05, "上升").otherwise(MIXED_TREND)).when(F.col("_falls"), F.when(s <= 0.05, "下降").otherwise(MIXED_TREND))
        .when(s > 0.15, "上升").when(s < -0.15, "下降").otherwise(MIXED_TREND)
    )
    return rows.select(
        key, "ts_code", F.col("name").alias("stock_name"), "event_type", F.concat("name", F.lit("相关"), "event_type", F.lit("信息")).alias("event_summary"), "sentiment",
        r4(clamp(F.abs(s) + 0.08 * moved, 0.05, 1.0)).alias("sentiment_strength"),
        r4(clamp(0.55 + 0.10 * F.size("matched_aliases") + 0.06 * F.greatest(moved, (F.size("_risk") > 0).cast("int")), 0.0, 0.95)).alias("confidence"),
        r4(clamp((F.col("coarse_score") + 0.75) / 2, 0.0, 1.0)).alias("relevance"),
        r4(clamp(event_weight(F.col("event_type")) / 1.15, 0.2, 1.0)).alias("event_importance"),
        ((F.size("_risk") > 0) | (F.col("event_type") == "风险")).cast("int").alias("risk_flag"), trend.alias("trend_signal"),
        F.slice(unique_texts(F.concat("matched_aliases", "_up", "_down", "_risk")), 1, 6).alias("keywords"), "coarse_score", join_bar(F.col("matched_aliases")).alias("matched_aliases"),
    )


def article_overview(news: DataFrame, mentions: DataFrame, key: str = "record_no") -> DataFrame:
    """``key, article_summary, overall_sentiment``: the title's start and the relevance-weighted sentiment of its mentions."""
    overall = mentions.groupBy(key).agg((F.sum(F.col("sentiment") * F.col("relevance")) / F.sum(F.greatest("relevance", F.lit(0.05)))).alias("o"))
    title = F.coalesce("title", F.lit(""))
    summary = F.when(title == "", "新闻摘要").otherwise(F.substring(title, 1, 80))
    return news.join(overall, key, "left").select(key, summary.alias("article_summary"), r4(clamp(F.coalesce("o", F.lit(0.0)), -1.0, 1.0)).alias("overall_sentiment"))


_MODEL_ROW = "ts_code string, event_type string, event_summary string, sentiment double, sentiment_strength double, confidence double, relevance double, event_importance double, risk_flag int, trend_signal string, keywords array<string>"


def extract_json(reply: str) -> dict | None:
    """The object between the first and the last brace of a model's reply."""
    m = re.search(r"\{[\s\S]*\}", reply or "")
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def prompt_lines(candidates: list[dict]) -> str:
    """The candidates for a model, a JSON object a line."""
    return "\n".join(json.dumps({k: c[k] for k in ("ts_code", "name", "industry", "matched_aliases")}, ensure_ascii=False) for c in candidates)


def model_mentions(news: DataFrame, candidates: DataFrame, ask: Callable[[str, str, str], str], key: str = "record_no", body_limit: int = 1600) -> tuple[DataFrame, DataFrame]:
    """Mentions from an outside model, and the articles it failed on (``key, reason``).

    ``ask(title, body, candidates as text)`` returns the model's reply; it is called on the executors, once an article. Codes that are no candidates
    are dropped; numbers are clamped; relevance is averaged with the match score; a strength of 0 becomes the size of the sentiment.
    """
    listed = candidates.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("candidate_rank", "ts_code", "name", "industry", "matched_aliases", "coarse_score")))).alias("_candidates"))
    rows = news.select(key, F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("body", F.lit("")), 1, body_limit).alias("body")).join(listed, key)
    kind = dict(rows.dtypes)[key]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, title, body, cands in b.itertuples(index=False):
                error, mentions = None, "[]"
                try:
                    found = extract_json(ask(title, body, prompt_lines(json.loads(cands))))
                    error, mentions = ("llm_error:ValueError", "[]") if found is None else (None, json.dumps(found.get("mentions") or [], ensure_ascii=False))
                except Exception as e:  # the article is skipped and its reason kept
                    error = f"llm_error:{type(e).__name__}"
                out.append((k, mentions, error))
            yield pd.DataFrame(out, columns=[key, "_mentions", "reason"])

    from tidewire.runtime import cut

    replies = cut(rows.select(key, "title", "body", "_candidates").mapInPandas(call, f"{key} {kind}, _mentions string, reason string"))
    told = replies.where("reason is null").select(key, F.explode(F.from_json("_mentions", f"array<struct<{_MODEL_ROW.replace(' ', ':').replace(',:', ',')}>>")).alias("m")).select(key, "m.*")
    rows = told.join(candidates.select(key, "ts_code", "name", "matched_aliases", "coarse_score"), [key, "ts_code"])
    strength = F.when(number("sentiment_strength") != 0, number("sentiment_strength")).otherwise(F.abs(number("sentiment")))
    mentions = rows.select(
        key, "ts_code", F.col("name").alias("stock_name"), "event_type",
        F.when(F.trim(F.coalesce("event_summary", F.lit(""))) == "", F.concat("name", F.lit("相关"), "event_type", F.lit("舆情"))).otherwise(F.col("event_summary")).alias("event_summary"),
        r4(clamp(number("sentiment"), -1.0, 1.0)).alias("sentiment"), r4(clamp(strength, 0.0, 1.0)).alias("sentiment_strength"), r4(clamp(number("confidence"), 0.0, 1.0)).alias("confidence"),
        r4(clamp((number("relevance") + F.col("coarse_score")) / 2, 0.0, 1.0)).alias("relevance"), r4(clamp(number("event_importance"), 0.0, 1.0)).alias("event_importance"),
        (F.coalesce("risk_flag", F.lit(0)) != 0).cast("int").alias("risk_flag"), "trend_signal", F.slice(unique_texts(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), "matched_aliases")), 1, 6).alias("keywords"), "coarse_score", join_bar(F.col("matched_aliases")).alias("matched_aliases"),
    )
    return mentions, replies.where("reason is not null").select(key, "reason")


def merge_mentions(mentions: DataFrame, article: str = "news_id", order: list[str] | None = None) -> DataFrame:
    """One row for each article and stock from any number of mentions of it.

    Sentiment, strength, confidence and relevance are weighted means, importance the largest, risk any; event types come by total weight, summaries
    (two at most) and keywords (six at most) by weight. One known trend stays, several are mixed. Equal weights are ordered by ``order``.
    Keywords may be an array or joined with bars.
    """
    order = order or ["event_type", "event_summary"]
    listed = F.col("keywords") if mentions.schema["keywords"].dataType.typeName() == "array" else split_bar("keywords")
    rows = mentions.select("*", mention_weight().alias("_w"), listed.alias("_words"))
    first = F.struct((-F.col("_w")).alias("w"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"o{i}") for i, c in enumerate(order)], F.col("event_summary").alias("summary"), F.col("_words").alias("words"), F.col("trend_signal").alias("trend"), F.col("stock_name").alias("name"), F.col("event_type").alias("event"))
    mean = lambda c: F.when(F.sum("_w") > 1e-6, F.sum(number(c) * F.col("_w")) / F.sum("_w")).otherwise(0.0)
    known = F.when((F.coalesce("trend_signal", F.lit("")) != "") & (F.col("trend_signal") != UNKNOWN_TREND), F.col("trend_signal"))
    grouped = rows.groupBy(article, "ts_code").agg(
        F.array_sort(F.collect_list(first)).alias("_all"), F.collect_set(known).alias("_trends"),
        r4(clamp(mean("sentiment"), -1.0, 1.0)).alias("sentiment"), r4(clamp(mean("sentiment_strength"), 0.0, 1.0)).alias("sentiment_strength"), r4(clamp(mean("confidence"), 0.0, 1.0)).alias("confidence"),
        r4(clamp(mean("relevance"), 0.0, 1.0)).alias("relevance"), r4(clamp(F.max(number("event_importance")), 0.0, 1.0)).alias("event_importance"),
        F.max((F.coalesce("risk_flag", F.lit(0)) != 0).cast("int")).alias("risk_flag"), F.count(F.lit(1)).cast("int").alias("merged_event_count"),
    )
    # an article has few mentions of a stock: event weights are summed inside the collected list
    total = lambda e: r4(F.aggregate(F.filter("_all", lambda m: m["event"].eqNullSafe(e)), F.lit(0.0), lambda a, m: a - m["w"]))
    events = F.array_sort(F.transform(F.array_distinct(F.transform("_all", lambda m: m["event"])), lambda e: F.struct((-total(e)).alias("w"), (-event_weight(e)).alias("v"), e.alias("event"))))
    summaries = unique_texts(F.transform("_all", lambda m: m["summary"]))
    out = grouped.withColumn("_events", F.transform(events, lambda e: e["event"])).withColumn("_said", summaries)
    trend = F.when(F.size("_trends") == 1, F.col("_trends")[0]).when(F.size("_trends") > 1, MIXED_TREND).otherwise(F.col("_all")[0]["trend"])
    said = F.concat(F.array_join(F.slice("_said", 1, 2), "；"), F.when(F.size("_said") > 2, "等").otherwise(""))
    return out.select(
        article, "ts_code", F.col("_all")[0]["name"].alias("stock_name"), F.col("_events")[0].alias("event_type"), said.alias("event_summary"), "sentiment", "sentiment_strength", "confidence", "relevance", "event_importance", "risk_flag",
        trend.alias("trend_signal"), join_bar(F.slice(unique_texts(F.flatten(F.transform("_all", lambda m: m["words"]))), 1, 6)).alias("keywords"), join_bar(F.col("_events")).alias("merged_event_types"), "merged_event_count",
    )


def structure_news(news: DataFrame, universe: DataFrame, key: str = "record_no", most: int = 8, body_limit: int = 1600, ask: Callable[[str, str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged mentions of all articles (with the article's date, time and match), and the articles skipped with the reason."""
    candidates = coarse_match(news, universe, key, most)
    if ask is None:
        told, failed = rule_mentions(news, candidates, key, body_limit), None
    else:
        told, failed = model_mentions(news, candidates, ask, key, body_limit)
    matched = candidates.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("candidate_count"))
    per_stock = candidates.select(key, "ts_code", "coarse_score", join_bar(F.col("matched_aliases")).alias("matched_aliases"))
    merged = merge_mentions(told, key).join(per_stock, [key, "ts_code"])
    article = news.select(key, F.col("id").alias("news_id"), "publish_date", "publish_time", "title")
    mentions = merged.join(article, key).drop(key)
    skipped = article.join(matched, key, "left").join(told.select(key).distinct().withColumn("_told", F.lit(1)), key, "left")
    reason = F.when(F.col("candidate_count").isNull(), "no_alias_match").otherwise("no_relevant_stock_after_llm")
    if failed is not None:
        skipped = skipped.join(failed, key, "left")
        reason = F.coalesce("reason", reason)
    skipped = skipped.where("_told is null").select("news_id", "publish_time", "title", reason.alias("reason"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))
    return mentions, skipped
