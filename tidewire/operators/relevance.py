"""Keyword filters and relevance scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wordlists as W
from tidewire.functions.text import any_of, count_weighted, hits, join_bar, r4, split_bar, title_and_body


def keyword_arguments(given: list[str] | None) -> list[str]:
    return [p.strip() for g in given or [] for p in re.split("[，,;；]", str(g)) if p.strip()]


def keyword_filter(news: DataFrame, keywords: list[str] | None) -> DataFrame:
    """Rows whose title or body has one of the literals, case counting; no literals keep all rows."""
    wanted = keyword_arguments(keywords)
    return news.where(any_of(title_and_body(), wanted)) if wanted else news


def date_range(news: DataFrame, start: str | None = None, end: str | None = None, empty: str = "compare") -> DataFrame:
    """Rows by text comparison of ``publish_date``. Empty dates are compared like any text, or all kept (``keep``), or all dropped (``drop``)."""
    day = F.coalesce("publish_date", F.lit(""))
    inside = F.lit(True)
    if start:
        inside &= day >= start
    if end:
        inside &= day <= end
    if empty == "keep":
        inside |= day == ""
    elif empty == "drop":
        inside &= day != ""
    return news.where(inside)


def _with_hits(news: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """The lower-case text and title once, then for each list the words hit (``_<name>``) and those in the title (``_<name>_t``)."""
    rows = news.withColumns({"_both": F.lower(title_and_body()), "_low": F.lower(F.coalesce("title", F.lit("")))})
    found = {f"_{n}": hits(F.col("_both"), v) for n, v in lists.items()} | {f"_{n}_t": hits(F.col("_low"), v) for n, v in lists.items()}
    return rows.withColumns(found)


def _without_hits(rows: DataFrame, lists: dict[str, list[str]], *more: str) -> DataFrame:
    return rows.drop("_both", "_low", *more, *[f"_{n}{t}" for n in lists for t in ("", "_t")])


def _points(weights: list[tuple[str, float, float]]) -> Column:
    return sum((count_weighted(F.col(f"_{n}"), F.col(f"_{n}_t"), a, b) for n, a, b in weights), F.lit(0.0))


def broad_relevance(news: DataFrame) -> DataFrame:
    """Adds ``filter_score``, ``filter_keep`` and the hit words of each list joined with bars."""
    lists = {"strong": W.STRONG, "weak": W.WEAK, "out": W.EXCLUDE}
    rows = _with_hits(news, lists).withColumn("filter_score", r4(_points([("strong", 3.0, 2.0), ("weak", 1.5, 1.0), ("out", -3.0, -2.0)])))
    strong = F.size("_strong") > 0
    wanted = strong | (F.size("_weak") >= 2) | (F.col("filter_score") >= 3.0)
    vetoed = (F.size("_out") > 0) & ~strong & (F.col("filter_score") < 4.0)
    rows = rows.withColumns({"filter_keep": wanted & ~vetoed, "strong_hits": join_bar(F.col("_strong")), "weak_hits": join_bar(F.col("_weak")), "exclude_hits": join_bar(F.col("_out"))})
    return _without_hits(rows, lists)


def strict_relevance(news: DataFrame) -> DataFrame:
    """The stricter decision: company words count, a second list of exclusions vetoes."""
    lists = {"strong": W.STRONG, "weak": W.WEAK, "firm": W.COMPANY, "out": W.EXCLUDE, "never": W.STRICT_EXCLUDE}
    rows = _with_hits(news, lists).withColumn("filter_score", r4(_points([("strong", 3.5, 2.5), ("weak", 1.2, 0.8), ("firm", 0.8, 0.4), ("out", -3.0, -2.0), ("never", -2.5, -1.5)])))
    score, strong = F.col("filter_score"), F.size("_strong") > 0
    wanted = (strong & (score >= 3.0)) | ((F.size("_firm") > 0) & (F.size("_weak") >= 2) & (score >= 3.5)) | (score >= 5.0)
    vetoed = (F.size("_never") > 0) & ~strong & (score < 6.0)
    rows = rows.withColumns({"filter_keep": wanted & ~vetoed, "strong_hits": join_bar(F.col("_strong")), "weak_hits": join_bar(F.concat("_weak", "_firm")), "exclude_hits": join_bar(F.concat("_out", "_never"))})
    return _without_hits(rows, lists)


def study_relevance(records: DataFrame, positive: dict[str, list[str]] | None = None, negative: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``study_score``, ``study_keep``, hit words and the name flags to records with ``primary_stock_name`` and ``matched_aliases``."""
    positive = W.STUDY_POSITIVE_BY_STOCK if positive is None else positive
    negative = W.STUDY_NEGATIVE_BY_STOCK if negative is None else negative
    name = F.coalesce("primary_stock_name", F.lit(""))
    lists = {"fin": W.STUDY_FINANCE, "neg": W.STUDY_NEGATIVE}

    def own(listed: dict[str, list[str]], x: str) -> Column:
        found = F.array().cast("array<string>")
        for stock, words in listed.items():
            found = F.when(name == stock, hits(F.col(x), words)).otherwise(found)
        return found

    rows = _with_hits(records, lists).withColumns({"_own": own(positive, "_both"), "_own_t": own(positive, "_low"), "_bad": own(negative, "_both"), "_bad_t": own(negative, "_low"), "_aliases": split_bar("matched_aliases")})
    rows = rows.withColumn("_full", F.array_contains("_aliases", name) | F.contains(title_and_body(), name)).withColumn("_only", (F.size("_aliases") > 0) & ~F.col("_full"))
    untitled = F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", "") == ""
    score = F.when(F.col("_full"), 4.0).when(F.col("_only"), 1.0).otherwise(0.0) + _points([("fin", 1.8, 0.7), ("own", 1.6, 0.6), ("neg", -1.6, -0.7), ("bad", -2.0, -1.0)]) - F.when(untitled, 0.5).otherwise(0.0)
    rows = rows.withColumn("study_score", r4(score))
    s, full, only = F.col("study_score"), F.col("_full"), F.col("_only")
    wanted = (full & (s >= 4.5) & ((F.size("_fin") > 0) | (F.size("_own") >= 2))) | ((s >= 7.0) & ((F.size("_fin") >= 2) | (F.size("_own") >= 3)))
    keep = wanted & ~(only & (s < 8.5)) & ~((F.size("_neg") > 0) & ~full & (s < 9.5))
    out = {"study_keep": keep, "study_finance_hits": join_bar(F.col("_fin")), "study_stock_hits": join_bar(F.col("_own")), "study_negative_hits": join_bar(F.concat("_neg", "_bad")), "study_has_full_name": full.cast("int"), "study_alias_only": only.cast("int")}
    return _without_hits(rows.withColumns(out), lists, "_own", "_own_t", "_bad", "_bad_t", "_aliases", "_full", "_only")
