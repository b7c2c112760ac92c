"""Cross-sectional rankings from factor columns under a configurable list of factors."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import clamp, number, r4


@dataclass(frozen=True)
class Factor:
    name: str
    weight: float
    group: str
    direction: int = 1
    label: str = ""


#: Name, weight by default, optimised weight, group, direction.
TABLE = [
    ("net_sentiment_factor", 0.08, 0.06, "direct", 1),
    ("negative_shock_factor", 0.04, 0.06, "direct", -1),
    ("attention_factor", 0.08, 0.06, "direct", 1),
    ("composite_score", 0.08, 0.06, "direct", 1),
    ("event_novelty_factor", None, 0.05, "direct", 1),
    ("ema5_sentiment_state", 0.14, 0.10, "state", 1),
    ("negative_shock_carry", 0.09, 0.08, "state", -1),
    ("state_composite_factor", 0.14, 0.10, "state", 1),
    ("sentiment_confirmation_factor", None, 0.12, "state", 1),
    ("coverage_reliability_factor", None, 0.09, "reliability", 1),
    ("sentiment_dispersion_factor", None, 0.08, "reliability", -1),
    ("earnings_event_state", 0.05, 0.04, "event", 1),
    ("operations_event_state", 0.17, 0.12, "event", 1),
    ("market_buzz_event_state", 0.05, 0.04, "event", 1),
    ("risk_event_state", 0.08, 0.10, "event", -1),
    ("event_density_factor", None, 0.04, "event", 1),
]
_DIRECT = ["net_sentiment_factor", "negative_shock_factor", "attention_factor", "composite_score"]
_STATE = [*_DIRECT, "ema5_sentiment_state", "negative_shock_carry", "state_composite_factor"]


def preset(name: str) -> list[Factor]:
    """The factors of ``direct``, ``state``, ``event`` (the same as ``all``) or ``optimized``."""
    plain = [Factor(n, w, g, d) for n, w, _, g, d in TABLE if w is not None]
    known = {"direct": [f for f in plain if f.name in _DIRECT], "state": [f for f in plain if f.name in _STATE], "event": plain, "all": plain, "optimized": [Factor(n, w, g, d) for n, _, w, g, d in TABLE]}
    if name not in known:
        raise ValueError(f"unknown preset: {name}")
    return known[name]


def factors_from_json(content: str) -> list[Factor]:
    """A list, or ``{"factors": [...]}``, of objects with ``name`` and optional label, group, weight and direction (its sign; 0 counts as 1)."""
    found = json.loads(content)
    listed = found.get("factors", []) if isinstance(found, dict) else found
    return [Factor(f["name"], float(f.get("weight", 1.0)), f.get("group", "custom"), -1 if float(f.get("direction", 1)) < 0 else 1, f.get("label", f["name"])) for f in listed]


def add_derived(frame: DataFrame) -> DataFrame:
    """Confirmation (the lesser of sentiment and its state) and coverage, where their inputs exist."""
    have = set(frame.columns)
    if {"net_sentiment_factor", "ema5_sentiment_state"} <= have:
        frame = frame.withColumn("sentiment_confirmation_factor", clamp(F.least(number("net_sentiment_factor"), number("ema5_sentiment_state")), -1.0, 1.0))
    if {"article_count", "mention_count", "attention_factor", "sentiment_dispersion_factor"} <= have:
        part = lambda c, full: clamp(number(c) / full, 0.0, 1.0)
        cover = 0.30 * part("article_count", 3.0) + 0.20 * part("mention_count", 3.0) + 0.20 * part("attention_factor", 0.65) + 0.30 * (1.0 - part("sentiment_dispersion_factor", 0.8))
        frame = frame.withColumn("coverage_reliability_factor", clamp(cover, 0.0, 1.0))
    return frame


def reliability(frame: DataFrame) -> Column:
    """The multiplier 0.70 to 1; an input that is no column counts as one half."""
    have, half = frame.columns, F.lit(0.5)
    coverage = number("coverage_reliability_factor", 0.5) if "coverage_reliability_factor" in have else half
    steady = 1.0 - clamp(number("sentiment_dispersion_factor") / 0.8, 0.0, 1.0) if "sentiment_dispersion_factor" in have else half
    novel = clamp(F.abs(number("event_novelty_factor")) / 0.9, 0.0, 1.0) if "event_novelty_factor" in have else half
    return clamp(0.70 + 0.20 * coverage + 0.10 * (0.6 * steady + 0.4 * novel), 0.70, 1.00)


def percentile(frame: DataFrame, columns: dict[str, Column], partition: str = "publish_date", suffix: str = "__signal") -> DataFrame:
    """Average rank over number of values within the partition; null stays null, a constant cross-section is one half.

    Ranks come from counts of distinct values, pre-aggregated before the shuffle: (values below + half of the ties and one more) / n. So a window
    holds distinct values only, never a partition's rows.
    """
    for name, value in columns.items():
        v = f"_v_{name}"
        clean = value.try_cast("double")
        frame = frame.withColumn(v, F.round(F.when(~F.isnan(clean), clean), 12))
        counts = frame.where(F.col(v).isNotNull()).groupBy(partition, v).agg(F.count(F.lit(1)).alias("_t"))
        up = Window.partitionBy(partition).orderBy(v)
        whole = Window.partitionBy(partition)
        n, below = F.sum("_t").over(whole), F.sum("_t").over(up.rowsBetween(Window.unboundedPreceding, -1))
        level = F.when(F.count(F.lit(1)).over(whole) <= 1, 0.5).otherwise((F.coalesce(below, F.lit(0)) + (F.col("_t") + 1) / 2) / n)
        ranks = counts.select(F.col(partition).alias("_p"), F.col(v).alias("_w"), level.alias(f"{name}{suffix}"))
        frame = frame.join(ranks, (frame[partition] == F.col("_p")) & (frame[v] == F.col("_w")), "left").drop("_p", "_w", v)
    return frame


def percentile_by_window(frame: DataFrame, columns: dict[str, Column], partition: str = "publish_date", suffix: str = "__signal") -> DataFrame:
    """The same for many columns at once, where a partition's rows (a cross-section of the universe) fit one task: one shuffle, a sort a column."""
    values = {f"_v_{name}": value.try_cast("double") for name, value in columns.items()}
    frame = frame.withColumns({v: F.round(F.when(~F.isnan(x), x), 12) for v, x in values.items()})
    frame = frame.withColumns({f"_n_{name}": F.count(f"_v_{name}").over(Window.partitionBy(partition)) for name in columns})
    out = []
    for name in columns:
        v, n = F.col(f"_v_{name}"), F.col(f"_n_{name}")
        order = Window.partitionBy(partition).orderBy(v.asc_nulls_last())
        ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # in the sort that the rank needs anyway
        out.append(F.when(v.isNull(), None).when(ties == n, 0.5).otherwise((F.rank().over(order) + (ties - 1) / 2) / n).alias(f"{name}{suffix}"))
    return frame.select("*", *out).drop(*values, *[f"_n_{name}" for name in columns])


def score(frame: DataFrame, factors: list[Factor], suffix: str = "__signal", group: str | None = None) -> Column:
    """Weighted mean of the signals there are (a missing one counts as one half). A group without factors scores 0; no factor at all is an error."""
    used = [f for f in factors if f"{f.name}{suffix}" in frame.columns and (group is None or f.group == group)]
    whole = sum(abs(f.weight) for f in used)
    if not used or not whole:
        if group is None:
            raise ValueError("no factor column to rank by" if not used else "the weights add up to 0")
        return F.lit(0.0)
    return sum((F.coalesce(F.col(f"{f.name}{suffix}"), F.lit(0.5)) * f.weight for f in used), F.lit(0.0)) / whole


def rank_stocks(frame: DataFrame, factors: list[Factor], top_k: int = 5) -> DataFrame:
    """Signals, group scores, base and final score, rank in the date (score falling, then code) and the top-k flag.

    Factors that are no column are skipped. Any further columns stay.
    """
    ranked = add_derived(frame)
    used = [f for f in factors if f.name in ranked.columns]
    ranked = percentile_by_window(ranked, {f.name: F.col(f.name).try_cast("double") * f.direction for f in used})
    groups = list(dict.fromkeys(f.group for f in factors))
    ranked = ranked.withColumns({f"{g}_group_score": r4(score(ranked, factors, group=g)) for g in groups} | {"base_ranking_score": score(ranked, factors), "reliability_multiplier": reliability(ranked)})
    ranked = ranked.withColumn("ranking_score", F.round(0.5 + (F.col("base_ranking_score") - 0.5) * F.col("reliability_multiplier"), 10))
    order = Window.partitionBy("publish_date").orderBy(F.desc("ranking_score"), *(["ts_code"] if "ts_code" in ranked.columns else []))
    return ranked.withColumn("rank_in_date", F.row_number().over(order)).withColumn("selected_topk", (F.col("rank_in_date") <= max(1, top_k)).cast("int"))


def summarise(ranked: DataFrame, factors: list[Factor], top_k: int) -> dict:
    """Numbers of dates and stocks, mean cross-section, and the top-k of each date (k rows a date reach the driver)."""
    sizes = ranked.groupBy("publish_date").agg(F.count_distinct("ts_code").alias("n")).agg(F.count(F.lit(1)).alias("dates"), F.avg("n").alias("mean")).first()
    groups = [f"{g}_group_score" for g in dict.fromkeys(f.group for f in factors) if f"{g}_group_score" in ranked.columns]
    names = [c for c in ("ts_code", "stock_name") if c in ranked.columns]
    item = F.struct(F.col("rank_in_date").alias("rank"), F.round("ranking_score", 4).alias("ranking_score"), *names, *groups)
    days = ranked.where("selected_topk = 1").groupBy("publish_date").agg(F.count(F.lit(1)).alias("selected_count"), F.array_sort(F.collect_list(item)).alias("selected_stocks")).orderBy("publish_date").collect()
    return {
        "top_k": top_k, "date_count": sizes["dates"], "stock_count": ranked.select("ts_code").distinct().count(), "avg_cross_section_size": round(sizes["mean"] or 0.0, 4),
        "factor_weights": [f.__dict__ for f in factors], "topk_by_date": [{"publish_date": str(d[0]), "selected_count": d[1], "selected_stocks": [s.asDict() for s in d[2]]} for d in days],
    }


def ranking_columns(ranked: DataFrame) -> DataFrame:
    """What a ranking file holds: keys, scores and ranks, then group scores and signals in name order."""
    lead = [c for c in ("publish_date", "ts_code", "stock_name", "industry", "ranking_score", "rank_in_date", "selected_topk", "article_count", "mention_count", "profile_label") if c in ranked.columns]
    return ranked.select(*lead, *sorted(c for c in ranked.columns if c.endswith("_group_score")), *sorted(c for c in ranked.columns if c.endswith("__signal")))
