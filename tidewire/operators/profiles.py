"""Mentions to daily stock profiles with their time-series states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewire.functions import wordlists as W
from tidewire.functions.text import clamp, number, r4, split_bar, text
from tidewire.operators.mentions import mention_weight

GROUP = ["publish_date", "ts_code", "stock_name"]
DECAY = 0.65
STATES = ["earnings", "operations", "financing", "market_buzz", "risk"]
#: The columns of a profile, in order.
COLUMNS = [
    "publish_date", "ts_code", "stock_name", "industry", "article_count", "mention_count", "net_sentiment_factor", "negative_shock_factor", "attention_factor",
    "sentiment_dispersion_factor", "event_density_factor", "risk_ratio", "positive_ratio", "neutral_ratio", "negative_ratio", "dominant_event_type", "top_keywords",
    "sentiment_delta_1d", "sentiment_trend_factor", "sentiment_momentum_factor", "ema3_sentiment_state", "ema5_sentiment_state", "negative_shock_carry", "event_novelty_factor",
    "earnings_event_factor", "operations_event_factor", "financing_event_factor", "market_buzz_event_factor", "risk_event_factor",
    "earnings_event_state", "operations_event_state", "financing_event_state", "market_buzz_event_state", "risk_event_state",
    "state_composite_factor", "composite_score", "profile_label",
]


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """Rows that a batch delivered again (equal in all but ``batch_index``) once."""
    return mentions.select(*[c for c in mentions.columns if c != "batch_index"]).distinct()


def _usable(mentions: DataFrame) -> DataFrame:
    return mentions.where((F.coalesce("publish_date", F.lit("")) != "") & F.col("ts_code").isNotNull()).withColumn("stock_name", F.coalesce("stock_name", F.lit("")))


def base_factors(mentions: DataFrame) -> DataFrame:
    """The factors of each date, code and name that need no other day; rounded to four digits.

    A missing number counts as 0. One shuffle of partial sums; the distinct count of articles is exact.
    """
    s, w = number("sentiment"), F.col("_w")
    rows = _usable(mentions).withColumn("_w", mention_weight())
    total = F.greatest(F.sum("_w"), F.lit(1e-6))
    share = lambda c: F.avg(c.cast("double"))
    events = [r4(F.sum(F.when(F.col("event_type") == name, s * w).otherwise(0.0)) / total).alias(f"{base}_event_factor") for name, base in W.EVENT_FACTORS.items()]
    n = F.count(F.lit(1))
    articles = F.count_distinct("news_id")
    positive, negative = share(s > 0.15), share(s < -0.15)
    return rows.groupBy(*GROUP).agg(
        articles.alias("article_count"), n.alias("mention_count"),
        r4(F.sum(s * w) / total).alias("net_sentiment_factor"), r4(F.sum(F.greatest(-s, F.lit(0.0)) * w) / total).alias("negative_shock_factor"),
        r4(F.tanh(F.log1p(articles + n / 2) * F.avg(number("relevance")) / 2)).alias("attention_factor"), r4(F.stddev_pop(s)).alias("sentiment_dispersion_factor"), r4(F.tanh(n / 3)).alias("event_density_factor"),
        r4(share(F.coalesce("risk_flag", F.lit(0)))).alias("risk_ratio"), r4(positive).alias("positive_ratio"), r4(F.greatest(F.lit(0.0), 1 - positive - negative)).alias("neutral_ratio"), r4(negative).alias("negative_ratio"),
        *events,
    )


def dominant_events(mentions: DataFrame) -> DataFrame:
    """The most frequent event type; of equally frequent ones the one of the smallest ``news_id``, then the smallest name."""
    rows = _usable(mentions).withColumn("event_type", F.coalesce("event_type", F.lit("")))
    counts = rows.groupBy(*GROUP, "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("news_id", F.lit(""))).alias("first"))
    best = F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "first", "event_type"))
    return counts.groupBy(*GROUP).agg(best.alias("dominant_event_type"))


def top_keywords(mentions: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` frequent keywords joined with bars; ties go to the one seen first (by ``news_id``, then place in the list)."""
    rows = _usable(mentions).select(*GROUP, F.coalesce("news_id", F.lit("")).alias("id"), F.posexplode(split_bar("keywords")).alias("place", "word"))
    counts = rows.groupBy(*GROUP, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("n"), "first", "word")
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return best.groupBy(*GROUP).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), "|").alias("top_keywords"))


def _recur(batches: Iterator[pa.RecordBatch], key: str, smooth: dict[str, tuple[str, float]], decay: dict[str, tuple[str, float]]) -> Iterator[pa.RecordBatch]:
    """Adds the states to batches that are sorted by key and order; all keys of a batch move on together, a place at a time, and the last one's states go on in the next batch."""
    last_key, last = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key))
        same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False).astype(bool)
        start = np.flatnonzero(np.r_[True, ~same])
        size = np.diff(np.r_[start, len(keys)])
        goes_on = last_key is not None and keys[0].as_py() == last_key
        outs = {}
        for out, (column, a) in [*smooth.items(), *decay.items()]:
            x = np.nan_to_num(pc.fill_null(b.column(b.schema.get_field_index(column)), 0.0).to_numpy(zero_copy_only=False))
            keep, take = (1 - a, a) if out in smooth else (a, 1.0)
            state = np.zeros(len(keys))
            state[start] = x[start]
            if goes_on:
                state[0] = last[out] * keep + x[0] * take
            for t in range(1, int(size.max())):
                at = start[size > t] + t
                state[at] = state[at - 1] * keep + x[at] * take
            outs[out] = state
        last_key, last = keys[-1].as_py(), {o: v[-1] for o, v in outs.items()}
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) for v in outs.values())], names=[*b.schema.names, *outs])


def fold_states(rows: DataFrame, key: str, order: list[str], smooth: dict[str, tuple[str, float]], decay: dict[str, tuple[str, float]]) -> DataFrame:
    """Recursive states along each key's rows in ``order``, in one pass over the sorted rows that keeps the last state only.

    ``smooth``: output to (input, alpha), seeded with the first value; ``decay``: output to (input, factor), seeded with 0. Null and NaN inputs
    count as 0. Rows with a null key have no history: each starts anew.
    """
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields] + [StructField(o, DoubleType()) for o in [*smooth, *decay]])
    return sorted_rows.mapInArrow(lambda it: _recur(it, key, smooth, decay), schema)


def with_states(base: DataFrame) -> DataFrame:
    """Adds differences, means of earlier rows, smoothed and carried states, and the composite scores (all by stock, in the order of dates)."""
    order = Window.partitionBy("ts_code").orderBy("publish_date", "stock_name")
    x = F.col("net_sentiment_factor")
    before = lambda n: F.avg("net_sentiment_factor").over(order.rowsBetween(-n, -1))
    rows = base.withColumns({
        "sentiment_delta_1d": F.coalesce(x - F.lag("net_sentiment_factor", 1).over(order), F.lit(0.0)),
        "sentiment_trend_factor": F.coalesce(x - F.lag("net_sentiment_factor", 3).over(order), F.lit(0.0)),
        "sentiment_momentum_factor": F.coalesce(x - before(3), F.lit(0.0)),
        "event_novelty_factor": F.coalesce(x - before(5), F.lit(0.0)),
    })
    smooth = {"ema3_sentiment_state": ("net_sentiment_factor", 0.5), "ema5_sentiment_state": ("net_sentiment_factor", 1 / 3)} | {f"{s}_event_state": (f"{s}_event_factor", 1 / 3) for s in STATES}
    rows = fold_states(rows, "ts_code", ["publish_date", "stock_name"], smooth, {"negative_shock_carry": ("negative_shock_factor", DECAY)})
    state = [(0.35, "ema3_sentiment_state"), (0.10, "ema5_sentiment_state"), (-0.20, "negative_shock_carry"), (0.10, "attention_factor"), (0.08, "earnings_event_state"), (0.08, "operations_event_state"), (0.07, "financing_event_state"), (0.05, "market_buzz_event_state"), (-0.08, "risk_event_state"), (-0.05, "sentiment_dispersion_factor")]
    total = lambda parts: sum((F.col(c) * w for w, c in parts[1:]), F.col(parts[0][1]) * parts[0][0])
    score = total([(0.45, "net_sentiment_factor"), (-0.25, "negative_shock_factor"), (0.15, "attention_factor")]) + clamp(F.col("sentiment_momentum_factor"), -1.0, 1.0) * 0.15 - F.col("sentiment_dispersion_factor") * 0.10
    return rows.withColumns({"state_composite_factor": clamp(total(state), -1.0, 1.0), "composite_score": clamp(score, -1.0, 1.0)})


#: Thresholds and words of a label.
def profile_label() -> Column:
    a, n, m = F.col("attention_factor"), F.col("net_sentiment_factor"), F.round("sentiment_momentum_factor", 10)
    return F.concat_ws(
        "-",
        F.when(a >= 0.60, "高关注").when(a >= 0.35, "中关注").otherwise("低关注"),
        F.when(n >= 0.20, "偏正面").when(n <= -0.20, "偏负面").otherwise("中性偏稳"),
        F.when(m >= 0.15, "情绪上行").when(m <= -0.15, "情绪走弱").otherwise("趋势平稳"),
        F.when((F.col("negative_shock_factor") >= 0.35) | (F.col("risk_ratio") >= 0.40), "风险升温").otherwise("风险可控"),
    )


def with_industry(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds the industry of ``ts_code`` from the universe, empty where unknown; of several rows of a code the greatest industry counts."""
    industry = universe.groupBy("ts_code").agg(F.max(text("industry")).alias("industry"))
    return rows.drop("industry").join(industry, "ts_code", "left").withColumn("industry", F.coalesce("industry", F.lit("")))


def daily_profiles(mentions: DataFrame, universe: DataFrame) -> DataFrame:
    """The profile of each date, code and name with all of COLUMNS.

    Mentions without date or code take no part. Industry comes from the universe (empty where unknown). An empty table gives an empty result.
    """
    base = base_factors(mentions).join(dominant_events(mentions), GROUP).join(top_keywords(mentions), GROUP, "left").withColumn("top_keywords", F.coalesce("top_keywords", F.lit("")))
    states = with_states(base)
    rows = with_industry(states, universe).withColumn("profile_label", profile_label())
    late = [c for c in COLUMNS if c.endswith(("_state", "_1d", "_carry", "state_composite_factor", "composite_score")) or c in ("sentiment_trend_factor", "sentiment_momentum_factor", "event_novelty_factor")]
    return rows.select(*[r4(F.col(c)).alias(c) if c in late else F.col(c) for c in COLUMNS])


def enhanced_demo(profiles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Recomputed states with a simpler composite, and the weighted sentiment of each event type as columns (0 where there is none)."""
    rows = fold_states(profiles.select(*GROUP, "net_sentiment_factor", "negative_shock_factor", "attention_factor"), "ts_code", ["publish_date", "stock_name"], {"_e3": ("net_sentiment_factor", 0.5), "_e5": ("net_sentiment_factor", 1 / 3)}, {"_carry": ("negative_shock_factor", DECAY)})
    rows = rows.withColumns({"ema3_sentiment_state": r4(F.col("_e3")), "ema5_sentiment_state": r4(F.col("_e5")), "negative_shock_carry": r4(F.col("_carry"))}).drop("_e3", "_e5", "_carry")
    rows = rows.withColumn("state_composite_demo", r4(0.50 * F.col("ema3_sentiment_state") + 0.20 * F.col("ema5_sentiment_state") - 0.25 * F.col("negative_shock_carry") + 0.10 * F.col("attention_factor")))
    names = list(W.EVENT_WEIGHTS)
    weighted = F.sum(number("sentiment") * number("relevance") * number("confidence") * number("event_importance"))
    pivot = _usable(mentions).groupBy(*GROUP).pivot("event_type", names).agg(weighted)
    joined = rows.join(pivot, GROUP, "left")
    return joined.select(*rows.columns, *[r4(F.coalesce(F.col(f"`{n}`"), F.lit(0.0))).alias(n) for n in names])


def event_crosstab(mentions: DataFrame) -> DataFrame:
    """Mentions by stock and event type."""
    return _usable(mentions).groupBy("ts_code").pivot("event_type", list(W.EVENT_WEIGHTS)).agg(F.count(F.lit(1))).na.fill(0)


def event_sentiment(mentions: DataFrame) -> DataFrame:
    return _usable(mentions).groupBy("ts_code", "event_type").agg(r4(F.avg(number("sentiment"))).alias("mean_sentiment"))


def column_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Means of what is a number; 0 where nothing is."""
    return rows.agg(*[r4(F.coalesce(F.avg(F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))), F.lit(0.0))).alias(c) for c in columns])
