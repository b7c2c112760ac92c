"""How factors relate to later returns: over time, between two stocks, and by direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.returns import HORIZONS
from tidewire.runtime import cut

#: The factors under validation and the direction in which they should work.
FACTORS = {
    "net_sentiment_factor": 1, "negative_shock_factor": -1, "attention_factor": 1, "sentiment_momentum_factor": 1, "event_novelty_factor": 1, "ema3_sentiment_state": 1, "ema5_sentiment_state": 1,
    "negative_shock_carry": -1, "state_composite_factor": 1, "composite_score": 1, "earnings_event_state": 1, "operations_event_state": 1, "market_buzz_event_state": 1, "risk_event_state": -1,
}
LEAST = 5


def _r(x: Column) -> Column:
    return F.round(F.round(x, 12), 8)


def long_panel(panel: DataFrame, factors: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """``keys, factor, direction, x, horizon, y`` for every row, factor and horizon with both numbers."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(d).alias("direction"), number(f).alias("x")) for f, d in factors.items()])
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), number(f"fwd_return_{h}d").alias("y")) for h in HORIZONS])
    rows = panel.select(*(keys or []), F.explode(each).alias("f"), later.alias("l")).select(*(keys or []), "f.*", F.explode("l").alias("h"))
    return rows.select(*(keys or []), "factor", "direction", "x", "h.*").where("x is not null and y is not null")


def value_levels(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """``group, column, _t, _below``: each value with its rows and the rows below it.

    Values are sorted by range into blocks that are counted first, so no task holds a group, of which there may be few and large.
    """
    counts = rows.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_t"))
    placed = cut(counts.repartitionByRange(*group, column).withColumn("_block", F.spark_partition_id()))
    blocks = placed.groupBy(*group, "_block").agg(F.sum("_t").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = blocks.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_block").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum("_t").over(inside), F.lit(0))).join(offsets, [*group, "_block"]).select(*group, column, "_t", (F.col("_in") + F.col("_offset")).alias("_below"))


def average_rank(rows: DataFrame, group: list[str], column: str, out: str, levels: DataFrame | None = None) -> DataFrame:
    """Ranks with ties averaged, from the counts of distinct values, joined back to the rows."""
    levels = value_levels(rows, group, column) if levels is None else levels
    return rows.join(levels.select(*group, column, (F.col("_below") + (F.col("_t") + 1) / 2).alias(out)), [*group, column])


def quantiles(levels: DataFrame, group: list[str], column: str, shares: list[float]) -> DataFrame:
    """``group, _q`` (an array): linear quantiles read off the counted values."""
    sized = levels.join(levels.groupBy(*group).agg(F.sum("_t").alias("_rows")), group)
    picks = []
    for i, q in enumerate(shares):
        place = (F.col("_rows") - 1) * F.lit(q)
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_t"))
        low, high = F.max(F.when(holds(F.floor(place)), F.col(column))), F.max(F.when(holds(F.ceil(place)), F.col(column)))
        picks.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return sized.groupBy(*group).agg(*picks).select(*group, F.array(*[f"q{i}" for i in range(len(shares))]).alias("_q"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson; null when a side has fewer than two values (the built-in ``corr`` divides by zero there)."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _buckets(rows: DataFrame, group: list[str], x: str, y: str, levels: DataFrame) -> DataFrame:
    """Mean of y where x is at or above its 70 % quantile, and at or below its 30 % one (linear quantiles; both may hold a row)."""
    placed = rows.join(F.broadcast(quantiles(levels, group, x, [0.7, 0.3])), group)  # one row for each factor and horizon
    q = lambda i: F.round(F.col("_q")[i], 12)
    return placed.groupBy(*group).agg(F.avg(F.when(F.round(x, 12) >= q(0), F.col(y))).alias("top"), F.avg(F.when(F.round(x, 12) <= q(1), F.col(y))).alias("bottom"))


def time_series(panel: DataFrame, factors: dict[str, int] = FACTORS) -> DataFrame:
    """Correlations and bucket returns by factor and horizon, for at least five rows."""
    group = ["factor", "direction", "horizon"]
    rows = long_panel(panel, factors)
    levels = cut(value_levels(rows, group, "x"))
    ranked = average_rank(average_rank(rows, group, "x", "rx", levels), group, "y", "ry")
    stats = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_obs"), safe_corr("x", "y").alias("p"), safe_corr("rx", "ry").alias("s")).where(F.col("n_obs") >= LEAST)
    out = stats.join(_buckets(rows, group, "x", "y", levels), group)
    return out.select("factor", "horizon", "n_obs", _r(F.col("p")).alias("pearson_corr"), _r(F.col("s")).alias("spearman_corr"), _r(F.col("top")).alias("top_bucket_mean_return"), _r(F.col("bottom")).alias("bottom_bucket_mean_return"), _r((F.col("top") - F.col("bottom")) * F.col("direction")).alias("expected_top_bottom_gap"))


def cross_section(panel: DataFrame, factors: dict[str, int] = FACTORS) -> DataFrame:
    """Differences between the two stocks of a date (smaller code first) against those of their returns, for at least five dates with exactly two."""
    group = ["factor", "direction", "horizon"]
    rows = long_panel(panel, factors, ["publish_date", "ts_code"])
    pair = rows.groupBy("publish_date", *group).agg(F.count_distinct("ts_code").alias("n"), F.min_by("x", "ts_code").alias("x1"), F.max_by("x", "ts_code").alias("x2"), F.min_by("y", "ts_code").alias("y1"), F.max_by("y", "ts_code").alias("y2")).where("n = 2")
    diffs = pair.select(*group, F.round((F.col("x1") - F.col("x2")) * F.col("direction"), 10).alias("dx"), F.round(F.col("y1") - F.col("y2"), 10).alias("dy"))
    diffs = cut(diffs)
    levels = cut(value_levels(diffs, group, "dx"))
    ranked = average_rank(average_rank(diffs, group, "dx", "rx", levels), group, "dy", "ry")
    stats = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_dates"), safe_corr("dx", "dy").alias("p"), safe_corr("rx", "ry").alias("s"), F.avg((F.signum("dx") == F.signum("dy")).cast("double")).alias("hit")).where(F.col("n_dates") >= LEAST)
    out = stats.join(_buckets(diffs, group, "dx", "dy", levels), group)
    return out.select("factor", "horizon", "n_dates", _r(F.col("p")).alias("spread_corr"), _r(F.col("s")).alias("spread_rank_corr"), _r(F.col("hit")).alias("rank_hit_rate"), _r(F.col("top")).alias("top_bucket_return_spread"), _r(F.col("bottom")).alias("bottom_bucket_return_spread"), _r(F.col("top") - F.col("bottom")).alias("top_bottom_spread_gap"))


def direction(panel: DataFrame, factors: dict[str, int] = FACTORS) -> DataFrame:
    """How often the sign of a factor gave the sign of the return, against the more frequent sign; zero signals are left out."""
    rows = long_panel(panel, factors).withColumn("signal", F.col("x") * F.col("direction"))
    moved = F.abs("signal") > 1e-12
    stats = rows.groupBy("factor", "horizon").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(moved).alias("n_obs"), F.avg(F.when(moved, (F.signum("signal") == F.signum("y")).cast("double"))).alias("hit"),
        F.avg(F.when(moved, (F.col("y") > 0).cast("double"))).alias("up"), F.avg(F.when(moved, (F.col("y") < 0).cast("double"))).alias("down"),
    ).where((F.col("_all") >= LEAST) & (F.col("n_obs") >= LEAST))
    best = F.greatest("up", "down")
    return stats.select("factor", "horizon", "n_obs", _r(F.col("hit")).alias("raw_direction_hit_rate"), _r(F.col("up")).alias("market_up_ratio"), _r(F.col("down")).alias("market_down_ratio"), _r(best).alias("market_majority_hit_rate"), _r(F.col("hit") - best).alias("excess_hit_rate_vs_market"))


def validation_report(times: DataFrame, directions: DataFrame, pairs: DataFrame | None = None, most: int = 5) -> str:
    """Markdown: for each horizon the best factors by gap, the best by hit rate, and the best of pairs (``most`` rows of each reach the driver)."""
    pct = lambda x: "NA" if x is None else f"{x * 100:.2f}%"
    lines = ["# Factor validation"]

    def table(heading: str, frame: DataFrame, order: list, columns: dict[str, bool]) -> None:
        rows = frame.orderBy(*order, "factor", "horizon").limit(most).collect()
        lines.extend(["", f"## {heading}", "", "| factor | horizon | " + " | ".join(columns) + " |", "| --- " * (len(columns) + 2) + "|"])
        lines.extend(f"| {r['factor']} | {r['horizon']}D | " + " | ".join(pct(r[c]) if share else str(r[c]) for c, share in columns.items()) + " |" for r in rows)

    for h in reversed(HORIZONS):
        table(f"Over time, {h} days on", times.where(F.col("horizon") == h), [F.desc_nulls_last("expected_top_bottom_gap"), F.desc_nulls_last("pearson_corr")], {"pearson_corr": False, "spearman_corr": False, "expected_top_bottom_gap": True})
    if pairs is not None:
        table("Between two stocks", pairs, [F.desc_nulls_last("spread_corr"), F.desc("rank_hit_rate")], {"spread_corr": False, "rank_hit_rate": True, "top_bottom_spread_gap": True})
    table("Direction", directions, [F.desc("raw_direction_hit_rate")], {"raw_direction_hit_rate": True, "excess_hit_rate_vs_market": True})
    return "\n".join(lines) + "\n"
