"""Forward returns, the strict forward as-of join, and how selections performed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5)


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """``fwd_return_<h>d``: the close h rows later over this close, less 1; null in a stock's last rows and where a close is missing."""
    order = Window.partitionBy("ts_code").orderBy("trade_date")
    return prices.withColumns({f"fwd_return_{h}d": F.try_divide(F.lead("close", h).over(order), F.col("close")) - 1 for h in horizons})


def one_quote_a_day(prices: DataFrame) -> DataFrame:
    """Prices with code and date, one row for each: the smallest of repeated rows."""
    rest = [c for c in prices.columns if c not in ("ts_code", "trade_date")]
    rows = prices.where("trade_date is not null and ts_code is not null").groupBy("ts_code", "trade_date").agg(F.min(F.struct(*rest)).alias("_q"))
    return rows.select("ts_code", "trade_date", "_q.*")


def asof_forward(left: DataFrame, prices: DataFrame, date: str = "publish_date") -> DataFrame:
    """Each left row with the first price row of its stock strictly after ``date``: ``anchor_trade_date, anchor_close, fwd_return_*``.

    Rows without one keep nulls. Both sides go through one window by stock, so nothing is multiplied. Left columns win over price columns of
    the same name, which come as ``price_<name>``.
    """
    prices = one_quote_a_day(prices)
    taken = [c for c in prices.columns if c not in ("ts_code", "trade_date")]
    quote = F.struct(F.col("trade_date").alias("d"), *[F.col(c) for c in taken])
    rights = prices.select("ts_code", F.col("trade_date").alias("_d"), F.lit(0).alias("_side"), quote.alias("_q"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"))
    lefts = left.select("ts_code", F.expr(f"try_cast({date} as date)").alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_q"].dataType).alias("_q"), F.struct(*left.columns).alias("_row"))
    # backwards in time a running frame holds what is later; price rows stand after the query rows of their own day
    order = Window.partitionBy("ts_code").orderBy(F.col("_d").desc_nulls_first(), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    both = lefts.unionByName(rights).withColumn("_next", F.when(F.col("_d").isNotNull(), F.last("_q", ignorenulls=True).over(order))).where("_side = 1")
    name = {"close": "anchor_close"} | {c: c if c.startswith("fwd_return_") and c not in left.columns else f"price_{c}" for c in taken if c != "close"}
    return both.select("_row.*", F.col("_next.d").alias("anchor_trade_date"), *[F.col(f"_next.{c}").alias(name[c]) for c in taken])


def _long(panel: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_return_{h}d").alias("ret")) for h in HORIZONS])
    return panel.select(*keys, "publish_date", "ts_code", "ranking_score", "selected_topk", F.explode(pairs).alias("_r")).select("*", "_r.*").drop("_r")


def evaluate_topk(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each date with a selection and each horizon: mean returns of the selection, of all stocks, of as many at the bottom, and the differences.

    All five are null where no stock or no selected stock has a return. ``keys`` add further grouping columns (a preset, k). Equal scores at the
    bottom are ordered by code.
    """
    keys = keys or []
    group = [*keys, "publish_date", "horizon"]
    rows = _long(panel, keys).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))
    by = Window.partitionBy(*group)
    picked = F.col("selected_topk") == 1
    rows = rows.withColumn("_k", F.count_if(picked & F.col("ret").isNotNull()).over(by)).withColumn("_low", F.row_number().over(by.orderBy(F.col("ret").isNull(), "ranking_score", "ts_code")))
    out = rows.groupBy(*group).agg(
        F.count_distinct("ts_code").alias("cross_section_size"), F.count_if(picked).alias("topk_size"), F.avg(F.when(picked, F.col("ret"))).alias("topk_mean_return"), F.avg("ret").alias("_all"),
        F.avg(F.when(F.col("_low") <= F.col("_k"), F.col("ret"))).alias("_bottom"),
    ).where("topk_size > 0")
    known = F.col("topk_mean_return").isNotNull()
    r10 = lambda x: F.round(x, 10)
    return out.select(*group, "cross_section_size", "topk_size", r10(F.col("topk_mean_return")).alias("topk_mean_return"), r10(F.when(known, F.col("_all"))).alias("universe_mean_return"), r10(F.when(known, F.col("topk_mean_return") - F.col("_all"))).alias("topk_excess_return"), r10(F.when(known, F.col("_bottom"))).alias("bottomk_mean_return"), r10(F.when(known, F.col("topk_mean_return") - F.col("_bottom"))).alias("top_bottom_spread"))


def summarise_performance(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over the dates where all four figures are known, and how often the selection beat all stocks."""
    group = [*(keys or []), "horizon"]
    whole = daily.dropna(subset=["topk_mean_return", "universe_mean_return", "topk_excess_return", "top_bottom_spread"])
    r10 = lambda c: F.round(F.avg(c), 10)
    found = whole.groupBy(*group).agg(F.count(F.lit(1)).alias("n_dates"), r10("topk_mean_return").alias("avg_topk_return"), r10("universe_mean_return").alias("avg_universe_return"), r10("topk_excess_return").alias("avg_excess_return"), r10("top_bottom_spread").alias("avg_top_bottom_spread"), F.round(F.avg((F.col("topk_excess_return") > 0).cast("double")), 10).alias("hit_rate_vs_universe"))
    return daily.select(*group).distinct().join(found, group, "left").withColumn("n_dates", F.coalesce("n_dates", F.lit(0)))


def performance_dict(summary: DataFrame, date_count: int) -> dict:
    rows = {str(r["horizon"]): {k: v for k, v in r.asDict().items() if k != "horizon"} for r in summary.collect()}
    return {"date_count": date_count, "horizons": rows}


def preset_grid(profiles: DataFrame, prices: DataFrame, presets: list[str], ks: list[int]) -> DataFrame:
    """Performance of every preset and k in one plan: ranks of all presets side by side, one as-of join, then one aggregation."""
    from tidewire.operators.ranking import add_derived, percentile_by_window, preset, reliability, score

    every = {f.name: f for p in presets for f in preset(p)}
    frame = add_derived(profiles)
    frame = percentile_by_window(frame, {n: F.col(n).try_cast("double") * f.direction for n, f in every.items()})
    multiplier = reliability(frame)
    scored = frame.select("publish_date", "ts_code", F.explode(F.array(*[F.struct(F.lit(p).alias("preset"), F.round(0.5 + (score(frame, preset(p)) - 0.5) * multiplier, 10).alias("ranking_score")) for p in presets])).alias("s")).select("publish_date", "ts_code", "s.*")
    order = Window.partitionBy("preset", "publish_date").orderBy(F.desc("ranking_score"), "ts_code")
    ranked = scored.withColumn("rank_in_date", F.row_number().over(order))
    dated = asof_forward(profiles.select("publish_date", "ts_code").distinct(), prices.select("ts_code", "trade_date", "close", *[f"fwd_return_{h}d" for h in HORIZONS]))
    panel = ranked.join(dated, ["publish_date", "ts_code"]).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("selected_topk", (F.col("rank_in_date") <= F.greatest(F.lit(1), F.col("k"))).cast("int"))
    return summarise_performance(evaluate_topk(panel, ["preset", "k"]), ["preset", "k"])
