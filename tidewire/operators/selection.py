"""Quotas, caps, top-k and diverse selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import number, r4, split_bar


def quota_per_stock(matches: DataFrame, order: list[str], most: int, stock: str = "ts_code") -> DataFrame:
    """The first ``most`` matches of each stock in file order; 0 keeps all."""
    if not most:
        return matches
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy(stock).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def experiment_subset(news: DataFrame, matches: DataFrame, key: str, order: list[str], most_per_stock: int = 500, most_total: int = 2500) -> DataFrame:
    """Records with the stocks whose quota they meet: primary stock, codes, names and aliases joined with bars. ``most_total`` keeps the first records in order."""
    ordered = matches.join(news.select(key, *[c for c in order if c != key]), key)
    within = quota_per_stock(ordered, order, most_per_stock)
    item = F.struct("match_rank", "ts_code", "stock_name", "matched_aliases")
    grouped = within.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    joined = lambda c: F.array_join(F.transform("m", lambda x: x[c]), "|")
    subset = grouped.select(key, F.col("m")[0]["ts_code"].alias("primary_ts_code"), F.col("m")[0]["stock_name"].alias("primary_stock_name"), joined("ts_code").alias("matched_ts_codes"), joined("stock_name").alias("matched_stock_names"), joined("matched_aliases").alias("matched_aliases"), F.size("m").alias("matched_stock_count"))
    rows = news.join(subset, key)
    return rows.orderBy(*order).limit(most_total) if most_total else rows


def best_per_stock(records: DataFrame, score: str, least: float = 16.0, most: int = 700, stock: str = "primary_ts_code") -> DataFrame:
    """Up to ``most`` records of each stock with at least ``least`` points: highest score, then date, then id."""
    order = Window.partitionBy(stock).orderBy(F.desc(score), "publish_date", "id")
    kept = records.where(F.col(score) >= least)
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n") if most else kept


def daily_topk(records: DataFrame, k: int = 3, score: str = "study_score", start: str | None = None, end: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Up to ``k`` records of each date and primary stock (0: all): score, full name, fewest stocks, most finance words, id.

    Records without date or stock are left out; of records with one id the first in ``order`` counts; an empty word list has length 1, as a split gives it.
    """
    rows = records.where((F.coalesce("publish_date", F.lit("")) != "") & (F.coalesce("primary_ts_code", F.lit("")) != ""))
    if start:
        rows = rows.where(F.col("publish_date") >= start)
    if end:
        rows = rows.where(F.col("publish_date") <= end)
    if order:
        from tidewire.operators.ingest import first_of

        rows = first_of(rows, ["id"], order, skip_empty=True)
    words = F.size(F.split(F.coalesce("study_finance_hits", F.lit("")), r"\|"))
    by = Window.partitionBy("publish_date", "primary_ts_code").orderBy(F.desc(score), F.desc("study_has_full_name"), "matched_stock_count", F.desc(words), "id")
    return rows.withColumn("place_in_day", F.row_number().over(by)).where(F.col("place_in_day") <= k) if k > 0 else rows.withColumn("place_in_day", F.row_number().over(by))


def heap_topk(matches: DataFrame, k: int = 10, order: str = "record_no") -> DataFrame:
    """The ``k`` best matches of each date and stock; of equal scores the earlier record stays."""
    by = Window.partitionBy("publish_date", "ts_code").orderBy(F.desc("score"), order)
    return matches.withColumn("place_in_day", F.row_number().over(by)).where(F.col("place_in_day") <= k)


def diversity_score() -> Column:
    weights = {"relevance": 0.35, "confidence": 0.20, "event_importance": 0.20, "sentiment_strength": 0.15, "coarse_score": 0.05}
    return r4(sum((number(c) * w for c, w in weights.items()), number("merged_event_count", 1.0) * 0.05))


def diverse_topk(mentions: DataFrame, k: int = 3, group: tuple[str, ...] = ("publish_date", "ts_code"), stock: str = "ts_code") -> DataFrame:
    """Up to ``k`` mentions of each group: first, by score, those that add an event type, then the best of the rest; ``pick`` gives the order.

    A row can only be taken by being the best of those with its set of events or among the k best with new ids, so each group is first cut to the best ``k`` different ids of
    every event list; the greedy fold then sees a bounded list however large the group is. Ids are unique in a group.
    """
    events = F.array_sort(F.array_distinct(split_bar(F.coalesce("merged_event_types", F.lit("")))))
    single = F.when(F.trim(F.coalesce("event_type", F.lit(""))) != "", F.array(F.trim("event_type"))).otherwise(F.array(F.lit("其他")))
    rows = mentions.dropna(subset=list(group)).withColumn("_events", F.when(F.size(events) > 0, events).otherwise(single)).withColumn("diversity_score", diversity_score())
    by = [F.desc("diversity_score"), F.desc(number("relevance")), F.desc(number("confidence")), F.coalesce("news_id", F.lit(""))]
    cut = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, F.array_join("_events", "|")).orderBy(*by))).where(F.col("_n") <= k).drop("_n")
    cut = cut.withColumn("_o", F.struct((-F.col("diversity_score")).alias("a"), (-number("relevance")).alias("b"), (-number("confidence")).alias("c"), F.coalesce("news_id", F.lit("")).alias("id")))
    item = F.struct("_o", F.col("_events").alias("e"), F.struct(*mentions.columns, "diversity_score").alias("row"))
    ordered = cut.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kind = ordered.schema["_all"].dataType
    start = F.struct(F.array().cast(kind).alias("taken"), F.array().cast("array<string>").alias("seen"))

    def first_pass(acc: Column, x: Column) -> Column:
        fresh = (F.size(acc["taken"]) < k) & (F.size(F.array_except(x["e"], acc["seen"])) > 0)
        return F.struct(F.when(fresh, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"), F.when(fresh, F.array_union(acc["seen"], x["e"])).otherwise(acc["seen"]).alias("seen"))

    first = ordered.select("_all", F.aggregate("_all", start, first_pass)["taken"].alias("_first"))
    rest = F.filter("_all", lambda x: ~F.exists("_first", lambda y: y["_o"]["id"] == x["_o"]["id"]))
    picked = first.select(F.posexplode(F.slice(F.concat("_first", rest), 1, k)).alias("p", "x"))
    return picked.select("x.row.*", (F.col("p") + 1).alias("pick"))


def counts_by_stock(selected: DataFrame, stock: str = "ts_code") -> DataFrame:
    return selected.groupBy(stock).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("publish_date").alias("days"))
