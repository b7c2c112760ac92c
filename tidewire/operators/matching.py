"""News aligned to stocks by the aliases that stand in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import wordlists as W
from tidewire.functions.text import hits, r4, squeeze, title_and_body, unique_texts

ALIASES_AT_ONCE = 500_000  # aliases in one automaton; a larger universe is matched part by part


def _aliases(universe: DataFrame, least: int) -> DataFrame:
    listed = universe.select("ts_code", F.posexplode("aliases").alias("place", "alias")).withColumn("squeezed", squeeze("alias"))
    return listed.where(F.length("squeezed") >= least)


def leading(text: str, ends: list[tuple[int, str]]) -> set[str]:
    """Of all hits (place of the last letter, word) those that a reader takes who goes from left to right, takes the longest word at a place and goes on behind it."""
    longest: dict[int, int] = {}
    for end, word in ends:
        start = end + 1 - len(word)
        longest[start] = max(longest.get(start, 0), len(word))
    taken, at = set(), 0
    for start in sorted(longest):
        if start >= at:
            at = start + longest[start]
            taken.add(text[start:at])
    return taken


def _find(batches: Iterator[pa.RecordBatch], words: Broadcast) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words.value:
        machine.add_word(w, w)
    if words.value:
        machine.make_automaton()
    for b in batches:
        keys, found, leads = [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            ends = list(machine.iter(t)) if words.value and t else []
            here, first = sorted({w for _, w in ends}), leading(t, ends) if ends else set()
            keys += [i] * len(here)
            found += here
            leads += [w in first for w in here]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string()), pa.array(leads, pa.bool_())], names=["_key", "squeezed", "leading"])


def alias_hits(news: DataFrame, key: str, content: Column, universe: DataFrame, least: int = 2) -> DataFrame:
    """``_key, ts_code, place, alias, squeezed, leading``: every alias of ``least`` squeezed characters or more that stands in the squeezed content.

    ``leading`` marks aliases that the text is read as from left to right, the longest first and without overlap (see :func:`leading`). Aliases go to the readers as
    a broadcast list (at most ALIASES_AT_ONCE, else in parts; then nothing is leading for certain and the call is refused), so texts are read once and never
    shuffled; hits are joined to all stocks that share an alias.
    """
    listed = _aliases(universe, least)
    names = listed.select("squeezed").distinct()
    parts = -(-names.count() // ALIASES_AT_ONCE) or 1
    rows = news.select(F.col(key).alias("_key"), squeeze(content).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    context = news.sparkSession.sparkContext
    found = []
    for p in range(parts):
        words = context.broadcast([r[0] for r in names.where(F.pmod(F.xxhash64("squeezed"), F.lit(parts)) == p).collect()])
        part = rows.mapInArrow(lambda it, w=words: _find(it, w), f"_key {kind}, squeezed string, leading boolean")
        found.append(part if parts == 1 else part.withColumn("leading", F.raise_error(F.lit("leading aliases need one automaton")).cast("boolean")))
    return reduce(DataFrame.unionByName, found).join(listed, "squeezed").select("_key", "ts_code", "place", "alias", "squeezed", "leading")


def _by_stock(found: DataFrame) -> DataFrame:
    """One row for each record and stock: aliases in the universe's order, their number and the longest squeezed one."""
    grouped = found.groupBy("_key", "ts_code").agg(F.array_sort(F.collect_list(F.struct("place", "alias"))).alias("a"), F.max(F.length("squeezed")).alias("longest"), F.count(F.lit(1)).alias("n"))
    return grouped.select("_key", "ts_code", unique_texts(F.transform("a", lambda x: x["alias"])).alias("aliases"), "longest", "n")


def coarse_match(news: DataFrame, universe: DataFrame, key: str = "record_no", most: int = 8, body_limit: int | None = None) -> DataFrame:
    """``key, ts_code, name, industry, matched_aliases, coarse_score, candidate_rank``: the up to ``most`` stocks of a record.

    Ordered by score, number of aliases and longest alias, then by code.
    """
    found = _by_stock(alias_hits(news, key, title_and_body(limit=body_limit), universe))
    scored = found.withColumn("coarse_score", r4(F.least(F.lit(1.0), 0.68 + 0.03 * F.col("longest") + 0.05 * (F.col("n") - 1)))).withColumn("_raw", F.aggregate("aliases", F.lit(0), lambda a, x: F.greatest(a, F.length(x))))
    order = Window.partitionBy("_key").orderBy(F.desc("coarse_score"), F.desc(F.size("aliases")), F.desc("_raw"), "ts_code")
    ranked = scored.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= most)
    stocks = universe.select("ts_code", "name", "industry").dropDuplicates(["ts_code"])
    return ranked.join(stocks, "ts_code").select(F.col("_key").alias(key), "ts_code", "name", "industry", F.col("aliases").alias("matched_aliases"), "coarse_score", "candidate_rank")


def record_match(news: DataFrame, universe: DataFrame, key: str = "record_no") -> DataFrame:
    """``key, ts_code, stock_name, matched_aliases, match_score, match_rank``: all stocks of a record by ten points an alias and the longest alias's length."""
    found = alias_hits(news, key, title_and_body(), universe)
    grouped = found.groupBy("_key", "ts_code").agg(F.array_sort(F.collect_list(F.struct("place", "alias"))).alias("a"), F.max(F.length("squeezed")).alias("longest"), F.count(F.lit(1)).alias("n"))
    scored = grouped.withColumn("match_score", (F.col("n") * 10 + F.col("longest")).cast("long"))
    order = Window.partitionBy("_key").orderBy(F.desc("match_score"), "ts_code")
    stocks = universe.select("ts_code", F.col("name").alias("stock_name")).dropDuplicates(["ts_code"])
    ranked = scored.withColumn("match_rank", F.row_number().over(order)).join(stocks, "ts_code")
    return ranked.select(F.col("_key").alias(key), "ts_code", "stock_name", F.array_join(F.transform("a", lambda x: x["alias"]), "|").alias("matched_aliases"), "match_score", "match_rank")


def quarter_match(news: DataFrame, universe: DataFrame, key: str = "record_no", body_limit: int = 1600) -> DataFrame:
    """Stock matches of the quarter builder with their score; matches that are too weak or too ambiguous are left out.

    The text is title and the first ``body_limit`` characters of the body. A stock is a candidate if the text reads as one of its aliases (longest first, without
    overlap: a text with only a longer name is none of a stock that has part of it as an alias); then all its aliases in title or body count. Title hits weigh more
    than body hits; finance and noise words add and take; short ambiguous aliases need support.
    """
    cut = news.withColumn("body", F.substring(F.coalesce("body", F.lit("")), 1, body_limit))
    found = alias_hits(cut, key, title_and_body(), universe)
    names = universe.select("ts_code", F.col("name").alias("stock_name"), "industry", squeeze("name").alias("_full")).dropDuplicates(["ts_code"])
    lower = cut.withColumn("_low", F.lower(title_and_body()))
    texts = lower.select(F.col(key).alias("_key"), squeeze("title").alias("_title"), squeeze("body").alias("_body"), hits(F.col("_low"), W.QUARTER_FINANCE).alias("_fin"), hits(F.col("_low"), W.QUARTER_NOISE).alias("_noise"), (F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", "") == "").alias("_untitled"))
    wanted = found.where("leading").select("_key", "ts_code").distinct()
    placed = found.join(wanted, ["_key", "ts_code"], "left_semi").join(texts, "_key").withColumn("_in_title", F.contains("_title", F.col("squeezed"))).where(F.col("_in_title") | F.contains("_body", F.col("squeezed")))
    ambiguous = F.col("alias").isin(W.AMBIGUOUS)
    grouped = placed.join(names, "ts_code").groupBy("_key", "ts_code", "stock_name", "industry").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]), "|").alias("matched_aliases"),
        F.count_if("_in_title").alias("title_hits"), F.count_if(~F.col("_in_title")).alias("body_hits"), F.max(F.length("squeezed")).alias("_longest"),
        F.max((F.col("squeezed") == F.col("_full")).cast("int")).alias("has_full_name"), F.max(ambiguous.cast("int")).alias("_ambiguous"),
        F.first("_fin").alias("_fin"), F.first("_noise").alias("_noise"), F.first("_untitled").alias("_untitled"),
    )
    full, finance = F.col("has_full_name") == 1, F.size("_fin")
    doubtful = ~full & (F.col("_ambiguous") == 1)
    score = (
        F.when(full, 8.0).otherwise(0.0) + F.col("title_hits") * 4.0 + F.col("body_hits") * 1.5 + F.least(finance, F.lit(6)) * 0.8 - F.least(F.size("_noise"), F.lit(4)) * 0.8
        + F.when(F.col("_longest") >= 4, 1.0).when(F.col("_longest") == 3, 0.4).otherwise(-0.2) - F.when(F.col("_untitled"), 0.5).otherwise(0.0) - F.when(doubtful, 1.0).otherwise(0.0)
    )
    kept = grouped.withColumn("score", r4(score)).where(~(doubtful & (finance < 2) & (F.col("title_hits") == 0)) & ~(~full & (finance == 0) & (F.col("title_hits") == 0)) & (F.col("score") >= 2.5))
    first8 = lambda c: F.array_join(F.slice(c, 1, 8), "|")
    return kept.select(F.col("_key").alias(key), "ts_code", "stock_name", "industry", "matched_aliases", first8("_fin").alias("finance_hits"), first8("_noise").alias("noise_hits"), "has_full_name", "score", "title_hits", "body_hits")
