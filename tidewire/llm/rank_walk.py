"""One ranking from several differently scaled scores: the stationary order of a walk towards better items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut, drop_written, written

DAMPING, ROUNDS, TOLERANCE = 0.85, 400, 1e-12
DIGITS = 10  # of a stationarity relative to the mean one; what differs less is equal
LOCAL_ROWS = 1_000_000  # a group up to this size is walked by one task (some 100 MB); a larger one by the whole cluster


def walk(scores: np.ndarray, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> np.ndarray:
    """Stationarity of the rows of ``scores`` (items by scores, more is better, NaN is no score).

    From an item one of its scores is picked evenly, then an item that is at least as good by that score. A
    target's chance carries the weight 1 / (number of its scores): an item with a missing score is reached
    through its other scores as often as if the missing one agreed with them. An item without scores keeps
    only the restart mass. Prefix sums over each sorted score make a round linear in the items. The walk goes on until it settles, and is an
    error if it hasn't after ROUNDS; with ``rounds`` it ends after so many at the latest.
    """
    n = len(scores)
    if n == 0:
        return np.zeros(0)
    has = ~np.isnan(scores)
    held = has.sum(axis=1)
    weight = np.where(held > 0, 1.0 / np.maximum(held, 1), 0.0)
    lists = []
    for s in range(scores.shape[1]):
        items = np.flatnonzero(has[:, s])
        if not len(items):
            continue
        items = items[np.argsort(-scores[items, s], kind="stable")]
        values = scores[items, s]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        tie = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(items)]))
        better = np.add.reduceat(weight[items], first).cumsum()  # weight of all items at least as good, by tie
        lists.append((items, first, tie, better))
    mass = np.full(n, 1.0 / n)
    for _ in range(rounds or ROUNDS):
        flow = np.zeros(n)
        for items, first, tie, better in lists:
            leaving = np.add.reduceat(mass[items] * weight[items], first) / better
            flow[items] += (weight[items]) * leaving[::-1].cumsum()[::-1][tie]
        idle = mass[held == 0].sum()
        new = damping * (flow + idle / n) + (1 - damping) / n
        moved = np.abs(new - mass).sum()
        mass = new
        if moved < tolerance:
            return mass
    return _unsettled(rounds, mass)


def _unsettled(rounds: int | None, mass):
    if rounds is None:
        raise RuntimeError(f"the walk has not settled after {ROUNDS} rounds")
    return mass


def _signed(scores: dict[str, int]) -> list:
    out = []
    for c, sign in scores.items():
        x = F.col(c).cast("double")
        out.append(F.when(F.isnan(x), None).otherwise(x * float(sign)).alias(f"_s_{c}"))
    return out


def _walk_wide(rows: DataFrame, group: str, item: str, signed: list[str], damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """The same walk for groups of any size: a round moves one row per item and score to its level and back, and one table of masses is kept.

    The levels (different values of a score) are sorted once into blocks; running totals within a block and over block totals give every level what
    stands above it, so no task holds a score of a whole group. The last round's table is deleted as soon as the next one is written.
    """
    held = sum((F.col(s).isNotNull().cast("int") for s in signed), F.lit(0))
    items = cut(rows.withColumn("_held", held).withColumn("_w", F.when(F.col("_held") > 0, 1.0 / F.col("_held")).otherwise(0.0)))
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_list"), F.col(s).alias("_v")) for i, s in enumerate(signed)]))
    long = items.select(group, item, "_w", each.alias("e")).select(group, item, "_w", "e.*").where("_v is not null")
    place = [group, "_list", "_block"]
    levels = long.groupBy(group, "_list", "_v").agg(F.sum("_w").alias("_level"))
    levels = cut(levels.repartitionByRange(group, "_list", F.desc("_v")).withColumn("_block", F.spark_partition_id()))

    def running(table: DataFrame, value: str, out: str, falling: bool) -> DataFrame:
        by = F.col("_v").desc() if falling else F.col("_v").asc()
        blocks = F.col("_block").asc() if falling else F.col("_block").desc()
        totals = table.groupBy(*place).agg(F.sum(value).alias("_sum"))
        before = Window.partitionBy(group, "_list").orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*place, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset"))
        inside = Window.partitionBy(*place).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumn("_in", F.sum(value).over(inside)).join(offsets, place).withColumn(out, F.col("_in") + F.col("_offset")).drop("_in", "_offset")

    better = running(levels, "_level", "_better", True).drop("_level")
    long = cut(long.join(better, [group, "_list", "_v"]))
    mass, last = cut(items.join(sizes, group).select(group, item, "_held", "_n", (1.0 / F.col("_n")).alias("_mass"))), None
    for _ in range(rounds or ROUNDS):
        leaving = long.join(mass.select(group, item, "_mass"), [group, item]).groupBy(*place, "_v").agg(F.sum(F.col("_mass") * F.col("_w") / F.col("_better")).alias("_out"))
        reach = running(leaving, "_out", "_reach", False).drop("_out")
        flow = long.join(reach, [*place, "_v"]).groupBy(group, item).agg(F.sum(F.col("_w") * F.col("_reach")).alias("_flow"))
        idle = mass.groupBy(group).agg(F.sum(F.when(F.col("_held") == 0, F.col("_mass")).otherwise(0.0)).alias("_idle"))
        new = mass.join(flow, [group, item], "left").join(idle, group).select(
            group, item, "_held", "_n", F.col("_mass").alias("_old"),
            (damping * (F.coalesce("_flow", F.lit(0.0)) + F.col("_idle") / F.col("_n")) + (1 - damping) / F.col("_n")).alias("_mass"),
        )
        new = written(new, "walk")
        if last is not None:
            drop_written(last)
        last, mass = new, new.drop("_old")
        moved = new.groupBy(group).agg(F.sum(F.abs(F.col("_mass") - F.col("_old"))).alias("m")).agg(F.max("m")).first()[0]
        if moved is None or moved < tolerance:
            break
    else:
        _unsettled(rounds, mass)
    return mass.select(group, item, (F.col("_mass") * F.col("_n")).alias("stationarity"))


def rank_walk(df: DataFrame, group: str, item: str, scores: dict[str, int], top: int | None = None, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``group, item, stationarity, walk_rank``: the items of each group in one order from several scores.

    ``scores`` maps columns to +1 (more is better) or -1. Only order within the group counts, never the size of
    values. Null and NaN scores speak neither for nor against; items without any score come last. Rows with
    null group or item do not take part; rows that repeat group, item and scores count once. Equal stationarity
    (to 12 digits) is ordered by item. Other columns are not read. An empty table gives an empty result.

    Groups up to ``local_rows`` rows are walked by one task each; larger ones by :func:`_walk_wide`, with the same result.
    """
    signed = [f"_s_{c}" for c in scores]
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, *_signed(scores))
    large = [r[0] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().where(F.col("count") > local_rows).select(group).collect()]  # at most rows / local_rows names
    kind = dict(rows.dtypes)
    schema = f"`{group}` {kind[group]}, `{item}` {kind[item]}, stationarity double, walk_rank int"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates()
        mass = walk(pdf[signed].to_numpy(float), damping, rounds, tolerance)
        mass = np.round(mass * len(mass), DIGITS)
        order = np.lexsort((pdf[item].to_numpy(), -mass))[:top]
        out = pdf.iloc[order][[group, item]].copy()
        out["stationarity"], out["walk_rank"] = mass[order], np.arange(1, len(order) + 1, dtype=np.int32)
        return out

    small = rows.where(~F.col(group).isin(large)) if large else rows
    found = small.groupBy(group).applyInPandas(local, schema)
    if large:
        wide = _walk_wide(rows.where(F.col(group).isin(large)).distinct(), group, item, signed, damping, rounds, tolerance).withColumn("stationarity", F.round("stationarity", DIGITS))
        # ranks by block: the sorted table's partitions are counted first, so no task holds a whole group
        placed = cut(wide.repartitionByRange(group, F.desc("stationarity"), item).withColumn("_block", F.spark_partition_id()))
        before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = placed.groupBy(group, "_block").count().select(group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
        inside = Window.partitionBy(group, "_block").orderBy(F.desc("stationarity"), item)
        ranked = placed.withColumn("_in", F.row_number().over(inside)).join(offsets, [group, "_block"]).select(group, item, "stationarity", (F.col("_in") + F.col("_offset")).cast("int").alias("walk_rank"))
        found = found.unionByName(ranked.where(F.col("walk_rank") <= top) if top else ranked)
    return found


def brute_walk(scores: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """The same chain by its full transition matrix, for tests."""
    n, m = scores.shape
    held = (~np.isnan(scores)).sum(axis=1)
    chance = np.zeros((n, n))
    for i in range(n):
        for s in range(m):
            if not np.isnan(scores[i, s]):
                to = [k for k in range(n) if not np.isnan(scores[k, s]) and scores[k, s] >= scores[i, s]]
                total = sum(1 / held[k] for k in to)
                for k in to:
                    chance[i, k] += 1 / held[i] / held[k] / total
        if held[i] == 0:
            chance[i] = 1 / n
    mass = np.full(n, 1 / n)
    for _ in range(rounds):
        mass = damping * mass @ chance + (1 - damping) / n
    return mass


