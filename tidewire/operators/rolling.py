"""Totals and averages over trailing calendar periods by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _powers(window: int) -> list[int]:
    return [1 << b for b in range(window.bit_length() - 1, -1, -1) if window >> b & 1]


def rolling_totals(facts: DataFrame, entity: str, day: str, values: list[str], windows: tuple[int, ...] = (7, 30), scale: int | None = None) -> DataFrame:
    """One row for each entity and calendar day from its first to its last day, with ``<value>_total_<w>d`` and ``<value>_avg_<w>d``.

    ``day`` is a date. Rows with null entity or day do not take part; null and NaN values count as 0; days
    without rows count as 0; days before the first add nothing. An average divides by the whole period.
    With ``scale`` (e.g. 10000 for four decimals) values are summed exactly as whole numbers, and the totals
    also come as ``<value>_units_<w>d``; otherwise sums are doubles. Only ``entity``, ``day`` and ``values``
    are read, so further columns of any name do no harm; an empty table gives an empty result.

    Rows are summed per entity and day before the entities are brought together, so what one window
    partition holds is bounded by the length of the calendar, however many rows an entity has. Sums of
    1, 2, 4, ... days come from one another by shifting whole blocks; each period is a chain of such blocks.
    """
    def clean(v: str) -> Column:
        x = F.when(F.isnan(F.col(v).cast("double")), None).otherwise(F.col(v).cast("double"))
        return F.coalesce(F.round(x * scale).cast("long") if scale else x, F.lit(0 if scale else 0.0).cast("long" if scale else "double"))

    daily = facts.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity, day).agg(*[F.sum(clean(v)).alias(f"_1_{v}") for v in values])
    order = Window.partitionBy(entity).orderBy(day)
    upto = F.coalesce(F.date_sub(F.lead(day).over(order), 1), F.col(day))
    dense = daily.withColumn("_upto", upto).select(entity, F.col(day).alias("_from"), *[f"_1_{v}" for v in values], F.explode(F.sequence(day, "_upto")).alias(day))
    zero = F.lit(0).cast("long" if scale else "double")
    level = dense.select(entity, day, *[F.when(F.col(day) == F.col("_from"), F.col(f"_1_{v}")).otherwise(zero).alias(f"_1_{v}") for v in values])
    size = 1
    while size * 2 <= max(windows):
        level = level.select("*", *[(F.col(f"_{size}_{v}") + F.lag(f"_{size}_{v}", size, 0).over(order)).alias(f"_{size * 2}_{v}") for v in values])
        size *= 2
    out = []
    for v in values:
        for w in windows:
            total, back = None, 0
            for p in _powers(w):
                block = F.lag(f"_{p}_{v}", back, 0).over(order) if back else F.col(f"_{p}_{v}")
                total, back = block if total is None else total + block, back + p
            out += [total.alias(f"{v}_units_{w}d")]
    units = level.select(entity, day, *out)
    exact = [] if scale is None else [f"{v}_units_{w}d" for v in values for w in windows]
    return units.select(
        entity,
        day,
        *[(F.col(f"{v}_units_{w}d") / (scale or 1)).alias(f"{v}_total_{w}d") for v in values for w in windows],
        *[(F.col(f"{v}_units_{w}d") / (w * (scale or 1))).alias(f"{v}_avg_{w}d") for v in values for w in windows],
        *exact,
    )
