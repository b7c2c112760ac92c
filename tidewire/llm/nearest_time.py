"""Nearest record in time of the same entity, by one global sort and an exchange of partition edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut, shuffle_partitions

TASK_ROWS = 1_000_000  # rows of one partition of the global sort, about
SCAN_BLOCK = 1_000  # partitions whose edges one task scans

#: An edge: what a partition tells the others. Entities are compared by their whole text.
EDGE = "pid int, first_right_entity string, first_right long, first_pick string, last_right_entity string, last_right long, last_pick string"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last right record of a partition, as (entity, time, pick)."""
    pid, first, last = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        pid = b.column("_pid")[0].as_py()
        right = np.flatnonzero(b.column("_side").to_numpy() == 0)
        if len(right):
            at = [tuple(b.column(c)[int(i)].as_py() for c in ("_entity", "_t", "_pick")) for i in (right[0], right[-1])]
            first, last = first or at[0], at[1]
    if pid is not None:
        values = [pid, *(first or (None, None, None)), *(last or (None, None, None))]
        kinds = [pa.int32(), *[pa.string(), pa.int64(), pa.string()] * 2]
        names = ["pid", "first_right_entity", "first_right", "first_pick", "last_right_entity", "last_right", "last_pick"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def carried(edges: DataFrame) -> DataFrame:
    """For each partition (``pid``) the last right record before it and the first right record after it: ``before, after``.

    A prefix scan in blocks: every block of partitions is scanned by its own task, then the blocks' totals, and what a block's scan lacks comes from these.
    """
    side = lambda s: F.when(F.col(f"{s}_right").isNotNull(), F.struct(F.col(f"{s}_right_entity").alias("entity"), F.col(f"{s}_right").alias("t"), F.col(f"{s}_pick").alias("pick")))
    rows = edges.select("pid", F.floor(F.col("pid") / SCAN_BLOCK).alias("block"), side("first").alias("first"), side("last").alias("last"))
    up = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({"_before": F.last("last", True).over(up("block").orderBy("pid")), "_after": F.last("first", True).over(up("block").orderBy(F.desc("pid")))})
    totals = rows.groupBy("block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("pid"))).alias("last"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("pid"))).alias("first"))
    over = totals.select("block", F.last("last", True).over(up().orderBy("block")).alias("_far_before"), F.last("first", True).over(up().orderBy(F.desc("block"))).alias("_far_after"))
    return inside.join(over, "block").select("pid", F.coalesce("_before", "_far_before").alias("before"), F.coalesce("_after", "_far_after").alias("after"))


def _scan(batches: Iterator[pa.RecordBatch], edges: Broadcast, tolerance: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    before, after = edges.value[table.column("_pid")[0].as_py()]
    n = len(table)
    right = table.column("_side").to_numpy() == 0
    t = table.column("_t").to_numpy()
    entity = table.column("_entity").combine_chunks()
    starts = np.zeros(n, bool)
    starts[0] = True
    starts[1:] = ~np.asarray(entity.slice(1).equals(entity.slice(0, n - 1)) if n == 1 else pa.compute.equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
    code = starts.cumsum()
    place = np.arange(n)
    back = np.maximum.accumulate(np.where(right, place, -1))
    ahead = np.minimum.accumulate(np.where(right, place, n)[::-1])[::-1]
    has_back = (back >= 0) & (code[np.maximum(back, 0)] == code)
    has_ahead = (ahead < n) & (code[np.minimum(ahead, n - 1)] == code)
    far = np.int64(1) << 62
    back_t = np.where(has_back, t[np.maximum(back, 0)], -far)
    ahead_t = np.where(has_ahead, t[np.minimum(ahead, n - 1)], far)
    back_at, ahead_at = np.maximum(back, 0), np.minimum(ahead, n - 1)  # places of the picks; n and n + 1 are those from outside
    if before is not None and before[0] == entity[0].as_py():
        outside = (code == 1) & ~has_back
        back_t, back_at, has_back = np.where(outside, before[1], back_t), np.where(outside, n, back_at), has_back | outside
    if after is not None and after[0] == entity[n - 1].as_py():
        outside = (code == code[-1]) & ~has_ahead
        ahead_t, ahead_at, has_ahead = np.where(outside, after[1], ahead_t), np.where(outside, n + 1, ahead_at), has_ahead | outside
    lefts = np.flatnonzero(~right)
    has_back, has_ahead, at = has_back[lefts], has_ahead[lefts], t[lefts]
    gap_back, gap_ahead = np.where(has_back, at - back_t[lefts], far), np.where(has_ahead, ahead_t[lefts] - at, far)
    use_ahead = has_ahead & (gap_ahead <= gap_back)
    none = np.minimum(gap_back, gap_ahead) > tolerance
    picks = pa.concat_arrays([table.column("_pick").combine_chunks().cast(pa.string()), pa.array([before[2] if before else None, after[2] if after else None], pa.string())])
    out_t = pa.array(np.where(use_ahead, ahead_t[lefts], back_t[lefts]), mask=none)
    out_pick = picks.take(pa.array(np.where(use_ahead, ahead_at[lefts], back_at[lefts]), mask=none))
    rows = table.take(pa.array(lefts))
    rows = pa.table([*(rows.column(c) for c in names), out_t, out_pick], names=[*names, "_right_t", "_right_pick"])
    yield from rows.combine_chunks().to_batches(max_chunksize=20_000)


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_time: Column, right_time: Column, tolerance: int, keep: list[str] | None = None, right_keep: list[str] | None = None) -> DataFrame:
    """Each row of ``left`` (its ``keep`` columns, all where None) with the nearest row of ``right`` of the same entity.

    Times are whole numbers of one unit (days, seconds, ...), ``tolerance`` in that unit. Adds ``matched_time`` and, with
    ``right_keep``, ``matched`` (a struct of those columns); both null where no right row is near enough. Of two equally near
    rows the later wins; of right rows at one instant the one with the smallest JSON of ``right_keep``. Left rows with null entity or time
    come back unmatched; such right rows do not count. Empty tables and clashing names on either side do no harm.

    Both sides are sorted once by (entity, time) into ranges and written to the shared folder, so an entity may span many
    tasks. Each partition then tells its first and last right record; a prefix scan over these (one row a partition, see :func:`carried`)
    gives every partition what reaches it from outside, and all left rows are matched locally.
    """
    spark = left.sparkSession
    keep = left.columns if keep is None else keep
    packed = F.struct(*[F.col(c) for c in keep])
    lefts = left.select(F.col(entity).cast("string").alias("_entity"), left_time.cast("long").alias("_t"), F.lit(1).alias("_side"), packed.alias("_row"), F.lit(None).cast("string").alias("_pick"))
    picks = F.to_json(F.struct(*[F.col(c) for c in right_keep])) if right_keep else F.lit(None).cast("string")
    rights = right.select(F.col(entity).cast("string").alias("_entity"), right_time.cast("long").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), picks.alias("_pick"))
    known = F.col("_entity").isNotNull() & F.col("_t").isNotNull()
    # right rows of one instant are one: the smallest, so that a hot instant leaves one row a task
    rights = rights.where(known).groupBy("_entity", "_t").agg(F.min("_pick").alias("_pick")).select("_entity", "_t", F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), "_pick")
    both = lefts.where(known).unionByName(rights).withColumn("_salt", F.when(F.col("_side") == 1, F.xxhash64("_row")).otherwise(0))
    tasks = max(shuffle_partitions(spark), -(-(left.count() + right.count()) // TASK_ROWS))
    order = ["_entity", "_t", "_side", "_salt"]
    placed = cut(both.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).drop("_salt"))
    edges = cut(placed.select("_pid", "_entity", "_t", "_side", "_pick").mapInArrow(_edges, EDGE))
    edge = spark.sparkContext.broadcast({r["pid"]: (r["before"], r["after"]) for r in carried(edges).collect()})  # one row a partition
    row_type = lefts.schema["_row"].dataType.simpleString()
    matched = placed.mapInArrow(lambda it: _scan(it, edge, tolerance, ["_row"]), f"_row {row_type}, _right_t long, _right_pick string")
    extra = [F.from_json("_right_pick", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in right.select(*right_keep).schema.fields)).alias("matched")] if right_keep else []
    result = matched.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_right_t").alias("matched_time"), *extra)
    lost = lefts.where(~known | known.isNull()).select(*[F.col("_row").getField(c).alias(c) for c in keep], F.lit(None).cast("long").alias("matched_time"), *([F.lit(None).cast(result.schema["matched"].dataType).alias("matched")] if right_keep else []))
    return result.unionByName(lost)
