"""The N best items of every group: sorted runs merged by a loser tree that seeks past finished groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import tasks_for

RUN_ROWS = 400_000  # rows sorted at once while runs are made
READ_ROWS = 4_096  # rows of a run whose keys are held at once while runs are merged


class LoserTree:
    """A tournament over the heads of k runs: the winner is the smallest key, and a run that moves on replays one path."""

    def __init__(self, heads: list):
        self.heads = heads  # a key for each run, None for a run that is over
        self.k = len(heads)
        self.tree = [-1] * max(self.k, 1)
        for run in range(self.k):
            self._enter(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x < y if x != y else a < b

    def _enter(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                run, self.tree[node] = self.tree[node], run
            node //= 2
        self.tree[0] = run

    def winner(self) -> int:
        return self.tree[0]

    def replay(self, run: int, head) -> None:
        """``run``, the present winner, shows ``head`` now."""
        self.heads[run] = head
        node = (run + self.k) // 2
        while node > 0:
            if self._less(self.tree[node], run):
                run, self.tree[node] = self.tree[node], run
            node //= 2
        self.tree[0] = run


def _sorted(table: pa.Table, groups: list[str], score: str, ties: list[str]) -> pa.Table:
    keys = [(g, "ascending") for g in groups] + [(score, "descending")] + [(t, "ascending") for t in ties]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row differs from the one before it in ``columns`` (null equals null)."""
    n = len(table)
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for c in columns:
        x = table.column(c).combine_chunks()
        a, b = x.slice(1), x.slice(0, max(n - 1, 0))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return out


def _pruned(table: pa.Table, groups: list[str], score: str, ties: list[str], n: int) -> pa.Table:
    """A run: sorted, repeated rows taken once, at most the first ``n`` of each group."""
    table = _sorted(table, groups, score, ties)
    table = table.filter(pa.array(_changes(table, [*groups, score, *ties])))
    start = np.flatnonzero(_changes(table, groups))
    place = np.arange(len(table)) - np.repeat(start, np.diff(np.r_[start, len(table)]))
    return table.filter(pa.array(place < n))


def _make_runs(batches: Iterator[pa.RecordBatch], groups: list[str], score: str, ties: list[str], n: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held, rows, made = [], 0, 0
    task = TaskContext.get().partitionId()

    def run() -> Iterator[pa.RecordBatch]:
        nonlocal made
        table = _pruned(pa.Table.from_batches(held), groups, score, ties, n)
        table = table.append_column("_run", pa.array(np.full(len(table), task * 4096 + made % 4096), pa.int64()))
        made += 1
        yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= RUN_ROWS:
            yield from run()
            held, rows = [], 0
    if rows:
        yield from run()


class Run:
    """The keys of a sorted run, some rows at a time: groups, falling score, ties (null last)."""

    def __init__(self, table: pa.Table, groups: list[str], score: str, ties: list[str]):
        self.table, self.columns, self.rows = table, (groups, score, ties), len(table)
        start = np.flatnonzero(_changes(table, groups))
        self.ends = np.repeat(np.r_[start[1:], self.rows], np.diff(np.r_[start, self.rows]))
        self.at, self.low, self.keys = 0, 0, []

    def head(self) -> tuple | None:
        if self.at >= self.rows:
            return None
        if not self.low <= self.at < self.low + len(self.keys):
            groups, score, ties = self.columns
            part = self.table.slice(self.at, READ_ROWS)
            columns = [part.column(g).to_pylist() for g in groups] + [[-x for x in part.column(score).to_pylist()]]
            columns += [[(x is None, x if x is not None else 0) for x in part.column(t).to_pylist()] for t in ties]
            self.low, self.keys = self.at, list(zip(*columns))
        return self.keys[self.at - self.low]

    def seek(self) -> None:
        """On to the next group."""
        self.at = int(self.ends[self.at])


def merge_runs(runs: list[pa.Table], groups: list[str], score: str, ties: list[str], n: int) -> pa.Table:
    """The first ``n`` different rows of each group over all sorted ``runs``, in order, with their place as ``place``."""
    if not runs:
        return None
    readers = [Run(r, groups, score, ties) for r in runs]
    tree = LoserTree([r.head() for r in readers])
    g, base = len(groups), np.cumsum([0, *(len(r) for r in runs)])
    take, place = [], []
    group, last, count = None, None, 0
    while (key := tree.heads[tree.winner()]) is not None:
        run = tree.winner()
        if key[:g] != group:
            group, last, count = key[:g], None, 0
        if count >= n:
            readers[run].seek()  # nothing more of this group is needed
        else:
            if key != last:
                take.append(int(base[run]) + readers[run].at)
                count += 1
                place.append(count)
                last = key
            readers[run].at += 1
        tree.replay(run, readers[run].head())
    return pa.concat_tables(runs).take(pa.array(take, pa.int64())).append_column("place", pa.array(place, pa.int32()))


def _in_order(run: pa.Table, groups: list[str], score: str, ties: list[str]) -> pa.Table:
    """A run as it was stored: the shuffle hands on each task's rows in their order, which is looked at here; a run that isn't in order is sorted again."""
    open_ = np.ones(max(len(run) - 1, 0), bool)  # neighbours that are equal so far
    for c, falling in [*((g, False) for g in groups), (score, True), *((t, False) for t in ties)]:
        x = run.column(c).combine_chunks()
        a, b = x.slice(0, len(open_)), x.slice(1)
        if falling:
            a, b = b, a
        null_a, null_b = pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False)
        less = pc.fill_null(pc.less(a, b), False).to_numpy(zero_copy_only=False) | (~null_a & null_b)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (null_a & null_b)
        if (open_ & ~less & ~same).any():
            return _sorted(run, groups, score, ties)
        open_ &= same
    return run


def _merge(batches: Iterator[pa.RecordBatch], groups: list[str], score: str, ties: list[str], n: int) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    run = table.column("_run").to_numpy()
    order = np.argsort(run, kind="stable")
    cuts = np.flatnonzero(np.diff(run[order])) + 1
    table = table.drop_columns(["_run"])
    runs = []
    for part in np.split(order, cuts):
        runs.append(_in_order(table.take(pa.array(part)), groups, score, ties))
    yield from merge_runs(runs, groups, score, ties, n).combine_chunks().to_batches(max_chunksize=20_000)


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, payload: list[str] | None = None) -> DataFrame:
    """The up to ``n`` rows with the highest ``score`` of each group, with ``place`` 1..n: ``groups, score, ties, payload..., place``.

    Equal scores are ordered by ``ties`` (null last). Rows equal in groups, score and ties are one; which of
    them gives the payload is open unless the payload is equal too. Rows with a null group column, or a null or
    NaN score, do not take part. Only the named columns are read. An empty table gives an empty result.

    Each input task sorts what it reads into runs and keeps ``n`` rows of a group in each, so a group with a third of
    all rows leaves a task with ``n`` rows; only those are shuffled, bucketed by group. A bucket's task merges its runs
    with a loser tree and, after ``n`` outputs, seeks every run to its next group. As runs are cut to ``n`` rows a group before they travel, a
    seek passes over fewer than ``n`` rows of each run. The number of buckets follows the planner's estimate of the table's size.
    """
    columns = list(dict.fromkeys([*groups, score, *ties, *(payload or [])]))
    present = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    for g in groups:
        present &= F.col(g).isNotNull()
    rows = df.where(present).select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    runs = rows.mapInArrow(lambda it: _make_runs(it, groups, score, ties, n), schema + ", `_run` long")
    return runs.repartition(tasks_for(rows), *groups).mapInArrow(lambda it: _merge(it, groups, score, ties, n), schema + ", place int")


def top_n_window(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The same rows by a ranking window, for tests."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).dropna(subset=groups).select(*groups, score, *ties).distinct()
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
