import random

import numpy as np
import pytest

from tidewire.llm import nearest_time, rank_walk, top_runs
from pyspark.sql import functions as F


def _scores(n, seed, ties=6, missing=0.2):
    r = np.random.default_rng(seed)
    x = r.integers(0, ties, (n, 4)).astype(float)
    x[r.random((n, 4)) < missing] = np.nan
    return x


@pytest.mark.parametrize("n, seed", [(1, 0), (2, 1), (25, 2), (40, 3)])
def test_walk_is_the_chain(n, seed):
    x = _scores(n, seed)
    assert np.allclose(rank_walk.walk(x, rounds=60, tolerance=0), rank_walk.brute_walk(x, rounds=60), atol=1e-12)


def test_scale_does_not_count():
    x = _scores(50, 4, ties=1000)
    assert np.allclose(rank_walk.walk(x), rank_walk.walk(np.exp(x / 50) * [1, 1e9, 1e-9, 7] + [0, 5, -5, 1]))


def _frame(spark, groups):
    rows = [(g, f"i{k:03d}", *(None if v != v and k % 2 else float(v) for v in row), "x") for g, x in groups.items() for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "g string, item string, a double, b double, c double, d double, walk_rank string")


def test_rank_walk_local_and_wide_agree(spark):
    frame = _frame(spark, {"p": _scores(30, 5), "q": _scores(9, 6), "r": np.full((3, 4), np.nan)})
    frame = frame.union(frame.limit(5)).union(spark.createDataFrame([(None, "z", 1.0, 1.0, 1.0, 1.0, "x"), ("p", None, 1.0, 1.0, 1.0, 1.0, "x")], frame.schema))
    signs = {"a": 1, "b": -1, "c": 1, "d": 1}
    local = {(r.g, r["item"]): (round(r.stationarity, 10), r.walk_rank) for r in rank_walk.rank_walk(frame, "g", "item", signs, rounds=4).collect()}
    wide = {(r.g, r["item"]): (round(r.stationarity, 10), r.walk_rank) for r in rank_walk.rank_walk(frame, "g", "item", signs, rounds=4, local_rows=10).collect()}
    assert len(local) == 42 and local == wide
    assert [local[("r", f"i00{k}")][1] for k in range(3)] == [1, 2, 3]  # no scores: by item
    assert rank_walk.rank_walk(frame.limit(0), "g", "item", signs).count() == 0
    assert rank_walk.rank_walk(frame, "g", "item", signs, top=2).count() == 6


def test_dominating_item_wins_and_missing_scores_are_neutral():
    x = np.array([[5, 5, 5, 5], [4, 4, 4, np.nan], [3, 3, 3, 5.0], [2, 2, 2, 2], [1, 1, 1, 1]])
    order = np.argsort(-rank_walk.walk(x))
    assert order[0] == 0 and order[-1] == 4 and list(order).index(1) < list(order).index(3)


def test_loser_tree_sorts():
    r = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(1, 20))) for _ in range(k)]
        at, tree, out = [0] * k, top_runs.LoserTree([x[0] for x in runs]), []
        while tree.heads[tree.winner()] is not None:
            w = tree.winner()
            out.append(tree.heads[w])
            at[w] += 1
            tree.replay(w, runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(v for x in runs for v in x)


def test_top_n_against_window(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice(["x", "y", None]), r.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")]), r.choice(["n1", "n2", "n3", "n4", "n5", None]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, h string, score double, tie string, place int").repartition(7)
    monkeypatch.setattr(top_runs, "RUN_ROWS", 50)
    key = lambda x: sorted((v.g, v.h, v.score, v.tie or "", v.place) for v in x.collect())
    for n in (1, 3, 100):
        assert key(top_runs.top_n_per_group(frame, ["g", "h"], "score", ["tie"], n)) == key(top_runs.top_n_window(frame, ["g", "h"], "score", ["tie"], n))
    assert top_runs.top_n_per_group(frame.limit(0), ["g", "h"], "score", ["tie"], 3).count() == 0


def test_nearest_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(nearest_time, "TASK_ROWS", 40)  # entities span many tasks
    left = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, *range(300)]), i) for i in range(400)]
    right = [(r.choice(["a", "b", "b", None]), r.choice([None, *range(0, 300, 2)]), r.random(), i) for i in range(150)]
    lefts = spark.createDataFrame(left, "e string, t long, matched_time int")
    rights = spark.createDataFrame(right, "e string, t long, v double, _row int")
    got = nearest_time.nearest_in_time(lefts.withColumnRenamed("matched_time", "n"), rights, "e", F.col("t"), F.col("t"), 3, right_keep=["v"]).collect()
    assert len(got) == 400
    for row in got:
        near = sorted(((abs(t - row.t), -t, t, v) for e, t, v, _ in right if e is not None and t is not None and e == row.e and row.t is not None and abs(t - row.t) <= 3))
        assert row.matched_time == (near[0][2] if near else None)
        if near:
            assert row.matched.v in [v for _, _, t, v in near if t == near[0][2]]
        else:
            assert row.matched is None
    assert nearest_time.nearest_in_time(lefts.select("e", "t").limit(0), rights, "e", F.col("t"), F.col("t"), 3).count() == 0
    alone = nearest_time.nearest_in_time(lefts.select("e", "t"), rights.limit(0), "e", F.col("t"), F.col("t"), 3)
    assert alone.where("matched_time is not null").count() == 0 and alone.count() == 400


def test_prefix_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest_time, "SCAN_BLOCK", 3)
    r = random.Random(3)
    rows = [(p, *(("e", p * 10, f"f{p}", "e", p * 10 + 5, f"l{p}") if r.random() < 0.4 else (None,) * 6)) for p in range(20)]
    got = {x.pid: (x.before and x.before.pick, x.after and x.after.pick) for x in nearest_time.carried(spark.createDataFrame(rows, nearest_time.EDGE)).collect()}
    full = [p for p, *rest in rows if rest[0]]
    assert got == {p: (next((f"l{q}" for q in reversed(full) if q < p), None), next((f"f{q}" for q in full if q > p), None)) for p in range(20)}


def test_runs_out_of_order_are_sorted_again():
    import pyarrow as pa

    run = pa.table({"g": ["a", "a", "b"], "s": [2.0, 1.0, 5.0], "t": ["x", None, "y"]})
    assert top_runs._in_order(run, ["g"], "s", ["t"]) is run
    assert top_runs._in_order(run.take([2, 1, 0]), ["g"], "s", ["t"]).equals(run)
