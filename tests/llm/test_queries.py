import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same  # noqa: E402

from tidewire.llm import leaks, queries, rank_walk  # noqa: E402

FOUND = {"p1_found": ["publish_date", "ts_code"], "p2_found": ["ts_code", "publish_date", "news_id"], "p4_found": ["ts_code", "publish_date", "trade_date"], "p6_found": ["record_a", "record_b"], "p8_found": ["doc_id", "item_id"]}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tiny, name):
    same(spark, connect(tiny), queries.queries()[name], queries.oracle_sql()[name], tiny)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, tiny, name):
    assert queries.queries()[name](spark, tiny).count() > 0


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_its_columns_and_distinct_rows(spark, tiny, name):
    found = queries.queries()[name](spark, tiny)
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == FOUND[name] and len(rows) == len(set(rows)) > 0


def test_best_profiles_agree_with_mean_standing(spark, tiny):
    """A plainer measure, the mean percentile, picks the same three of each date."""
    frame = spark.read.parquet(f"{tiny}/daily_profiles.parquet").toPandas()[["publish_date", "ts_code", *queries.PROFILE_SCORES]].drop_duplicates()
    signed = frame[list(queries.PROFILE_SCORES)] * list(queries.PROFILE_SCORES.values())
    frame["standing"] = signed.groupby(frame.publish_date).rank(pct=True).mean(axis=1)
    best = {(r.publish_date, r.ts_code) for _, g in frame.groupby("publish_date") for r in g.nlargest(3, "standing").itertuples()}
    got = {tuple(r) for r in queries.p1_found(spark, tiny).collect()}
    assert len(best & got) >= 0.9 * len(best)


def test_leaks_against_all_windows(spark, tiny):
    documents, items = (spark.read.parquet(f"{tiny}/{t}.parquet").toPandas() for t in ("documents", "eval_items"))
    grams: dict[str, set] = {}
    for k, t in zip(items.item_id, items.text):
        clean = leaks.normalise(t)
        for i in range(len(clean) - 59):
            grams.setdefault(clean[i : i + 60], set()).add(k)
    truth = set()
    for k, t in zip(documents.doc_id, documents.text):
        clean = leaks.normalise(t)
        truth |= {(k, i) for p in range(len(clean) - 59) for i in grams.get(clean[p : p + 60], ())}
    assert {tuple(r) for r in queries.p8_found(spark, tiny).collect()} == truth


def test_ranks_are_complete(spark, tiny):
    ranked = queries.p1_ranking(spark, tiny).toPandas()
    assert all(sorted(g.walk_rank) == list(range(1, len(g) + 1)) for _, g in ranked.groupby("publish_date")) and rank_walk.LOCAL_ROWS >= ranked.groupby("publish_date").size().max()
