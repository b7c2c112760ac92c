import pytest
from compare import connect, same

import __spark_entry__
from tidewire.plans import dataprep, oracles, reference

SQL = oracles.oracle_sql() | dataprep.oracle_sql()
QUERIES = reference.queries() | dataprep.queries()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, tiny, name):
    same(spark, con, QUERIES[name], SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_study_queries_have_no_quota(spark, tiny, monkeypatch):
    news, universe = reference._news(spark, tiny), reference._universe(spark, tiny)
    one = reference.matching.record_match(news, universe).first()["record_no"]
    many = news.where(news.record_no == one).limit(1).drop("record_no").crossJoin(spark.range(600).withColumnRenamed("id", "record_no"))
    monkeypatch.setattr(reference, "_news", lambda *_: many)
    assert reference.ref_f10_study_relevance(spark, tiny).count() == 600
