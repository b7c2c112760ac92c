import json
import random
from datetime import date, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewire.operators import drift, instants, rolling
from tidewire.operators.instants import parse_instant
from tidewire.runtime import fresh_path

NY, SH = "America/New_York", "Asia/Shanghai"


@pytest.mark.parametrize(
    "when, day, zone, order, second",
    [
        ("2023-10-27T14:35:19Z", None, SH, "YMD", 1698417319),
        ("2023-10-27 14:35:19", None, "UTC", "YMD", 1698417319),
        ("1698417319", None, NY, "MDY", 1698417319),
        ("1698417319.999", None, NY, "MDY", 1698417319),
        ("1698417319999", None, NY, "MDY", 1698417319),
        ("20231027143519", None, "UTC", "YMD", 1698417319),
        ("2023-10-27T22:35:19+08:00[Asia/Shanghai]", None, NY, "YMD", 1698417319),
        ("2023-10-27 22:35:19+0800", None, NY, "YMD", 1698417319),
        ("2023年10月27日 下午10:35", None, SH, "YMD", 1698417300),
        ("2023年10月27日 上午12:05", None, "UTC", "YMD", 1698365100),
        ("10/27/2023 2:35 PM", None, "UTC", "MDY", 1698417300),
        ("27.10.2023 14:35", None, "UTC", "DMY", 1698417300),
        ("Oct 27, 2023 10:35:19 PM CST", None, SH, "YMD", 1698417319),
        ("Fri, 27 Oct 2023 22:35:19 +0800", None, NY, "YMD", 1698417319),
        ("　 2023-10-27  ", None, "UTC", "YMD", 1698364800),
        ("14:35", "27 Oct 2023", "UTC", "YMD", 1698417300),
        (None, "October 27, 2023", "UTC", "YMD", 1698364800),
        ("  ", "20231027", "UTC", "YMD", 1698364800),
        ("2023-11-05 01:30:00", None, NY, "MDY", 1699162200),  # twice: the first
        ("2023-11-05 01:30:00 EST", None, NY, "MDY", 1699165800),  # named: the second
        ("2023-03-12 02:30:00", None, NY, "MDY", 1678606200),  # never: 03:30 EDT
        ("2023-10-29 02:30:00 CET", None, "Europe/Berlin", "DMY", 1698543000),
    ],
)
def test_instants_of_all_kinds(when, day, zone, order, second):
    assert parse_instant(when, day, zone, order) == second


@pytest.mark.parametrize("when, day", [("unknown", "2023-11-01"), ("T+1", "2023-11-01"), ("今天 09:30", "2023-11-01"), ("2023-02-30 10:15:00", "2023-11-01"), ("2023-10-12 25:61:00", None), ("0000-00-00 00:00:00", None), ("10:15", ""), ("10:15", "-"), (None, None), ("", "2023-13-01"), ("1234", "2023-11-01")])
def test_what_has_no_instant(when, day):
    assert parse_instant(when, day, SH, "YMD") is None


@given(st.datetimes(min_value=__import__("datetime").datetime(1980, 1, 1), max_value=__import__("datetime").datetime(2037, 1, 1)))
def test_one_instant_in_every_format(t):
    second = int(t.replace(tzinfo=__import__("datetime").timezone.utc).timestamp())
    for text in (t.strftime("%Y-%m-%d %H:%M:%S"), t.strftime("%Y%m%d%H%M%S"), t.strftime("%Y.%m.%d %H:%M:%S"), t.strftime("%Y年%m月%d日 %H:%M:%S"), t.strftime("%b %d, %Y %I:%M:%S %p"), t.strftime("%Y-%m-%dT%H:%M:%SZ")):
        assert parse_instant(text, None, "UTC", "YMD") == second


def test_dictionary_grows_and_joins_back(spark):
    path = fresh_path(spark, "dictionary")
    sources = spark.createDataFrame([("a", "UTC", "YMD"), ("a", "UTC", "YMD"), ("bad", "Nowhere/None", None)], "source string, tz string, date_order string")
    rows = spark.createDataFrame([(1, "2023-11-01", None, "a", 9), (1, "2023-11-01", None, "a", 9), (2, None, None, None, 9), (3, "2023-11-01", None, None, 9), (4, "2023-11-01", None, "bad", 9)], "k int, publish_time string, publish_date string, source string, utc_second int")
    got = sorted((r.k, r.utc_second) for r in instants.normalise_instants(rows, sources, dictionary_path=path).collect() if r.k != 2)
    assert got == [(1, 1698796800), (1, 1698796800), (3, 1698768000), (4, None)]
    first = spark.read.parquet(path).count()
    more = rows.unionByName(spark.createDataFrame([(5, "2023-11-02", None, "a", 0)], rows.schema))
    assert instants.normalise_instants(more, sources, dictionary_path=path).where("k = 5").first().utc_second == 1698883200
    assert spark.read.parquet(path).count() == first + 1
    assert instants.normalise_instants(rows.limit(0), sources).count() == 0


def test_rolling_against_brute_force(spark):
    r = random.Random(5)
    facts = [(r.choice("abc"), date(2023, 1, 1) + timedelta(r.randrange(90)), r.choice([None, float("nan"), round(r.uniform(-1, 1), 4)]), "x") for _ in range(150)]
    facts += [(None, date(2023, 1, 1), 1.0, "x"), ("a", None, 1.0, "x")]
    got = rolling.rolling_totals(spark.createDataFrame(facts, "e string, d date, v double, _1_v string"), "e", "d", ["v"], (1, 7, 30, 13), 10_000).collect()
    days = {}
    for e, d, v, _ in facts:
        if e and d:
            days.setdefault(e, {}).setdefault(d, 0)
            days[e][d] += round(v * 10_000) if v is not None and v == v else 0
    assert len(got) == sum((max(x) - min(x)).days + 1 for x in days.values())
    for row in got:
        for w in (1, 7, 30, 13):
            total = sum(days[row.e].get(row.d - timedelta(i), 0) for i in range(w))
            assert row[f"v_units_{w}d"] == total
            assert row[f"v_total_{w}d"] == pytest.approx(total / 10_000)
            assert row[f"v_avg_{w}d"] == pytest.approx(total / 10_000 / w)


def _changes(spark, files):
    rows = [("f", n, json.dumps(o, ensure_ascii=False) if isinstance(o, (dict, list)) else o) for n, objects in enumerate(files, 1) for o in objects]
    raw = spark.createDataFrame(rows, "feed string, file_no int, payload string")
    return sorted((r.file_no, r.change, r.old_field, r.new_field) for r in drift.layout_changes(drift.file_footers(raw)).collect())


def test_layout_changes(spark):
    a = {"id": "1", "title": "t", "n": 1, "nested": {"x": 1}}
    b = {"news_id": "1", "title": ["t"], "nested": {"x": "s"}, "extra": True}
    assert _changes(spark, [[a], [b], [b], [a]]) == [
        (2, "added", "", "extra"), (2, "removed", "n", ""), (2, "renamed", "id", "news_id"), (2, "retyped", "nested.x", "nested.x"), (2, "retyped", "title", "title"),
        (4, "added", "", "n"), (4, "removed", "extra", ""), (4, "renamed", "news_id", "id"), (4, "retyped", "nested.x", "nested.x"), (4, "retyped", "title", "title"),
    ]


def test_misfits_change_nothing(spark):
    good = {"id": "1", "title": "t"}
    bad = ['{"id": "1", "ti', "", None, "null", '"text"', [1], "   "]
    assert _changes(spark, [[good] * 20 + bad, [good] * 20 + [{"id": "1", "title": None, "odd": 1}] + bad]) == []
    assert _changes(spark, []) == []
    assert _changes(spark, [[good], [None], [good]]) == [(2, "removed", "id", ""), (2, "removed", "title", ""), (3, "added", "", "id"), (3, "added", "", "title")]


def test_unified_news(spark):
    rows = [(1, '{"ID": 7, "article": {"title": "x"}, "title": "", "body": ["a", " ", "b"], "k": {"z": false}}'), (2, "[]"), (3, "{}"), (4, None)]
    got = drift.unified_news(spark.createDataFrame(rows, "record_no long, payload string")).orderBy("record_no").collect()
    assert [(r.record_no, r.id, r.title, r.body, r.extras) for r in got] == [(1, "7", "x", "a b", {"k.z": "false"}), (3, None, None, None, {})]


def test_rename_needs_the_same_meaning(spark):
    assert _changes(spark, [[{"id": "1", "a": 1}], [{"headline": "1", "b": 1}]]) == [(2, "added", "", "b"), (2, "added", "", "headline"), (2, "removed", "a", ""), (2, "removed", "id", "")]


def test_casts_from_the_catalogue(spark):
    lines = [("f", 1, json.dumps({"id": 7, "n": 5, "ok": True, "tags": ["a", "b"], "a.b": 1})), ("f", 1, json.dumps({"id": "x", "n": 6.5, "ok": False, "tags": "c", "N": None})), ("f", 2, json.dumps({"n": "7", "ok": "perhaps", "x": {"y": 1}})), ("f", 2, json.dumps({"n": "many", "ok": True})), ("f", 2, "{cut"), ("f", 2, None)]
    raw = spark.createDataFrame(lines, "feed string, file_no int, payload string")
    footers = drift.file_footers(raw)
    assert {(r.field, r.target) for r in drift.cast_plan(footers).collect()} == {("n", "string"), ("ok", "boolean"), ("tags", "string"), ("x.y", "number"), ("a.b", "number")}
    table = drift.typed_news(raw, footers, keep=("feed", "file_no"))
    got = {r.id or f"n{r.x_n}": r for r in table.collect()}
    assert dict(table.dtypes)["x_ok"] == "boolean" and dict(table.dtypes)["x_x_y"] == "double"
    assert got["7"].x_ok is True and got["7"].x_a_b == 1.0 and got["7"].extras == {}
    failed = next(r for r in got.values() if r.x_x_y == 1.0)
    assert failed.x_ok is None and failed.extras == {"ok": "perhaps"}
    report = {r.field: (r.target, r.given, r.cast_values, r.failed) for r in drift.cast_report(raw, footers).collect()}
    assert report["ok"] == ("boolean", 4, 1, 1)
    assert drift.typed_news(raw.limit(0), drift.file_footers(raw.limit(0)), keep=()).count() == 0
