"""Known expectations of the factor and ranking model, and hand-made cases for the rest."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import mentions, profiles, ranking, returns, selection, validation
from tidewire.sources import sinks

MENTION = "news_id string, publish_date string, publish_time string, ts_code string, stock_name string, sentiment double, relevance double, confidence double, event_importance double, sentiment_strength double, risk_flag int, event_type string, keywords string"


@pytest.fixture(scope="module")
def daily(spark):
    rows = [("n1", "2023-11-01", 0.6, 0, "业绩", "业绩|盈利"), ("n2", "2023-11-02", -0.4, 1, "风险", "风险|下滑"), ("n3", "2023-11-03", 0.2, 0, "经营", "订单|合作")]
    full = [(i, d, d, "000001.SZ", "平安银行", s, 1.0, 1.0, 1.0, 1.0, r, e, k) for i, d, s, r, e, k in rows]
    universe = spark.createDataFrame([("000001.SZ", "平安银行", "银行")], "ts_code string, name string, industry string")
    return profiles.daily_profiles(spark.createDataFrame(full, MENTION), universe).orderBy("publish_date").collect()


def test_profile_numbers(daily):
    near = lambda c, values: [r[c] for r in daily] == pytest.approx(values, abs=1e-4)
    assert near("net_sentiment_factor", [0.6, -0.4, 0.2])
    assert near("ema3_sentiment_state", [0.6, 0.1, 0.15])
    assert near("negative_shock_carry", [0.0, 0.4, 0.26])
    assert daily[0].earnings_event_factor == pytest.approx(0.6) and daily[0].earnings_event_state == pytest.approx(0.6)
    assert daily[1].risk_event_factor == pytest.approx(-0.4) and daily[1].risk_event_state == pytest.approx(-0.1333, abs=1e-4)
    assert daily[2].operations_event_factor == pytest.approx(0.2) and daily[2].operations_event_state == pytest.approx(0.0667, abs=1e-4)
    assert all(-1 <= r.state_composite_factor <= 1 for r in daily)
    assert daily[0].industry == "银行" and daily[0].top_keywords == "业绩|盈利"


def test_profiles_of_dirty_and_no_mentions(spark):
    universe = spark.createDataFrame([], "ts_code string, name string, industry string")
    rows = [("n", "2023-11-01", None, "x", None, None, float("nan"), None, None, None, None, None, None), ("n", "", None, "x", "a", 1.0, 1.0, 1.0, 1.0, 1.0, 0, "业绩", ""), ("n", "2023-11-01", None, None, "a", 1.0, 1.0, 1.0, 1.0, 1.0, 0, "业绩", "")]
    got = profiles.daily_profiles(spark.createDataFrame(rows, MENTION), universe).collect()
    assert len(got) == 1 and got[0].net_sentiment_factor == 0.0 and got[0].industry == ""
    assert profiles.daily_profiles(spark.createDataFrame([], MENTION), universe).count() == 0


def test_constant_cross_section(spark):
    frame = spark.createDataFrame([("d", 1.0)] * 3 + [("e", None), ("e", float("nan")), ("f", 1.0), ("f", 2.0), ("f", 2.0), ("f", None)], "publish_date string, x double")
    for how in (ranking.percentile, ranking.percentile_by_window):
        got = sorted((r.publish_date, r.x__signal) for r in how(frame, {"x": F.col("x")}).collect() if r.x__signal is not None)
        assert got == [("d", 0.5)] * 3 + [("f", pytest.approx(1 / 3)), ("f", pytest.approx(2.5 / 3)), ("f", pytest.approx(2.5 / 3))]


def test_negative_direction(spark):
    frame = spark.createDataFrame([("2023-11-01", c, n, s) for c, n, s in (("A", 0.8, 0.1), ("B", 0.4, 0.7), ("C", 0.6, 0.2))], "publish_date string, ts_code string, net double, shock double")
    specs = [ranking.Factor("net", 0.6, "direct"), ranking.Factor("shock", 0.4, "direct", -1), ranking.Factor("absent", 1.0, "other")]
    got = ranking.rank_stocks(frame, specs, 2).orderBy("rank_in_date").collect()
    assert [r.ts_code for r in got] == ["A", "C", "B"] and [r.selected_topk for r in got] == [1, 1, 0]
    signal = {r.ts_code: r.shock__signal for r in got}
    assert signal["B"] < signal["C"] and got[0].other_group_score == 0.0


def test_user_factors(spark):
    specs = ranking.factors_from_json('{"factors": [{"name": "text", "weight": 0.4, "group": "text"}, {"name": "momentum_20d", "weight": 0.6, "group": "market", "direction": 0}]}')
    frame = spark.createDataFrame([("d", "A", 0.9, -0.1), ("d", "B", 0.3, 0.8)], "publish_date string, ts_code string, text double, momentum_20d double")
    got = ranking.rank_stocks(frame, specs, 1).orderBy("rank_in_date").collect()
    assert got[0].ts_code == "B" and got[0].selected_topk == 1 and "text_group_score" in got[0] and "market_group_score" in got[0]
    with pytest.raises(ValueError):
        ranking.preset("none")
    with pytest.raises(ValueError):
        ranking.rank_stocks(frame, [ranking.Factor("nothing", 1.0, "x")])


def test_derived_features_and_reliability(spark):
    frame = spark.createDataFrame([("d", "A", 3, 3, 0.6, 0.1, 0.8, 0.7)], "publish_date string, ts_code string, article_count int, mention_count int, attention_factor double, sentiment_dispersion_factor double, net_sentiment_factor double, ema5_sentiment_state double")
    got = ranking.add_derived(frame).first()
    assert got.sentiment_confirmation_factor == pytest.approx(0.7) and got.coverage_reliability_factor > 0.7
    assert frame.select(ranking.reliability(frame.select("publish_date")).alias("m")).first().m == pytest.approx(0.85)


def _prices(spark):
    return spark.createDataFrame([("2023-11-03", "300750.SZ", 100.0, 0.02), ("2023-11-06", "300750.SZ", 102.0, -0.01), ("2023-11-07", "300750.SZ", 101.0, None), ("2023-11-07", "300750.SZ", 101.0, None), (None, "300750.SZ", 1.0, 1.0), ("2023-11-07", None, 1.0, 1.0)], "d string, ts_code string, close double, fwd_return_1d double").selectExpr("cast(d as date) as trade_date", "ts_code", "close", "fwd_return_1d")


def test_asof_is_strictly_later(spark):
    left = spark.createDataFrame([("2023-11-03", "300750.SZ", "x"), ("2023-11-04", "300750.SZ", "x"), ("2023-11-07", "300750.SZ", "x"), ("2023-11-03", "none", "x"), ("bad", "300750.SZ", "x"), ("2023-11-03", None, "x")], "publish_date string, ts_code string, close string")
    got = {(r.publish_date, r.ts_code): (str(r.anchor_trade_date), r.anchor_close, r.fwd_return_1d) for r in returns.asof_forward(left, _prices(spark)).collect()}
    assert got[("2023-11-03", "300750.SZ")] == got[("2023-11-04", "300750.SZ")] == ("2023-11-06", 102.0, -0.01)
    assert len(got) == 6 and all(got[k][0] == "None" for k in got if k not in {("2023-11-03", "300750.SZ"), ("2023-11-04", "300750.SZ")})


def test_forward_returns_and_topk(spark):
    got = returns.forward_returns(returns.one_quote_a_day(_prices(spark).select("trade_date", "ts_code", "close"))).orderBy("trade_date").collect()
    assert [r.fwd_return_1d for r in got] == [pytest.approx(0.02), pytest.approx(101 / 102 - 1), None]
    rows = [("d", c, s, int(s > 0.7), r, None, r) for c, s, r in (("A", 0.9, 0.04), ("B", 0.8, None), ("C", 0.5, 0.01), ("D", 0.1, -0.02))] + [("e", "A", 0.9, 0, 0.1, 0.1, 0.1)]
    panel = spark.createDataFrame(rows, "publish_date string, ts_code string, ranking_score double, selected_topk int, fwd_return_1d double, fwd_return_3d double, fwd_return_5d double")
    perf = {r.horizon: r for r in returns.evaluate_topk(panel).collect()}
    assert set(perf) == {1, 3, 5} and perf[1].topk_mean_return == pytest.approx(0.04) and perf[1].universe_mean_return == pytest.approx(0.01)
    assert perf[1].bottomk_mean_return == pytest.approx(-0.02) and perf[1].top_bottom_spread == pytest.approx(0.06) and perf[3].universe_mean_return is None
    summary = {r.horizon: r for r in returns.summarise_performance(returns.evaluate_topk(panel)).collect()}
    assert summary[1].n_dates == 1 and summary[1].hit_rate_vs_universe == 1.0 and summary[3].n_dates == 0


def test_validation(spark):
    rows = [(f"2023-11-0{i}", c, x, -x, x / 10 + j / 1000) for i, x in enumerate([-0.8, -0.2, 0.1, 0.5, 0.9], 1) for j, c in enumerate("AB")]
    panel = spark.createDataFrame([(d, c, x + (c == "B") * 0.05, s, y, y, y) for d, c, x, s, y in rows], "publish_date string, ts_code string, net double, shock double, fwd_return_1d double, fwd_return_3d double, fwd_return_5d double")
    factors = {"net": 1, "shock": -1}
    times = {(r.factor, r.horizon): r for r in validation.time_series(panel, factors).collect()}
    assert times[("net", 5)].expected_top_bottom_gap > 0 and times[("shock", 5)].expected_top_bottom_gap > 0 and times[("net", 5)].n_obs == 10
    cross = {(r.factor, r.horizon): r for r in validation.cross_section(panel, factors).collect()}
    assert cross[("net", 1)].n_dates == 5 and cross[("net", 1)].spread_corr is None and cross[("net", 1)].rank_hit_rate == 1.0
    signs = {(r.factor, r.horizon): r for r in validation.direction(panel, factors).collect()}
    assert signs[("shock", 1)].market_majority_hit_rate > 0.5 and signs[("shock", 1)].raw_direction_hit_rate >= 0.9
    assert "| net |" in validation.validation_report(validation.time_series(panel, factors), validation.direction(panel, factors))


def test_report_sections():
    summary = {"news_path": "n", "universe_path": "u", "ranking_preset": "optimized", "top_k": 1, "steps": [{"agent_name": "a", "status": "success", "message": "m"}], "ranking_summary": {"date_count": 1, "stock_count": 2, "avg_cross_section_size": 2.0, "topk_by_date": [{"publish_date": "2023-11-01", "selected_stocks": [{"stock_name": "宁德时代"}]}]}, "performance_summary": {"horizons": {"1": {"avg_excess_return": 0.01, "hit_rate_vs_universe": None}}}}
    report = sinks.run_report(summary)
    assert "宁德时代" in report and "1.0000%" in report and "NA" in report and "## 4." in report


def test_merge_of_several_events(spark):
    rows = [("n", "c", "s", e, m, v, 0.5, 0.8, r, 0.7, int(v < 0), t, k) for e, m, v, r, t, k in (("业绩", "利润增", 0.5, 0.9, "上升", ["a", "b"]), ("风险", "遭处罚", -0.3, 0.6, "未知", ["b", "c"]), ("风险", "被诉", -0.4, 0.5, "下降", ["d"]))]
    frame = spark.createDataFrame(rows, "news_id string, ts_code string, stock_name string, event_type string, event_summary string, sentiment double, sentiment_strength double, confidence double, relevance double, event_importance double, risk_flag int, trend_signal string, keywords array<string>")
    got = mentions.merge_mentions(frame).first()
    w = [0.9 * 0.8 * 0.7 * 0.75 * 1.15, 0.6 * 0.8 * 0.7 * 0.75 * 1.15, 0.5 * 0.8 * 0.7 * 0.75 * 1.15]
    assert got.sentiment == pytest.approx((0.5 * w[0] - 0.3 * w[1] - 0.4 * w[2]) / sum(w), abs=1e-4)
    assert (got.event_type, got.merged_event_types, got.trend_signal, got.risk_flag, got.merged_event_count) == ("风险", "风险|业绩", "震荡", 1, 3)
    assert got.event_summary == "利润增；遭处罚等" and got.keywords == "a|b|c|d"


def _greedy(rows, k):
    ordered = sorted(rows, key=lambda r: (-r["s"], -r["relevance"], -r["confidence"], r["news_id"]))
    taken, seen = [], set()
    for r in ordered:
        if len(taken) < k and set(r["e"]) - seen:
            taken.append(r["news_id"])
            seen |= set(r["e"])
    return (taken + [r["news_id"] for r in ordered if r["news_id"] not in taken])[:k]


def test_diverse_topk_against_greedy(spark):
    import random

    r = random.Random(2)
    rows = [(f"n{i:03d}", "2023-11-01", f"s{i % 7}", r.choice(["", "业绩|风险", "风险", "经营", "风险|业绩", None]), r.choice(["业绩", "", None]), r.choice([0.2, 0.5, 0.9]), 0.5, r.choice([0.3, None]), 0.5, 0.7, 1) for i in range(120)]
    names = "news_id publish_date ts_code merged_event_types event_type relevance confidence event_importance sentiment_strength coarse_score merged_event_count".split()
    frame = spark.createDataFrame(rows, "news_id string, publish_date string, ts_code string, merged_event_types string, event_type string, relevance double, confidence double, event_importance double, sentiment_strength double, coarse_score double, merged_event_count int")
    got = {}
    for x in selection.diverse_topk(frame).orderBy("pick").collect():
        got.setdefault(x.ts_code, []).append(x.news_id)
    for code in got:
        mine = []
        for row in rows:
            d = dict(zip(names, row))
            if d["ts_code"] == code:
                d["e"] = [p for p in (d["merged_event_types"] or "").split("|") if p] or [d["event_type"] or "其他"]
                d["s"] = round(0.35 * d["relevance"] + 0.2 * 0.5 + 0.2 * (d["event_importance"] or 0) + 0.15 * 0.5 + 0.05 * 0.7 + 0.05, 4)
                mine.append(d)
        assert got[code] == _greedy(mine, 3)
