import json

import pytest
from pyspark.sql import functions as F

from tidewire.__main__ import _parser, main
from tidewire.functions.text import squeeze, text
from tidewire.operators import ingest, matching, mentions, relevance, selection
from tidewire.plans import pipeline
from tidewire.sources import files, sinks
from tidewire.streaming import ingest as stream

UNIVERSE = "ts_code,name,industry,aliases\n000001.SZ,平安银行,银行,平安|平安银行\n601318.SH,中国平安,保险,平安；中国平安、PING AN\n300750.SZ,宁德时代,电池,宁王/CATL\n,无码,x,y\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("news")
    lines = [
        {"id": "007", "title": "宁德时代业绩增长", "content": "宁王 CATL 签约订单", "publish_time": "2023-11-01 10:00:00", "language": "zh"},
        {"id": "007", "title": "repeated id", "content": "x", "publish_time": "2023-11-01", "language": "zh"},
        {"article": {"title": "平　安银行风险", "content": ["处罚", "调查"]}, "date": "2023-11-02", "Language": "ZH"},
        {"title": "English", "body": "text", "language": "en"},
        {"title": "", "body": ""},
    ]
    (d / "a.jsonl").write_text("\n".join([*(json.dumps(x, ensure_ascii=False) for x in lines), "", "{broken", "[1]"]), encoding="utf-8")
    (d / "b.json").write_text(json.dumps({"items": [{"doc_id": "j1", "headline": "中国平安发布新品", "text": "继续改善", "time": "2023-11-02T10:00:00Z"}, 5]}, ensure_ascii=False), encoding="utf-8")
    (d / "c.csv").write_text('news_id,title,body,datetime\n000009,"多行\n标题",平安诉讼,2023-11-03\n', encoding="utf-8")
    (d / "skip.txt").write_text("x")
    (d / "universe.tsv").write_text(UNIVERSE, encoding="utf-8")
    return d


@pytest.fixture(scope="module")
def stocks(spark, corpus):
    return files.read_universe(spark, str(corpus / "universe.tsv"))


def test_sources(spark, corpus, stocks):
    raw = files.read_raw_news(spark, str(corpus))
    assert sorted(f.rsplit("/", 1)[1] for f in files.list_files(spark, str(corpus))) == ["a.jsonl", "b.json", "c.csv"]
    news = {r.id: r for r in ingest.normalise_news(raw, ["zh"]).collect()}
    assert len(news) == 4 and news["007"].publish_time == "2023-11-01 10:00:00" and news["j1"].publish_time == "2023-11-02 18:00:00" and news["000009"].publish_date == "2023-11-03"
    made = next(r for r in news.values() if r.title == "平　安银行风险")
    assert len(made.id) == 16 and made.body == "处罚 调查" and made.language == "zh"
    assert files.read_raw_news(spark, str(corpus), skip_parts=(".json", ".csv")).count() == 0
    got = {r.ts_code: r.aliases for r in stocks.collect()}
    assert got == {"000001.SZ": ["平安", "平安银行"], "601318.SH": ["平安", "中国平安", "PING AN"], "300750.SZ": ["宁王", "CATL", "宁德时代"]}
    with pytest.raises(ValueError):
        files.universe(spark.createDataFrame([("x",)], "name string"))
    assert spark.createDataFrame([("600000.SH",), ("000001.SZ",)], "c string").select(files.quote_id(F.col("c"))).collect()[0][0] == "1.600000"


def test_text_functions(spark):
    row = spark.createDataFrame([("　A b C\n", None)], "x string, y string").select(squeeze("x"), text("x"), text("y"), squeeze("y")).first()
    assert tuple(row) == ("abc", "A b C", "", "")


def test_first_of(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "")], "n int, id string")
    assert sorted(r.n for r in ingest.first_of(rows, ["id"], ["n"], skip_empty=True).collect()) == [1, 3, 4, 5]
    assert sorted(r.n for r in ingest.first_of(rows, ["id"], ["n"]).collect()) == [1, 3, 4]


def test_relevance_branches(spark):
    rows = [(1, "公司净利润", ""), (2, "银行白酒", ""), (3, "电影 期货", "机器人"), (4, "比赛", "旅游"), (5, None, None), (6, "省委 银行 光伏", "集团")]
    news = spark.createDataFrame(rows, "n int, title string, body string")
    broad = {r.n: (r.filter_score, r.filter_keep) for r in relevance.broad_relevance(news).collect()}
    assert broad == {1: (3.0, True), 2: (3.0, True), 3: (-0.5, False), 4: (-5.0, False), 5: (0.0, False), 6: (3.0, True)}
    strict = {r.n: (r.filter_score, r.filter_keep) for r in relevance.strict_relevance(news).collect()}
    assert strict[1] == (4.3, True) and strict[2] == (2.4, False) and strict[6] == (0.3, False)
    one = spark.createDataFrame([("宁德时代发布财报", "宁王订单", "宁德时代", "宁王"), ("", "宁王", "宁德时代", "宁王"), ("招商大会", "", "x", "")], "title string, body string, primary_stock_name string, matched_aliases string")
    got = {r.title: r for r in relevance.study_relevance(one).collect()}
    assert got["宁德时代发布财报"].study_keep and got["宁德时代发布财报"].study_score == pytest.approx(4 + 1.8 + 0.7 + 1.6 + 0.6)
    assert not got[""].study_keep and got[""].study_alias_only == 1 and got["招商大会"].study_score == pytest.approx(-3.2)


def test_matching(spark, corpus, stocks):
    news = spark.createDataFrame([(1, "平安银行", "平安"), (2, "catl  宁 王", None), (3, "无关", ""), (4, None, None)], "record_no int, title string, body string")
    got = {(r.record_no, r.ts_code): (r.matched_aliases, r.coarse_score, r.candidate_rank) for r in matching.coarse_match(news, stocks).collect()}
    assert got == {(1, "000001.SZ"): (["平安", "平安银行"], 0.85, 1), (1, "601318.SH"): (["平安"], 0.74, 2), (2, "300750.SZ"): (["宁王", "CATL"], 0.85, 1)}
    assert matching.coarse_match(news, stocks, most=1).count() == 2 and matching.coarse_match(news.limit(0), stocks).count() == 0
    scores = {(r.record_no, r.ts_code): r.match_score for r in matching.record_match(news, stocks).collect()}
    assert scores == {(1, "000001.SZ"): 24, (1, "601318.SH"): 12, (2, "300750.SZ"): 24}
    kept = {(r.record_no, r.ts_code): r.score for r in matching.quarter_match(news, stocks).collect()}
    assert kept[(1, "000001.SZ")] == pytest.approx(8 + 8 + 1.0) and kept[(1, "601318.SH")] == pytest.approx(4 - 0.2 - 1.0)


def test_rule_mentions_and_skips(spark, corpus, stocks):
    raw = files.read_raw_news(spark, str(corpus))
    news = ingest.normalise_news(raw, ["zh"]).withColumn("record_no", F.xxhash64("raw_source_file", "line_no"))
    told, skipped = mentions.structure_news(news, stocks)
    got = {(r.news_id, r.ts_code): r for r in told.collect()}
    m = got[("007", "300750.SZ")]
    assert m.event_type == "业绩" and m.sentiment == pytest.approx(0.18 * 2 + 0.08) and m.risk_flag == 0 and m.trend_signal == "上升" and m.merged_event_count == 1
    assert m.keywords.split("|")[:3] == ["宁王", "CATL", "宁德时代"] and skipped.count() == 0


def test_model_mentions(spark, stocks):
    news = spark.createDataFrame([(1, "i1", "d", "t", "平安银行", "x"), (2, "i2", "d", "t", "宁王", "x"), (3, "i3", "d", "t", "平安", "x"), (4, "i4", "d", "t", "none", "x")], "record_no long, id string, publish_date string, publish_time string, title string, body string")

    def ask(title, body, candidates):
        if title == "宁王":
            raise TimeoutError
        code = "601318.SH" if title == "平安" else "000001.SZ"
        return "answer: " + json.dumps({"mentions": [{"ts_code": code, "event_type": "业绩", "event_summary": " ", "sentiment": 3, "sentiment_strength": 0, "confidence": 0.5, "relevance": 1.0, "event_importance": 0.5, "risk_flag": 0, "trend_signal": "上升", "keywords": ["k"]}, {"ts_code": "none"}]})

    told, skipped = mentions.structure_news(news, stocks, ask=ask)
    got = {r.news_id: r for r in told.collect()}
    assert set(got) == {"i1", "i3"} and got["i1"].sentiment == 1.0 and got["i1"].sentiment_strength == 1.0 and got["i1"].event_summary == "平安银行相关业绩舆情"
    assert {r.news_id: r.reason for r in skipped.collect()} == {"i2": "llm_error:TimeoutError", "i4": "no_alias_match"}


def test_quota_and_topk(spark):
    rows = spark.createDataFrame([(i, f"c{i % 2}") for i in range(10)], "n int, ts_code string")
    assert sorted(r.n for r in selection.quota_per_stock(rows, ["n"], 2).collect()) == [0, 1, 2, 3] and selection.quota_per_stock(rows, ["n"], 0).count() == 10
    records = spark.createDataFrame([("a", "d", "c", 5.0, 0, 1, ""), ("b", "d", "c", 5.0, 1, 1, "x"), ("e", "d", "c", 9.0, 0, 1, "x"), ("e", "d", "c", 9.0, 0, 1, "x"), ("f", "", "c", 9.0, 0, 1, "x"), ("g", "d", None, 9.0, 0, 1, "x")], "id string, publish_date string, primary_ts_code string, study_score double, study_has_full_name int, matched_stock_count int, study_finance_hits string")
    assert [r.id for r in selection.daily_topk(records, 2, order=["id"]).orderBy("place_in_day").collect()] == ["e", "b"]
    assert [r.id for r in selection.best_per_stock(records.where("publish_date <> ''"), "study_score", 6.0, 1).orderBy("id").collect()] == ["e", "g"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 == 0, f"c{i % 2}") for i in range(10)], "n int, keep boolean, code string")
    assert sinks.write_split(rows, "keep", f"{tmp_path}/k", f"{tmp_path}/r", "code") == {"total": 10, "kept": 4, "rejected": 6, "counts_by_stock": {"c0": 2, "c1": 2}}
    assert spark.read.json(f"{tmp_path}/k").count() == 4
    manifest = sinks.write_batches(rows, ["n"], f"{tmp_path}/b", 4)
    assert [m["record_count"] for m in manifest] == [4, 4, 2]
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/b/batch_index=1").collect()) == [4, 5, 6, 7]
    fixed = ingest.union_repaired([spark.createDataFrame([("a", "1.5")], "id string, v string"), spark.createDataFrame([("b", "bad", "z")], "id string, v string, w string")], ["v"])
    assert sorted(tuple(r) for r in fixed.collect()) == [("a", 1.5, ""), ("b", 0.0, "z")]


def test_pipeline_and_command_line(spark, corpus, stocks, tmp_path):
    prices = spark.createDataFrame([(f"2023-11-0{d}", c, 10.0 + d) for d in range(1, 9) for c in ("000001.SZ", "601318.SH", "300750.SZ")], "trade_date string, ts_code string, close double").withColumn("trade_date", F.expr("cast(trade_date as date)"))
    news = pipeline.load_news(spark, str(corpus), ["zh"])
    result = pipeline.run_pipeline(spark, news, stocks, prices, "optimized", 1, f"{tmp_path}/out")
    assert [s["agent_name"] for s in result["steps"]] == ["sentiment_analysis_agent", "factor_agent", "ranking_agent", "evaluation_agent"] and "## 3." in result["report"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/ranking_topk").count() == result["ranking_summary"]["date_count"] == 3
    found = pipeline.experiment_set(news, stocks)
    assert found.count() == 4 and pipeline.experiment_set_from_raw(files.read_raw_news(spark, str(corpus)), stocks).where("id = '007'").count() == 1
    main(["prepare-data", "--raw", str(corpus), "--out", f"{tmp_path}/news"])
    assert spark.read.json(f"{tmp_path}/news").count() == 4
    main(["filter-data", "--news", str(corpus), "--out", f"{tmp_path}/kept", "--mode", "strict"])
    assert _parser().parse_args(["baseline", "--news", "n", "--universe", "u", "--out", "o", "--keyword", "a", "--keyword", "b"]).keyword == ["a", "b"]


def test_texts_are_read_longest_first(spark, stocks):
    """A text with only a longer name is none of a stock that has part of it as an alias."""
    nested = files.quarter_universe(spark.createDataFrame([("a", "平安银行", "x", "平安银行"), ("b", "平安", "y", "平安集团"), ("c", "银行业", "z", "")], "ts_code string, name string, industry string, aliases string"))
    news = spark.createDataFrame([(1, "平安银行净利润", "业绩预告"), (2, "平安银行与平安 净利润", "业绩"), (3, "净利润", "平安银 行业绩"), (4, None, None)], "record_no int, title string, body string")
    got = {(r.record_no, r.ts_code) for r in matching.quarter_match(news, nested).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b"), (3, "a")}
    assert matching.leading("abcab", [(1, "ab"), (2, "abc"), (4, "ab"), (4, "cab")]) == {"abc", "ab"}
    assert {(r.record_no, r.ts_code) for r in matching.coarse_match(news, nested).collect()} >= {(1, "b")}


def test_quarter_set_and_batches(spark, corpus, tmp_path):
    raw = spark.createDataFrame([(json.dumps({"id": i, "title": t, "content": "业绩预告 净利润", "date": d, "language": "zh"}, ensure_ascii=False), "f", n) for n, (i, t, d) in enumerate([("x", "宁德时代 净利润", "2023-11-01"), ("x", "宁德时代 再来", "2023-11-01"), ("y", "宁德时代", "2023-11-01"), ("z", "宁德时代", "2022-11-01"), ("w", "无关", "2023-11-01")])], "payload string, raw_source_file string, line_no int")
    stocks = files.quarter_universe(spark.createDataFrame([("300750.SZ", "宁德时代", "电池", "宁王")], "ts_code string, name string, industry string, aliases string"))
    best, counts = pipeline.quarter_candidates(raw, stocks, "2023-10-01", "2023-12-31")
    assert [r.id for r in best.orderBy("id").collect()] == ["x__300750.SZ", "y__300750.SZ"] and counts["matched_articles"] == 2 and counts["days_by_stock"] == {"300750.SZ": 1}
    news = pipeline.load_news(spark, str(corpus), ["zh"], limit=2)
    assert news.count() == 2
    sinks.write_batches(pipeline.load_news(spark, str(corpus), ["zh"]), ["raw_source_file", "line_no"], f"{tmp_path}/b", 3)
    for status in ("done", "skipped"):
        done = pipeline.run_batches(spark, f"{tmp_path}/b", files.read_universe(spark, str(corpus / "universe.tsv")), f"{tmp_path}/o")
        assert [d["status"] for d in done] == [status, status]
    with pytest.raises(Exception, match="no JSON object"):
        files.only_objects(files.read_raw_news(spark, str(corpus / "a.jsonl"))).collect()
    sinks.write_summary(spark, {"a": 1}, f"{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1}


def test_study_files_keep_their_columns(spark):
    frame = spark.createDataFrame([(1.0, "x")], "study_score double, study_finance_hits string")
    assert sinks.to_study_file(frame).columns == ["thesis_relevance_score", "thesis_finance_hits"] and sinks.from_study_file(sinks.to_study_file(frame)).columns == frame.columns


def test_stream(spark, corpus, tmp_path):
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for _ in range(2):  # nothing is read twice
        stream.ingest_stream(spark, f"{corpus}/a.jsonl*", out, checkpoint, ["zh"]).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    counts = stream.mention_counts(spark.createDataFrame([("2023-11-01 10:00:00", "a", 0.5), ("2023-11-01 12:00:00", "a", 0.1), ("bad", "a", 1.0)], "publish_time string, ts_code string, sentiment double")).collect()
    assert len(counts) == 1 and counts[0].mentions == 2 and counts[0].sentiment == pytest.approx(0.3)
