"""Command line: one command for each step of the engine."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from tidewire.operators import profiles, ranking, relevance, returns, selection, validation
from tidewire.plans import pipeline
from tidewire.runtime import build_session, cut
from tidewire.sources import files, sinks


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewire")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **options) -> None:
        p = commands.add_parser(name)
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is list:
                p.add_argument(flag, action="append")
            elif default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)

    command("baseline", "news", "universe", "out", keyword=list, date_from=None, date_to=None, limit=0, max_candidates=8, body_chars=1600)
    command("prepare-data", "raw", "out", limit=0, languages="zh")
    command("filter-data", "news", "out", rejected=None, mode="broad")
    command("build-experiment-set", "news", "universe", "out", max_per_stock=500, max_total=2500, date_from="2020-01-01", date_to=None)
    command("build-experiment-set-from-raw", "raw", "universe", "out", max_per_stock=0, max_total=0, date_from="2023-01-01", date_to="2023-12-31", language="zh")
    command("refine-thesis-set", "records", "out", rejected=None)
    command("select-thesis-llm-set", "records", "out", min_score=16.0, max_per_stock=700)
    command("build-daily-topk-set", "records", "out", top_k=3, date_from="2023-11-01", date_to="2023-11-30")
    command("run-agent-pipeline", "news", "universe", "prices", "out", preset="optimized", top_k=5, date_from=None, date_to=None)
    command("rank", "profiles", "out", preset="all", top_k=5)
    command("evaluate", "ranked", "prices", "out")
    command("compare-presets", "profiles", "prices", "out", presets="direct,state,event,optimized", top_k="1,3,5")
    command("validate-factors", "profiles", "prices", "out")
    command("build-quarter-set", "raw", "universe", "out", date_from="2023-10-01", date_to="2023-12-31", language="zh", top_k=10)
    command("run-batches", "batches", "universe", "out", start=0, end=None, again=False)
    command("create-batches", "news", "out", batch_size=300)
    command("select-diverse", "mentions", "out", top_k=3)
    command("rebuild-profiles", "mentions", "universe", "out")
    return top


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = build_session()
    table = lambda path: spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    lines = lambda path: spark.read.json(path)
    if a.command == "baseline":
        pipeline.run_baseline(spark, pipeline.load_news(spark, a.news), files.read_universe(spark, a.universe), a.out, a.keyword, a.date_from, a.date_to, a.limit, a.max_candidates, a.body_chars)
    elif a.command == "prepare-data":
        sinks.write_json_lines(pipeline.load_news(spark, a.raw, [x for x in a.languages.split(",") if x], a.limit).drop("record_no", "line_no"), a.out)
    elif a.command == "filter-data":
        decide = relevance.strict_relevance if a.mode == "strict" else relevance.broad_relevance
        lines_read = files.read_raw_news(spark, a.news).where("trim(payload) <> ''").count()
        print(json.dumps(sinks.write_split(decide(pipeline.load_news(spark, a.news, dedup_files=False)), "filter_keep", a.out, a.rejected, total=lines_read)))
    elif a.command == "build-experiment-set":
        news = pipeline.load_news(spark, a.news)
        found = cut(pipeline.experiment_set(news, files.read_universe(spark, a.universe), a.max_per_stock, a.max_total, a.date_from, a.date_to))
        sinks.write_json_lines(found, a.out)
        print(json.dumps(pipeline.experiment_counts(news, found, a.max_total), ensure_ascii=False))
    elif a.command == "build-experiment-set-from-raw":
        sinks.write_json_lines(pipeline.experiment_set_from_raw(files.read_raw_news(spark, a.raw), files.read_universe(spark, a.universe), (a.language,), a.max_per_stock, a.max_total, a.date_from, a.date_to), a.out)
    elif a.command == "refine-thesis-set":
        print(json.dumps(sinks.write_split(sinks.to_study_file(relevance.study_relevance(lines(a.records))), "study_keep", a.out, a.rejected, "primary_ts_code"), ensure_ascii=False))
    elif a.command == "select-thesis-llm-set":
        sinks.write_json_lines(sinks.to_study_file(selection.best_per_stock(sinks.from_study_file(lines(a.records)), "study_score", a.min_score, a.max_per_stock)), a.out)
    elif a.command == "build-daily-topk-set":
        sinks.write_json_lines(sinks.to_study_file(selection.daily_topk(sinks.from_study_file(lines(a.records)), a.top_k, "study_score", a.date_from, a.date_to, ["raw_source_file", "line_no"])), a.out)
    elif a.command == "run-agent-pipeline":
        found = pipeline.run_pipeline(spark, pipeline.load_news(spark, a.news), files.read_universe(spark, a.universe), files.read_prices(spark, a.prices), a.preset, a.top_k, a.out, {"news_path": a.news, "universe_path": a.universe}, date_from=a.date_from, date_to=a.date_to)
        print(found["report"])
    elif a.command == "rank":
        factors = ranking.factors_from_json(open(a.preset, encoding="utf-8").read()) if a.preset.endswith(".json") else ranking.preset(a.preset)
        sinks.write_csv(ranking.ranking_columns(ranking.rank_stocks(table(a.profiles), factors, a.top_k)), a.out)
    elif a.command == "evaluate":
        ranked = table(a.ranked).withColumns({"ranking_score": F.col("ranking_score").cast("double"), "selected_topk": F.col("selected_topk").cast("int")})
        for name, frame in zip(("panel", "daily", "summary"), pipeline.evaluate(ranked, files.read_prices(spark, a.prices))):
            sinks.write_csv(frame, f"{a.out}/{name}")
    elif a.command == "compare-presets":
        sinks.write_csv(returns.preset_grid(table(a.profiles), files.read_prices(spark, a.prices), a.presets.split(","), [int(k) for k in a.top_k.split(",")]), a.out)
    elif a.command == "validate-factors":
        found = pipeline.validate_factors(table(a.profiles), files.read_prices(spark, a.prices))
        for name, frame in found.items():
            sinks.write_csv(frame, f"{a.out}/{name}")
        report = validation.validation_report(found["time_series"], found["direction"], found["cross_section"])
        sinks.write_text(spark, report, f"{a.out}/report.md")
        print(report)
    elif a.command == "build-quarter-set":
        best, counts = pipeline.quarter_candidates(files.read_raw_news(spark, a.raw, skip_parts=("/en/",)), files.quarter_universe(spark.read.option("header", True).csv(a.universe)), a.date_from, a.date_to, a.language, a.top_k)
        sinks.write_json_lines(sinks.to_study_file(best), a.out)
        sinks.write_summary(spark, counts, f"{a.out}/_summary.json")
        print(json.dumps(counts, ensure_ascii=False))
    elif a.command == "run-batches":
        print(json.dumps(pipeline.run_batches(spark, a.batches, files.read_universe(spark, a.universe), a.out, a.start, int(a.end) if a.end is not None else None, not a.again)))
    elif a.command == "create-batches":
        print(json.dumps(sinks.write_batches(pipeline.load_news(spark, a.news), ["raw_source_file", "line_no"], a.out, a.batch_size)))
    elif a.command == "select-diverse":
        sinks.write_csv(selection.diverse_topk(table(a.mentions), a.top_k), a.out)
    elif a.command == "rebuild-profiles":
        sinks.write_csv(profiles.daily_profiles(table(a.mentions), files.read_universe(spark, a.universe)), a.out)


if __name__ == "__main__":
    main()
