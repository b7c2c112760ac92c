"""Writers: JSON lines, kept and rejected rows, CSV sets, batches, summaries and reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_split(decided: DataFrame, keep: str, kept_path: str, rejected_path: str | None = None, by: str | None = None, total: int | None = None) -> dict[str, Any]:
    """Rows by a boolean column into two outputs, and their counts (by a key, too). ``total`` counts what was read, unusable lines included, which then are rejected ones."""
    from tidewire.runtime import cut

    decided = cut(decided)
    write_json_lines(decided.where(F.col(keep)).drop(keep), kept_path)
    if rejected_path:
        write_json_lines(decided.where(~F.coalesce(F.col(keep), F.lit(False))).drop(keep), rejected_path)
    n = decided.agg(F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept")).first()
    total = n["total"] if total is None else total
    out = {"total": total, "kept": n["kept"], "rejected": total - n["kept"]}
    if by:
        out["counts_by_stock"] = {r[0]: r[1] for r in decided.where(F.col(keep)).groupBy(by).count().orderBy(by).collect()}
    return out


def write_baseline(mentions: DataFrame, profiles: DataFrame, skipped: DataFrame, prefix: str) -> None:
    for name, frame in (("article_mentions", mentions), ("daily_profiles", profiles), ("skipped_news", skipped)):
        write_csv(frame, f"{prefix}_{name}")


def write_batches(rows: DataFrame, order: list[str], path: str, size: int = 300) -> list[dict[str, Any]]:
    """Rows in batches of ``size`` as partitions ``batch_index=n``, and the manifest.

    Numbered without one task for all rows: range partitions are counted first, then every partition numbers its own.
    """
    from tidewire.runtime import cut

    placed = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_p").withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before") - 1)
    batched = numbered.withColumn("batch_index", F.floor(F.col("_n") / size).cast("int")).drop("_p", "_n", "_before")
    batched.write.mode("overwrite").partitionBy("batch_index").json(path)
    return [{"batch_index": r[0], "path": f"{path}/batch_index={r[0]}", "record_count": r[1]} for r in batched.groupBy("batch_index").count().orderBy("batch_index").collect()]


def percent(x: Any) -> str:
    try:
        return "NA" if x is None or x == "" else f"{float(x) * 100:.4f}%"
    except (TypeError, ValueError):
        return "NA"


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """A small text at any path that the session's file systems know."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def write_summary(spark: SparkSession, summary: dict[str, Any], path: str) -> None:
    write_text(spark, json.dumps(summary, ensure_ascii=False, indent=2, default=str), path)


#: The columns of study files as other tools write and read them.
STUDY_COLUMNS = {
    "study_score": "thesis_relevance_score", "study_finance_hits": "thesis_finance_hits", "study_stock_hits": "thesis_stock_hits",
    "study_negative_hits": "thesis_negative_hits", "study_has_full_name": "thesis_has_full_name", "study_alias_only": "thesis_alias_only",
}


def to_study_file(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed(STUDY_COLUMNS)


def from_study_file(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({theirs: ours for ours, theirs in STUDY_COLUMNS.items()})


#: Fixed value: the heading by which a run report is known.
REPORT_TITLE = "第四章 Agent 系统运行报告"


def _markdown_table(head: list[str], rows: list[list[Any]]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def run_report(summary: dict[str, Any]) -> str:
    """One run as Markdown tables: what the selections earned, whom they picked first, how the steps went and what they were given."""
    ranked, k = summary.get("ranking_summary", {}), summary.get("top_k") or ""
    earned = summary.get("performance_summary", {}).get("horizons", {})
    by_horizon = [[f"future {h}D", percent(earned[h].get("avg_excess_return")), percent(earned[h].get("hit_rate_vs_universe"))] for h in sorted(earned, key=int)]
    first_days = [[d["publish_date"], "、".join(x.get("stock_name") or x.get("ts_code", "") for x in d.get("selected_stocks", []))] for d in ranked.get("topk_by_date", [])[:3]]
    given = [[key, summary[key]] for key in ("ranking_preset", "top_k", "news_path", "universe_path") if summary.get(key) not in (None, "")]
    sections = {
        f"收益（top{k}）": _markdown_table(["期限", "相对全体的平均收益差", "跑赢全体的日期占比"], by_horizon) if by_horizon else "没有可评价的日期。",
        "最初几日的入选": _markdown_table(["日期", f"top{k}"], first_days) if first_days else "没有入选。",
        "规模": f"共 {ranked.get('date_count', 0)} 日、{ranked.get('stock_count', 0)} 只股票，平均每日 {ranked.get('avg_cross_section_size', 0)} 只。",
        "步骤": _markdown_table(["步骤", "状态", "说明"], [[x["agent_name"], x["status"], x["message"]] for x in summary.get("steps", [])]),
        "参数": _markdown_table(["名称", "值"], given),
    }
    return "\n\n".join([f"# {REPORT_TITLE}", *(f"## {n}. {name}\n\n{body}" for n, (name, body) in enumerate(sections.items(), 1))]) + "\n"
