"""Raw news as a stream: new files are normalised as they arrive, and counts come by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators import ingest


def raw_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Lines of JSON-lines files below ``folder`` that weren't read before: ``payload, raw_source_file, line_no``.

    A line's number is its place by content hash, since a stream has no row numbers; it only makes missing ids.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").text(folder)
    return lines.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("raw_source_file"), F.pmod(F.xxhash64("value"), F.lit(2_147_483_647)).cast("int").alias("line_no"))


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, languages: list[str] | None = None, files_at_once: int = 1000) -> StreamingQuery:
    """Normalised news under ``out/batch_index=n`` until no new file is left.

    A batch overwrites its own folder, so one that is repeated after a failure leaves the same rows. Profiles are to be built from all
    batches together.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest.normalise_news(batch, languages).write.mode("overwrite").parquet(f"{out}/batch_index={number}")

    return raw_stream(spark, folder, files_at_once).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mention_counts(mentions: DataFrame, time: str = "publish_time", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Mentions and mean sentiment of each stock by window of event time; rows later than ``late`` are left out of closed windows. For batches and streams."""
    timed = mentions.withColumn("_t", F.col(time).try_cast("timestamp")).where("_t is not null")
    return timed.withWatermark("_t", late).groupBy(F.window("_t", width), "ts_code").agg(F.count(F.lit(1)).alias("mentions"), F.avg("sentiment").alias("sentiment")).select(F.col("window.start").alias("from_time"), "ts_code", "mentions", "sentiment")
