"""Raw records to one normalised, deduplicated news table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import strip, text
from tidewire.operators import drift, instants

LOCAL_ZONE = "Asia/Shanghai"


def surrogate_id(file: str, ordinal: str, title: str, time: str):
    """Sixteen hexadecimal digits of an MD5 over file, place in it, title and raw time."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(file, F.lit("")), F.col(ordinal).cast("string"), F.coalesce(title, F.lit("")), F.coalesce(time, F.lit("")))), 1, 16)


def keep_languages(news: DataFrame, languages: list[str] | None, column: str = "language") -> DataFrame:
    """Rows of the languages; an empty or null language is never dropped."""
    if not languages:
        return news
    given = F.lower(text(column))
    return news.where((given == "") | given.isin([x.lower() for x in languages]))


def drop_empty(news: DataFrame) -> DataFrame:
    return news.where((text("title") != "") | (text("body") != ""))


def key_hash(columns: list[str]) -> Column:
    """128 bits of several columns; null differs from every text."""
    return F.struct(F.xxhash64(*[F.col(c).isNull() for c in columns], *columns).alias("a"), F.xxhash64(F.lit(1), *columns, *[F.col(c).isNull() for c in columns]).alias("b"))


def first_of(news: DataFrame, keys: list[str], order: list[str], skip_empty: bool = False) -> DataFrame:
    """The first row of each key in ``order`` (nulls are one key); with ``skip_empty`` rows with an empty first key all stay.

    Keys are taken as a hash of 128 bits, so that texts are neither sorted nor compared. The smallest ``order`` of a key is found by partial aggregation before
    the shuffle, and rows are joined to it by hash and order, so that a key with a third of all rows is never brought together; ``order`` must be unique in a key, or all its first rows stay.
    """
    if not skip_empty:
        hashed = news.withColumn("_h", key_hash(keys))
        first = hashed.groupBy("_h").agg(F.min(F.struct(*order)).alias("_o")).select(F.col("_h").alias("_fh"), F.col("_o").alias("_fo"))
        kept = (F.col("_h") == F.col("_fh")) & F.struct(*order).eqNullSafe(F.col("_fo"))
        return hashed.join(first, kept, "left_semi").drop("_h")
    one = Window.partitionBy(*keys).orderBy(*order)
    # rows without a key are not brought together: they take no part in the window
    named = F.coalesce(F.col(keys[0]), F.lit("")) != ""
    return news.where(named).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").unionByName(news.where(~named))


def dedup_in_file(news: DataFrame, order: list[str]) -> DataFrame:
    """First by id, then, of what is left, first by title, body and time."""
    return first_of(first_of(news, ["id"], order), ["title", "body", "publish_time"], order)


def dedup_across_files(news: DataFrame, order: list[str]) -> DataFrame:
    return first_of(news, ["id", "title", "body", "publish_time"], order)


def local_times(news: DataFrame, sources: DataFrame | None = None, zone: str = LOCAL_ZONE) -> DataFrame:
    """``publish_time`` as ``yyyy-MM-dd HH:mm:ss`` in ``zone`` and ``publish_date``; an unusable time stays as it was, with an empty date."""
    spark = news.sparkSession
    sources = spark.createDataFrame([], "source string, tz string, date_order string") if sources is None else sources
    given = news.withColumn("_day", F.col("publish_date") if "publish_date" in news.columns else F.lit(None).cast("string"))
    timed = instants.normalise_instants(given, sources, "publish_time", "_day", "source")
    # wall time without a zone: the session's zone plays no part
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, utc_second)"))
    shown, known = local.cast("string"), F.col("utc_second").isNotNull()
    return (
        timed.withColumn("publish_time", F.when(known, F.substring(shown, 1, 19)).otherwise(F.coalesce("publish_time", F.lit(""))))
        .withColumn("publish_date", F.when(known, F.substring(shown, 1, 10)).otherwise(F.lit("")))
        .drop("_day", "utc_second")
    )


def normalise_news(raw: DataFrame, languages: list[str] | None = None, sources: DataFrame | None = None, dedup: bool = True) -> DataFrame:
    """The nine text columns of the news table from raw JSON lines (``payload, raw_source_file, line_no``).

    Fields come from the alias table; rows of other languages, or with neither title nor body, are dropped; a missing id is made from
    file, line, title and time; times are parsed row by row. Within a file the first row of an id, then of a text and time, stays.
    """
    rows = drift.unified_news(raw, keep=("raw_source_file", "line_no"))
    rows = rows.withColumn("language", F.lower(text("language")))
    rows = drop_empty(keep_languages(rows, languages))
    for c in ("id", "title", "body", "publish_time", "source", "url"):
        rows = rows.withColumn(c, text(c))
    rows = rows.withColumn("id", F.when(F.col("id") != "", F.col("id")).otherwise(surrogate_id("raw_source_file", "line_no", "title", "publish_time")))
    rows = local_times(rows, sources)
    if dedup:
        rows = first_of(first_of(rows, ["raw_source_file", "id"], ["line_no"]), ["raw_source_file", "title", "body", "publish_time"], ["line_no"])
    return rows.select("id", "title", "body", "publish_time", "publish_date", "source", "url", "language", "raw_source_file", "line_no")


def normalise_raw_record(raw: DataFrame) -> DataFrame:
    """Without surrogate ids and time parsing: the date is the first ten characters of the raw time."""
    rows = drift.unified_news(raw, keep=("raw_source_file", "line_no"))
    picked = [text(c).alias(c) for c in ("id", "title", "body", "publish_time", "source", "url")]
    return rows.select(*picked, F.substring(text("publish_time"), 1, 10).alias("publish_date"), F.lower(text("language")).alias("language"), "raw_source_file", "line_no")


def union_repaired(frames: list[DataFrame], numeric: list[str]) -> DataFrame:
    """UNION ALL of batches whose columns differ: missing ones are empty, unusable numbers are 0."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[F.coalesce(strip(c).try_cast("double"), F.lit(0.0)).alias(c) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
