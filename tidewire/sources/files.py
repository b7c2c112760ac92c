"""Readers for news, stock universes and prices; every value is read as text and typed later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import split_aliases, squeeze, text

SUFFIXES = (".csv", ".json", ".jsonl", ".parquet")
#: Names of a universe's columns.
UNIVERSE_NAMES = {"ts_code": ["ts_code", "code", "stock_code", "symbol"], "name": ["name", "stock_name", "short_name", "sec_name"], "industry": ["industry", "sector"], "aliases": ["aliases", "alias", "keywords"]}
#: Keys under which a JSON document may hold its list of records.
LIST_KEYS = ["data", "records", "items", "articles", "news"]


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Files of the known kinds below ``path`` (or ``path`` itself), in name order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isFile():
        return [path]
    found, walk = [], fs.listFiles(at, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.lower().endswith(suffixes):
            found.append(name)
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def list_folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Folders right below ``path`` whose names start with ``prefix``, in name order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName().startswith(prefix))


def _payload(frame: DataFrame) -> DataFrame:
    """Rows of a typed table as JSON objects, with their file and number in it."""
    numbered = frame.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("payload"), F.col("_metadata.file_path").alias("raw_source_file"), F.monotonically_increasing_id().alias("_at"))
    return numbered.select("payload", "raw_source_file", F.row_number().over(Window.partitionBy("raw_source_file").orderBy("_at")).alias("line_no"))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.text(paths).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("raw_source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return rows.select("payload", "raw_source_file", F.row_number().over(Window.partitionBy("raw_source_file").orderBy("_block", "_at")).alias("line_no"))


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole JSON documents: a list, or an object with a list under one of LIST_KEYS, or one object."""
    docs = spark.read.text(paths, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("raw_source_file"))
    as_list = [F.try_variant_get("v", "$", "array<variant>")] + [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in LIST_KEYS]
    records = F.coalesce(*as_list, F.array("v"))
    rows = docs.where("v is not null").select("raw_source_file", F.posexplode(records).alias("n", "record"))
    return rows.select(F.to_json("record").alias("payload"), "raw_source_file", (F.col("n") + 1).alias("line_no")).where(F.col("payload").startswith("{"))


def read_raw_news(spark: SparkSession, path: str, skip_parts: tuple[str, ...] = ()) -> DataFrame:
    """``payload, raw_source_file, line_no`` of all news files below ``path``: CSV, JSON, JSON lines and parquet.

    JSON lines are kept as they are, malformed ones too; operators skip what is no object. Files whose path contains one
    of ``skip_parts`` are left out. CSV values stay text, so ids keep their zeros.
    """
    files = [f for f in list_files(spark, path) if not any(p in f for p in skip_parts)]
    kinds = {s: [f for f in files if f.lower().endswith(s)] for s in SUFFIXES}
    frames = []
    if kinds[".jsonl"]:
        frames.append(_lines(spark, kinds[".jsonl"]))
    if kinds[".json"]:
        frames.append(_documents(spark, kinds[".json"]))
    for f in kinds[".csv"]:
        frames.append(_payload(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f)))
    for f in kinds[".parquet"]:
        frames.append(_payload(spark.read.parquet(f)))
    if not frames:
        return spark.createDataFrame([], "payload string, raw_source_file string, line_no int")
    return reduce(DataFrame.unionByName, [x.select("payload", "raw_source_file", F.col("line_no").cast("int").alias("line_no")) for x in frames])


def only_objects(raw: DataFrame) -> DataFrame:
    """The strict way to read JSON lines: a line that is no object is an error as soon as it is read. Blank lines are left out."""
    parsed = F.try_parse_json("payload")
    good = parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    message = F.concat(F.lit("no JSON object: "), F.coalesce("raw_source_file", F.lit("")), F.lit(" line "), F.col("line_no").cast("string"))
    return raw.where(F.trim("payload") != "").withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(message).cast("string")))


def universe(frame: DataFrame, separators: str | None = None) -> DataFrame:
    """``ts_code, name, industry, aliases`` (an array) from a table with one of the known names for each.

    Rows without code or name are dropped; a missing industry is empty; the name is always an alias. With ``separators``
    another split pattern holds.
    """
    lower = {c.lower(): c for c in frame.columns}
    names = {k: next((lower[n] for n in known if n in lower), None) for k, known in UNIVERSE_NAMES.items()}
    if names["ts_code"] is None or names["name"] is None:
        raise ValueError("a stock universe needs ts_code and name")
    pick = lambda k: text(F.col(names[k]).cast("string")) if names[k] else F.lit("")
    rows = frame.select(pick("ts_code").alias("ts_code"), pick("name").alias("name"), pick("industry").alias("industry"), pick("aliases").alias("_raw")).where("ts_code <> '' and name <> ''")
    aliases = split_aliases("_raw", "name") if separators is None else F.array_distinct(F.filter(F.concat(F.transform(F.split("_raw", separators), text), F.array("name")), lambda a: a != ""))
    return rows.select("ts_code", "name", "industry", aliases.alias("aliases"))


def quarter_universe(frame: DataFrame) -> DataFrame:
    """The universe of the quarter builder: aliases split at bars, unique by their squeezed form of two characters or more."""
    rows = universe(frame, r"\|")
    squeezed = F.transform("aliases", lambda a: F.struct(squeeze(a).alias("s"), a.alias("a")))
    kept = F.aggregate(F.filter(squeezed, lambda x: F.length(x["s"]) >= 2), F.array().cast("array<struct<s:string,a:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["s"] == x["s"]), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.withColumn("aliases", F.transform(kept, lambda x: x["a"]))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return universe(spark.read.option("header", True).csv(path))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily quotes with typed columns; unusable values become null."""
    frame = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    numbers = [c for c in frame.columns if c not in ("trade_date", "ts_code", "stock_name")]
    return frame.select(F.expr("try_cast(trade_date as date)").alias("trade_date"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in numbers], *[c for c in ("ts_code", "stock_name") if c in frame.columns])


def uncovered(prices: DataFrame, codes: DataFrame) -> DataFrame:
    """The codes that a price table lacks."""
    return codes.select("ts_code").distinct().join(prices.select("ts_code").distinct(), "ts_code", "left_anti")


def covers(prices: DataFrame, codes: DataFrame) -> bool:
    """Whether a price table has every code."""
    return uncovered(prices, codes).isEmpty()


def quote_id(code: Column) -> Column:
    """The quote service's name of a code: 1 for Shanghai, else 0."""
    parts = F.split(code, r"\.")
    return F.concat(F.when(parts[1] == "SH", "1.").otherwise("0."), parts[0])
