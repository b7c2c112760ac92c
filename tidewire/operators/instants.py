"""Mixed timestamp texts to unambiguous instants through a dictionary of distinct values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tidewire.runtime import fresh_path

DEFAULT_ZONE, DEFAULT_ORDER = "Asia/Shanghai", "YMD"
KEY = ["when_text", "day_text", "zone", "date_order"]

#: Minutes east of Greenwich of a zone abbreviation, by the region of the source's own zone; "" is any other region.
ABBREVIATIONS = {
    "Asia": {"CST": 480, "HKT": 480, "JST": 540, "SGT": 480, "KST": 540, "IST": 330},
    "America": {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420},
    "Australia": {"AEST": 600, "AEDT": 660, "EST": 600, "EDT": 660, "ACST": 570, "ACDT": 630, "CST": 570, "CDT": 630, "AWST": 480, "WST": 480},
    "Europe": {"GMT": 0, "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "IST": 60, "MSK": 180},
    "": {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": 480, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "HKT": 480, "JST": 540, "KST": 540, "SGT": 480, "AEST": 600, "AEDT": 660, "MSK": 180},
}
#: English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_WIDE = str.maketrans({chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"　": " ", " ": " "})
_BLANKS = re.compile(r"[\s​﻿]+")
_DIGITS = re.compile(r"(\d{13})|(\d{10})(?:\.\d+)?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(?:(\d{2})(?:\.\d+)?)?)?(?=$|Z|[ +-])", re.ASCII)
_YEAR_FIRST = re.compile(r"(\d{4})(?:([-/.])(\d{1,2})\2(\d{1,2})|年\s?(\d{1,2})月\s?(\d{1,2})日)(?!\d)", re.ASCII)
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?!\d)", re.ASCII)
_WEEKDAY = re.compile(r"(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:[a-z]*day)?\.?,?\s+", re.I)
_DAY_NAMED = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?[\s-]([A-Za-z]{3,9})\.?,?[\s-](\d{4})(?!\d)", re.ASCII)
_NAMED_DAY = re.compile(r"([A-Za-z]{3,9})\.?\s(\d{1,2})(?:st|nd|rd|th)?,?\s(\d{4})(?!\d)", re.ASCII)
_CLOCK = re.compile(r"(?:(上午|下午|凌晨|早上|中午|晚上)\s?)?(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|[时点](\d{1,2})分(?:(\d{1,2})秒)?)\s?([AaPp])?(?(7)\.?[Mm]\.?)", re.ASCII)
_ZONE = re.compile(r"\s?(?:(Z|z)|(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?|([A-Za-z]{2,5})|\[?([A-Za-z]+(?:/[A-Za-z_+-]+)+)\]?)?(?:\s?[\[(][A-Za-z/_+-]+[\])])?", re.ASCII)


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # an unknown zone gives no instant
        return None


def _tidy(text: str | None) -> str:
    return _BLANKS.sub(" ", (text or "").translate(_WIDE)).strip()


def _month(word: str) -> int | None:
    word = word.lower()
    if word[:3] in MONTHS and (len(word) == 3 or word == "sept" or word in MONTH_NAMES):
        return MONTHS.index(word[:3]) + 1
    return None


def _take_date(text: str, order: str) -> tuple[date, str] | None:
    """A valid calendar day at the start of ``text`` and what follows it."""
    text = _WEEKDAY.sub("", text, count=1) if _WEEKDAY.match(text) else text
    if m := _YEAR_FIRST.match(text):
        y, mo, d = int(m[1]), int(m[3] or m[5]), int(m[4] or m[6])
    elif m := _YEAR_LAST.match(text):
        if order not in ("DMY", "MDY"):
            return None
        a, b, y = int(m[1]), int(m[3]), int(m[4])
        d, mo = (a, b) if order == "DMY" else (b, a)
    elif (m := _DAY_NAMED.match(text)) and (named := _month(m[2])):
        y, mo, d = int(m[3]), named, int(m[1])
    elif (m := _NAMED_DAY.match(text)) and (named := _month(m[1])):
        y, mo, d = int(m[3]), named, int(m[2])
    else:
        return None
    try:
        return date(y, mo, d), text[m.end() :]
    except ValueError:
        return None


def _take_clock(text: str) -> tuple[int, str] | None:
    """Seconds of the day at the start of ``text`` and what follows."""
    if not (m := _CLOCK.match(text)):
        return None
    h, mi, s = int(m[2]), int(m[3] or m[5] or 0), int(m[4] or m[6] or 0)
    half = {"上午": "a", "凌晨": "a", "早上": "a", "下午": "p", "晚上": "p", "中午": "p"}.get(m[1] or "", (m[7] or "").lower())
    if half:
        if not (1 <= h <= 12 or h == 0):
            return None
        h = h % 12 + 12 * (half == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    return h * 3600 + mi * 60 + s, text[m.end() :]


def _resolve(day: date, seconds: int, zone: str) -> int | None:
    tz = _zone(zone)
    if tz is None:
        return None
    wall = datetime(day.year, day.month, day.day, tzinfo=tz) + timedelta(seconds=seconds)
    return int(wall.replace(tzinfo=timezone.utc).timestamp()) - int(wall.utcoffset().total_seconds())  # fold 0: the first of two, and past a gap by its length


def _with_zone(day: date, seconds: int, rest: str, zone: str) -> int | None:
    m = _ZONE.fullmatch(rest)
    if not m:
        return None
    utc = (day - date(1970, 1, 1)).days * 86400 + seconds
    if m[1]:
        return utc
    if m[2]:
        hours, minutes = int(m[3]), int(m[4] or 0)
        if hours > 18 or minutes > 59:
            return None
        return utc - (1 if m[2] == "+" else -1) * (hours * 3600 + minutes * 60)
    if m[5]:
        name = m[5].upper()
        minutes = ABBREVIATIONS.get(zone.split("/")[0], {}).get(name, ABBREVIATIONS[""].get(name))
        return None if minutes is None else utc - minutes * 60
    return _resolve(day, seconds, m[6] or zone)


def parse_instant(when: str | None, day: str | None, zone: str, order: str) -> int | None:
    """Whole seconds since 1970 UTC of one text, or None where the instant can't be told.

    ``when`` null, blank or a mere time of day takes its day from ``day``; any other text that isn't a
    valid absolute date or time has no instant. Repeated wall times mean the first, skipped ones move on
    by the gap.
    """
    text = _tidy(when)
    clock = 0
    if text:
        if m := _DIGITS.fullmatch(text):
            return int(m[1]) // 1000 if m[1] else int(m[2])
        only_clock = _take_clock(text)
        if only_clock is None or only_clock[1].strip() and _ZONE.fullmatch(only_clock[1]) is None:
            return _absolute(text, zone, order)
        found = _absolute(text, zone, order)
        if found is not None:
            return found
        clock, rest = only_clock
    else:
        rest = ""
    on = _tidy(day)
    if m := _COMPACT.fullmatch(on):
        on = f"{m[1]}-{m[2]}-{m[3]}" if m[4] is None else on
    got = _take_date(on, order)
    if got is None or got[1].strip():
        return None
    return _with_zone(got[0], clock, rest, zone)


def _absolute(text: str, zone: str, order: str) -> int | None:
    if m := _COMPACT.match(text):
        try:
            day = date(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return None
        h, mi, s = (int(x or 0) for x in m.group(4, 5, 6))
        if h > 23 or mi > 59 or s > 59:
            return None
        return _with_zone(day, h * 3600 + mi * 60 + s, text[m.end() :], zone)
    got = _take_date(text, order)
    if got is None:
        return None
    day, rest = got
    if not rest:
        return _with_zone(day, 0, "", zone)
    clock = _take_clock(rest.lstrip("T ,") if rest[0] in "T, " else rest)
    if clock is None:
        return None if rest.strip() else _with_zone(day, 0, "", zone)
    return _with_zone(day, *clock, zone)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in KEY]
        found = pa.array([parse_instant(*row) for row in zip(*columns)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in KEY), found], names=[*KEY, "utc_second"])


def extend_dictionary(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """The dictionary at ``path`` with every key of ``keys`` in it.

    Only keys that it lacks are parsed; they are appended as one committed write, so a job that is
    repeated after a failure parses nothing twice. Keys are unique when one writer at a time appends.
    """
    schema = "when_text string, day_text string, zone string, date_order string, utc_second long"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        known = spark.read.schema(schema).parquet(path)
        same = [keys[c].eqNullSafe(known[c]) for c in KEY]
        keys = keys.join(known, on=same, how="left_anti")
    keys.mapInArrow(_parse_batches, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def normalise_instants(records: DataFrame, sources: DataFrame, when: str = "publish_time", day: str = "publish_date", source: str = "source", dictionary_path: str | None = None) -> DataFrame:
    """``records`` with ``utc_second`` (long, null where the instant can't be told).

    Distinct (text, day, zone, order) keys form a dictionary that is parsed once and persisted at
    ``dictionary_path`` (a fresh table in the shared folder where none is given); later calls with the same
    path parse only what is new. ``sources`` holds ``source, tz, date_order`` (a small dimension, one row a source;
    repeated rows are taken once); null or unlisted sources count as Asia/Shanghai and YMD. Absolute texts leave the day out
    of their key. Nulls and blanks in both texts give null. Columns of the input keep their names and values;
    an input column named ``utc_second`` is replaced.
    """
    spark = records.sparkSession
    zones = sources.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("_src")).agg(F.min("tz").alias("_tz"), F.min("date_order").alias("_ord"))
    blank = r"^[\s\p{Z}\x{200b}\x{feff}]*$"
    raw = F.when(F.col(when).rlike(blank), F.lit(None)).otherwise(F.col(when))
    # a mere time of day has at most 16 characters and no date before it; anything else needs no day of its own
    needs_day = F.col("when_text").isNull() | F.col("when_text").rlike(r"^[\s\p{Z}\x{200b}\x{feff}]*(\p{IsHan}{2})?\s?[0-9０-９]{1,2}[:：时点]")
    keyed = (
        records.drop("utc_second")
        .join(zones, records[source] == zones["_src"], "left")
        .withColumn("when_text", raw)
        .withColumn("zone", F.coalesce("_tz", F.lit(DEFAULT_ZONE)))
        .withColumn("date_order", F.coalesce(F.upper("_ord"), F.lit(DEFAULT_ORDER)))
        .withColumn("day_text", F.when(needs_day, F.coalesce(F.when(F.col(day).rlike(blank), F.lit("")).otherwise(F.col(day)), F.lit(""))).otherwise(F.lit("")))
        .withColumn("when_text", F.coalesce("when_text", F.lit("")))
        .drop("_src", "_tz", "_ord")
    )
    has_case = (F.col("when_text") != "") | (F.col("day_text") != "")
    # rows without a case have no key in common: a key of their own spreads them over the join's tasks
    plain = [f.name for f in records.schema.fields if isinstance(f.dataType, AtomicType) and f.name != "utc_second"]
    keyed = keyed.withColumn("_spread", F.when(has_case, 0).otherwise(F.pmod(F.xxhash64(*plain), F.lit(65_536)).cast("int")))
    dictionary = extend_dictionary(spark, keyed.where(has_case).select(*KEY).distinct(), dictionary_path or fresh_path(spark, "instants"))
    return keyed.join(dictionary.withColumn("_spread", F.lit(0)), on=[*KEY, "_spread"], how="left").select(*[c for c in records.columns if c != "utc_second"], "utc_second")
