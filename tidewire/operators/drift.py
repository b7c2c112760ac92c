"""Layouts that drift from file to file: one consistent table, and a log of every change."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import cut

#: Names under which feeds send the fields of a news record (lower case, without a wrapping object's name).
ALIASES = {
    "id": ["id", "news_id", "article_id", "doc_id", "docid", "_id", "uuid", "uid", "nid", "guid", "item_id", "story_id", "record_id"],
    "title": ["title", "headline", "news_title", "subject_line", "subject", "article_title", "heading"],
    "body": ["body", "content", "text", "news_content", "full_text", "main_copy", "description", "article_text", "article_body", "body_text", "main_text"],
    "publish_time": ["publish_time", "published_at", "publish_date", "datetime", "date", "created_at", "time", "pub_time", "pub_date", "publish_ts", "published", "release_time", "timestamp"],
    "source": ["source", "media", "publisher", "site_name", "site", "provider", "source_name", "outlet"],
    "url": ["url", "link", "article_url", "href", "permalink", "web_url"],
    "language": ["language", "lang_code", "lang", "locale"],
}
#: Objects that merely wrap a record.
WRAPPERS = ["article", "data", "meta", "news", "item", "payload", "record"]
CANONICAL = {f"{w}.{a}" if w else a: c for c, names in ALIASES.items() for a in names for w in ["", *WRAPPERS]}
#: Types of a field, in the order that decides a tie.
KINDS = ["string", "number", "boolean", "array"]
FOOTER = "feed string, file_no int, field string, objects long, held long, n_string long, n_number long, n_boolean long, n_array long"
HELD_SHARE = 10  # a file has a field that at least a tenth of its objects hold
_FLUSH = 200_000


def parse_object(payload: str | None) -> dict | None:
    """The JSON object in one raw line; None for blank, cut-off and non-object lines."""
    try:
        found = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def flatten(found: dict[str, Any]) -> Iterator[tuple[str, Any]]:
    """Dotted paths and their non-null leaves; objects are paths, not fields."""
    todo = [("", found)]
    while todo:
        prefix, node = todo.pop()
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                todo.append((path, value))
            elif value is not None:
                yield path, value


def _kind(value: Any) -> int:
    return 2 if isinstance(value, bool) else 1 if isinstance(value, (int, float)) else 0 if isinstance(value, str) else 3


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields: dict[tuple, list[int]] = {}
    objects: dict[tuple, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(feed, no, path, 0, sum(n), *n) for (feed, no, path), n in fields.items()] + [(feed, no, None, n, 0, 0, 0, 0, 0) for (feed, no), n in objects.items()]
        fields.clear(), objects.clear()
        if rows:
            types = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["feed", "file_no", "field", "objects", "held", *(f"n_{k}" for k in KINDS)])

    for b in batches:
        for feed, no, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
            if feed is None or no is None:
                continue
            found = parse_object(payload)
            objects[feed, no] = objects.get((feed, no), 0) + (found is not None)
            for path, value in flatten(found or {}):
                n = fields.setdefault((feed, no, path), [0, 0, 0, 0])
                n[_kind(value)] += 1
        if len(fields) > _FLUSH:
            yield from flush()
    yield from flush()


def file_footers(raw: DataFrame, feed: str = "feed", file_no: str = "file_no", payload: str = "payload") -> DataFrame:
    """What each file holds: a row for each field (objects that hold it, and values by type) and one with null field for the number of objects.

    Counted per input partition before the shuffle, so a feed with a third of all rows moves no more rows than any other.
    """
    rows = raw.select(F.col(feed).alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(payload).alias("payload"))
    counts = ["objects", "held", *(f"n_{k}" for k in KINDS)]
    # a few rows a file, read several times: computed once
    return cut(rows.mapInArrow(_footers, FOOTER).groupBy("feed", "file_no", "field").agg(*[F.sum(c).alias(c) for c in counts]))


def field_lifespans(footers: DataFrame) -> DataFrame:
    """The catalogue: for each feed, field and type the islands of files that have it (``first_seq`` to ``last_seq``, counted within the feed)."""
    files = footers.where("field is null").select("feed", "file_no", F.col("objects").alias("in_file"))
    order = Window.partitionBy("feed").orderBy("file_no")
    files = files.select("feed", "file_no", "in_file", F.row_number().over(order).alias("seq"))
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS])
    kind = F.coalesce(*[F.when(F.col(f"n_{k}") == most, F.lit(k)) for k in KINDS])
    held = footers.where("field is not null").join(files, ["feed", "file_no"]).where(F.col("held") * HELD_SHARE >= F.col("in_file")).select("feed", "field", kind.alias("kind"), "seq", "file_no")
    by_kind = Window.partitionBy("feed", "field").orderBy("seq")
    starts = held.withColumn("new", F.coalesce(((F.col("seq") != F.lag("seq").over(by_kind) + 1) | (F.col("kind") != F.lag("kind").over(by_kind))), F.lit(True)))
    islands = starts.withColumn("island", F.sum(F.col("new").cast("int")).over(by_kind))
    return islands.groupBy("feed", "field", "island").agg(F.first("kind").alias("kind"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"))


def layout_changes(footers: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """``feed, file_no, change, old_field, new_field``: every change of a file against the one before it in its feed.

    A field that ends and one that starts in the same file are ``renamed`` when the alias table gives both
    the same canonical name (several such pairs in alphabetical order); other starts are ``added``, other
    ends ``removed``, and islands of one field that touch with another type are ``retyped``. The first file
    of a feed changes nothing; a file without objects has no field. Empty input gives an empty result.
    """
    canonical = CANONICAL if canonical is None else canonical
    spark = footers.sparkSession
    order = Window.partitionBy("feed").orderBy("file_no")
    files = footers.where("field is null").select("feed", "file_no", F.row_number().over(order).alias("at"))
    spans = field_lifespans(footers)
    touching = Window.partitionBy("feed", "field").orderBy("first_seq")
    spans = spans.withColumn("touches_last", F.coalesce(F.lag("last_seq").over(touching) + 1 == F.col("first_seq"), F.lit(False))).withColumn("touches_next", F.coalesce(F.lead("first_seq").over(touching) - 1 == F.col("last_seq"), F.lit(False)))
    events = spans.select("feed", "field", F.explode(F.array(
        F.struct(F.when(F.col("touches_last"), "retyped").otherwise("start").alias("what"), F.col("first_seq").alias("at")),
        F.struct(F.when(~F.col("touches_next"), "end").alias("what"), (F.col("last_seq") + 1).alias("at")),
    )).alias("e")).select("feed", "field", "e.*").where("what is not null and at > 1")
    table = spark.createDataFrame(sorted(canonical.items()), "alias string, meaning string")
    named = events.join(F.broadcast(table), F.lower("field") == F.col("alias"), "left").withColumn("meaning", F.coalesce("meaning", F.concat(F.lit("="), "field")))
    nth = Window.partitionBy("feed", "at", "meaning", "what").orderBy("field")
    paired = (
        named.withColumn("side", F.when(F.col("what") == "retyped", "retyped").otherwise("moved")).withColumn("nth", F.row_number().over(nth))
        .groupBy("feed", "at", "meaning", "side", "nth")
        .agg(F.max(F.when(F.col("what") != "start", F.col("field"))).alias("old_field"), F.max(F.when(F.col("what") != "end", F.col("field"))).alias("new_field"))
    )
    change = F.when(F.col("side") == "retyped", "retyped").when(F.col("old_field").isNull(), "added").when(F.col("new_field").isNull(), "removed").otherwise("renamed")
    return paired.join(files, ["feed", "at"]).select("feed", "file_no", change.alias("change"), F.coalesce("old_field", F.lit("")).alias("old_field"), F.coalesce("new_field", F.lit("")).alias("new_field"))


def _text(value: Any) -> str:
    if isinstance(value, list):
        return " ".join(x for x in (_text(v) for v in value) if x)
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else json.dumps(value, ensure_ascii=False)


def _extra(value: Any) -> str:
    """As :func:`_text`, but a list stays JSON, so that a cast can take it apart."""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, list) else _text(value)


_RANK = {name: (c, i) for c, names in ALIASES.items() for i, name in enumerate([*names, *(f"{w}.{a}" for w in WRAPPERS for a in names)])}
TABLE = ", ".join(f"{c} string" for c in ALIASES) + ", extras map<string,string>"


def _canonical_rows(batches: Iterator[pa.RecordBatch], passed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in [*ALIASES, "extras"]}
        kept = []
        for i, payload in enumerate(b.column(b.num_columns - 1).to_pylist()):
            found = parse_object(payload)
            if found is None:
                continue
            kept.append(i)
            best: dict[str, tuple[int, str]] = {}
            extras = {}
            for path, value in flatten(found):
                ranked = _RANK.get(path.lower())
                if ranked is None:
                    extras[path] = _extra(value)
                elif (text := _text(value)) and ranked[1] < best.get(ranked[0], (1 << 30, ""))[0]:
                    best[ranked[0]] = (ranked[1], text)
            for c in ALIASES:
                out[c].append(best[c][1] if c in best else None)
            out["extras"].append(list(extras.items()))
        columns = [b.column(i).take(pa.array(kept, pa.int64())) for i in range(passed)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[c], pa.string()) for c in ALIASES), pa.array(out["extras"], pa.map_(pa.string(), pa.string()))], names=[*(b.schema.names[:passed]), *ALIASES, "extras"])


def unified_news(raw: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("record_no", "feed", "file_no", "line_no")) -> DataFrame:
    """All payloads that are objects as one table: ``keep``, the canonical news fields as text, and the other fields in ``extras``.

    A canonical field takes the first of its aliases with content; lists are joined with blanks, numbers and
    booleans become text, so a field that changes type keeps one type here. In ``extras`` lists stay JSON (see :func:`typed_news` for columns of their own types). Lines that are no object are left out;
    a missing, null or empty field is null.
    """
    fields = [f for c in keep for f in raw.schema.fields if f.name == c]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), TABLE])
    n = len(fields)
    return raw.select(*[f.name for f in fields], payload).mapInArrow(lambda it: _canonical_rows(it, n), schema)


def cast_plan(footers: DataFrame) -> DataFrame:
    """``field, target``: the type that each catalogued field outside the alias table is cast to, that of most of its values over all files (canonical fields are text).

    A field is catalogued if a file of some feed has it by HELD_SHARE; lone misfits are not.
    """
    canonical = footers.sparkSession.createDataFrame([(a,) for a in sorted(CANONICAL)], "alias string")
    own = footers.where("field is not null").join(F.broadcast(canonical), F.lower("field") == F.col("alias"), "left_anti")
    files = footers.where("field is null").select("feed", "file_no", F.col("objects").alias("in_file"))
    kept = own.join(files, ["feed", "file_no"]).where(F.col("held") * HELD_SHARE >= F.col("in_file")).select("field").distinct()
    totals = own.join(kept, "field", "left_semi").groupBy("field").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS])
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS])
    return totals.select("field", F.coalesce(*[F.when(F.col(f"n_{k}") == most, F.lit(k)) for k in KINDS]).alias("target"))


def _cast(text: Column, target: str) -> Column:
    """The generated cast of a raw text; null where it fails."""
    if target == "number":
        return text.try_cast("double")
    if target == "boolean":
        return text.try_cast("boolean")
    if target == "array":
        return F.when(text.isNotNull(), F.coalesce(F.from_json(text, "array<string>"), F.array(text)))
    return text


def typed_news(raw: DataFrame, footers: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("record_no", "feed", "file_no", "line_no")) -> DataFrame:
    """:func:`unified_news` with a typed column ``x_<field>`` for every field of :func:`cast_plan` (number: double, array: array<string>).

    What no cast takes stays in ``extras`` as it was sent: values whose cast fails, and fields outside the catalogue. The plan is a row a field, and as such bounded by a table's width.
    """
    plan = sorted((r.field, r.target) for r in cast_plan(footers).collect())
    rows = unified_news(raw, payload, keep)
    columns: dict[str, tuple[str, Column]] = {}
    for field, target in plan:
        name = "x_" + field.replace(".", "_")
        while name.lower() in {c.lower() for c in columns}:
            name += "_"
        columns[name] = field, _cast(F.col("extras").getItem(field), target)
    if not columns:
        return rows
    rows = rows.withColumns({name: cast for name, (_, cast) in columns.items()})
    took = F.array_compact(F.array(*[F.when(F.col(f"`{name}`").isNotNull(), F.lit(field)) for name, (field, _) in columns.items()]))
    return rows.withColumn("extras", F.map_filter("extras", lambda k, v: ~F.array_contains(took, k)))


def cast_report(raw: DataFrame, footers: DataFrame, payload: str = "payload") -> DataFrame:
    """``field, target, given, cast_values, failed``: for each cast of the plan the values it was given, those of another type, and those it could not take."""
    plan = cast_plan(footers)
    given = footers.where("field is not null").groupBy("field").agg(F.sum("held").alias("given"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS])
    same = F.coalesce(*[F.when(F.col("target") == k, F.col(f"n_{k}")) for k in KINDS])
    values = unified_news(raw, payload, ()).select(F.explode("extras").alias("field", "text"))
    failed = F.when(F.col("target") == "number", _cast(F.col("text"), "number").isNull()).when(F.col("target") == "boolean", _cast(F.col("text"), "boolean").isNull()).otherwise(False)
    counts = values.join(plan, "field").groupBy("field").agg(F.count_if(failed).alias("failed"))
    return plan.join(given, "field").join(counts, "field", "left").select("field", "target", "given", (F.col("given") - same).alias("cast_values"), F.coalesce("failed", F.lit(0)).alias("failed"))
