"""Text and number expressions that all operators share; every one stays a JVM expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"
ALIAS_SEPARATORS = r"[|,;；、/]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def text(x: Column | str) -> Column:
    """Null as empty, trimmed."""
    return F.coalesce(strip(x), F.lit(""))


def squeeze(x: Column | str) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), BLANKS, ""))


def title_and_body(title: str = "title", body: str = "body", limit: int | None = None) -> Column:
    b = F.coalesce(F.col(body), F.lit(""))
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), b if limit is None else F.substring(b, 1, limit))


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def hits(x: Column, values: list[str]) -> Column:
    """The words that occur in a lower-case text, whatever their own case, in the list's order. Plain tests, which are compiled, not a lambda."""
    return F.array_compact(F.array(*[F.when(F.contains(x, F.lit(v.lower())), F.lit(v)) for v in values]))


def hits_exact(x: Column, values: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(x, F.lit(v)), F.lit(v)) for v in values]))


def any_of(x: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(v)) for v in values])


def unique_texts(x: Column) -> Column:
    """Trimmed, without empty and repeated items, first ones first."""
    return F.array_distinct(F.filter(F.transform(x, strip), lambda v: v.isNotNull() & (v != "")))


def split_bar(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), r"\|"), strip), lambda v: v != "")


def join_bar(x: Column) -> Column:
    return F.array_join(x, "|")


def split_aliases(aliases: Column | str, name: Column | str) -> Column:
    return unique_texts(F.concat(F.split(F.coalesce(col(aliases), F.lit("")), ALIAS_SEPARATORS), F.array(col(name))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def r4(x: Column) -> Column:
    """Four digits; ten first, so that sums in another order round alike."""
    return F.round(F.round(x, 10), 4)


def number(x: Column | str, default: float = 0.0) -> Column:
    """As double; null, NaN and what is no number give ``default``."""
    x = col(x).try_cast("double")
    return F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(default))


def count_weighted(found: Column, found_in_title: Column, in_title: float, elsewhere: float) -> Column:
    """Sum over the words hit: one weight for those in the title, another for the rest."""
    return F.size(found_in_title) * in_title + (F.size(found) - F.size(found_in_title)) * elsewhere
