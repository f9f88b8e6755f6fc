"""Columns that put numbers, shares, moments and values into words for a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN = 4  # values that are named before the rest is counted


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def share(part: Column, whole: Column) -> Column:
    """12.5%; n/a of nothing."""
    return F.when(whole == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", 100.0 * part / whole), F.lit("%")))


def moment(iso: Column) -> Column:
    """A time in ISO 8601 to the minute; shorter texts as they are."""
    return F.when(F.length(iso) >= 16, F.concat(F.substring(iso, 1, 10), F.lit(" "), F.substring(iso, 12, 5), F.lit(" UTC"))).otherwise(F.coalesce(iso, F.lit("")))


def counted_values(values: Column) -> Column:
    """Of an array of (v, n): the first few in quotes with their counts, and how many more there are."""
    named = F.transform(F.slice(values, 1, SHOWN), lambda x: F.concat(F.lit("'"), x["v"], F.lit("' ("), thousands(x["n"]), F.lit(")")))
    more = F.size(values) - SHOWN
    return F.concat(F.array_join(named, ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def numbers_in(text: Column) -> Column:
    """The numbers of a text, without separators and final points, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", ""))
    return F.array_distinct(found)


def canonical(text: Column) -> Column:
    """JSON text with the names of every object in order and no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))
