"""How values are rendered in the text outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NA"


def ratio(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.3f", c)).otherwise(MISSING)


def joined(c: Column) -> Column:
    """A set as sorted, comma-joined text."""
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(F.array_distinct(c)), ",")).otherwise(MISSING)


def junction_key() -> Column:
    return F.concat("chromosome", F.lit(":"), "start", F.lit("-"), "end", F.when(F.col("strand") != ".", F.col("strand")).otherwise(""))


def junction_line() -> Column:
    return F.concat_ws("\t", junction_key(), F.col("count"))


def event_range() -> Column:
    return F.concat("chromosome", F.lit(":"), F.element_at("sites", 1), F.lit("-"), F.element_at("sites", -1), "strand")


def event_sites() -> Column:
    return F.concat("chromosome", F.lit(":"), F.array_join("sites", "-"))


def event_line(subtype: Column) -> Column:
    return F.concat_ws("\t", event_range(), F.col("event"), F.coalesce(subtype, F.lit(MISSING)), event_sites())
