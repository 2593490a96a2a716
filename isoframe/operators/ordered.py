"""Neighbours in genomic order without sorting a whole chromosome in one task.

Rows are ordered within stretches of coordinates, and stretches are linked by their edges, one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 20


def with_next(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``name``: ``value`` of the next row by ``order`` (its first column a coordinate), null for the last."""
    tiled = df.withColumn("__tile", F.floor(F.col(order[0]) / stretch))
    inside = F.lead(value).over(Window.partitionBy(*keys, "__tile").orderBy(*order))
    first = tiled.groupBy(*keys, "__tile").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    edges = first.withColumn("__after", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__tile"))).drop("__first")
    return tiled.withColumn("__inside", inside).join(edges, [*keys, "__tile"]).withColumn(name, F.coalesce("__inside", "__after")).drop("__tile", "__inside", "__after")
