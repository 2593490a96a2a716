"""Junction files as they arrive: the batch counts of a growing folder, kept up by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.sources.junction_files import star_lines


def stream_junctions(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals of junctions over all tables that land in ``folder``; a plain sum, so late files need no watermark."""
    text = spark.readStream.format("text").schema("value string").load(folder)
    found = star_lines(text.select(F.lit("all").alias("sample"), "value"))
    return found.where("start > 0 AND end >= start").groupBy("chromosome", "start", "end", "strand").agg(F.sum("count").alias("count"))
