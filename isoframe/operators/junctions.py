"""Junction counts: from reads, filters within and over samples, count matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.functions.text import junction_key

KEY = ["chromosome", "start", "end", "strand"]


def count_junctions(reads: DataFrame) -> DataFrame:
    """Junctions of reads (sample, chromosome, strand, introns), each counted once for each read that has it."""
    spliced = reads.select("sample", "chromosome", "strand", F.explode("introns").alias("i"))
    spliced = spliced.select("sample", "chromosome", F.col("i.start").alias("start"), F.col("i.end").alias("end"), "strand")
    return spliced.groupBy("sample", *KEY).agg(F.count(F.lit(1)).alias("count"))


def at_least(junctions: DataFrame, count: int) -> DataFrame:
    return junctions.where(F.col("count") >= count)


def low_overall(junctions: DataFrame, total: int) -> DataFrame:
    """Junctions whose count over all samples is below ``total``."""
    return junctions.groupBy(*KEY).agg(F.sum("count").alias("total")).where(F.col("total") < total)


def drop_low_overall(junctions: DataFrame, total: int) -> DataFrame:
    return junctions.join(low_overall(junctions, total).select(*KEY), KEY, "left_anti")


def merge(*frames: DataFrame) -> DataFrame:
    """Sums the counts of several junction frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("sample", *KEY).agg(F.sum("count").alias("count"))


def starts_between(junctions: DataFrame, low: int, high: int) -> DataFrame:
    """Junctions whose start lies in [low, high]."""
    return junctions.where(F.col("start").between(low, high))


def count_matrix(junctions: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """One row for each junction, one column for each sample, null where the sample lacks it."""
    return junctions.groupBy(junction_key().alias("junction")).pivot("sample", samples).agg(F.sum("count"))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Number of junctions before and after a filter."""
    count = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    return count(before, "before").unionByName(count(after, "after"))
