"""Junction files: STAR tables and junction text; of repeated keys of a file the last line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.intervals import chromosome, is_valid, strand
from isoframe.schemas import JUNCTIONS
from isoframe.sources.files import placed_lines


def _tidy(df: DataFrame) -> DataFrame:
    df = df.withColumns({"chromosome": chromosome(F.col("chromosome")), "strand": strand(F.col("strand"))})
    df = df.where(is_valid(F.col("start"), F.col("end")) & F.col("count").isNotNull())
    # lines without a place have no order: the largest count is taken
    count = F.max_by("count", "place") if "place" in df.columns else F.max("count")
    return df.groupBy("sample", "chromosome", "start", "end", "strand").agg(count.alias("count"))


def _place(found: DataFrame) -> list[str]:
    return ["place"] if "place" in found.columns else []


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their place in the file, comments and empty lines aside."""
    found = placed_lines(spark, paths).where("value <> '' AND NOT startswith(value, '#')")
    return found.select("sample", "value", F.struct("path", "split", "nth").alias("place"))


def star_lines(found: DataFrame) -> DataFrame:
    """Junctions of (sample, value) lines of nine white-space separated columns; the count is of unique reads."""
    c = F.split(F.trim("value"), r"\s+")
    rows = found.where(F.size(c) >= 9)
    code = F.try_element_at(c, F.lit(4))
    return rows.select(
        "sample", F.get(c, 0).alias("chromosome"), F.get(c, 1).try_cast("int").alias("start"), F.get(c, 2).try_cast("int").alias("end"),
        F.when(code == "1", "+").when(code == "2", "-").otherwise(".").alias("strand"), F.get(c, 6).try_cast("long").alias("count"), *_place(found),
    )


def junction_lines(found: DataFrame) -> DataFrame:
    """Junctions of (sample, value) lines ``chromosome:start-end[strand] TAB count``."""
    part = lambda i: F.regexp_extract("value", r"^([\w.]+):(\d+)-(\d+)([+.-]?)\t(\d+)", i)
    number = lambda i, kind: part(i).try_cast(kind)
    return found.select("sample", part(1).alias("chromosome"), number(2, "int").alias("start"), number(3, "int").alias("end"), part(4).alias("strand"), number(5, "long").alias("count"), *_place(found))


def read_star(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _tidy(star_lines(_lines(spark, paths))).select(*[c.split()[0] for c in JUNCTIONS.split(", ")])


def read_junctions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _tidy(junction_lines(_lines(spark, paths))).select(*[c.split()[0] for c in JUNCTIONS.split(", ")])
