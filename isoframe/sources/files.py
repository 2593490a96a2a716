"""Text inputs as one DataFrame of lines over all files, each line with its sample."""

from __future__ import annotations

from collections import Counter
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _depth(paths: list[str]) -> tuple[set[str], int]:
    """Base names that several paths have, and how many last parts tell those paths apart (32 at most)."""
    counts = Counter(PurePosixPath(p).name for p in set(paths))
    clash = {n for n, c in counts.items() if c > 1}
    same = [PurePosixPath(p).parts for p in set(paths) if PurePosixPath(p).name in clash]
    depth = next((d for d in range(1, 32) if len({x[-d:] for x in same}) == len(same)), 32)
    return clash, depth


def sample_names(paths: list[str]) -> dict[str, str]:
    """path -> sample: the file's base name, with as many parent folders as tell all files of clashing base names apart."""
    clash, depth = _depth(paths)
    return {p: "/".join(PurePosixPath(p).parts[-depth:]) if PurePosixPath(p).name in clash else PurePosixPath(p).name for p in paths}


def sample_column(paths: list[str]) -> Column:
    """The sample of a row of the text source, by its file."""
    clash, depth = _depth(paths)
    name = F.col("_metadata.file_name")
    # paths are written as URIs; a plus stands for itself there
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.when(name.isin(sorted(clash)), F.substring_index(path, "/", -depth)).otherwise(name) if clash else name


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample, value) of every line that is neither empty nor a comment."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).select(sample_column(paths).alias("sample"), "value").where("value <> '' AND NOT startswith(value, '#')")


def placed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample, path, split, nth, value) of every line: ``split`` is the first byte of the part of the file that a task reads,
    and lines of one split follow each other by ``nth``, one by one; splits of a file follow each other."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = spark.read.text(paths).select(sample_column(paths).alias("sample"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    return read.withColumn("nth", F.monotonically_increasing_id())
