"""Helpers the training-data operators share: written intermediates, checked broadcasts, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.scratch import BROADCAST_BYTES, new_path, shared_dir, small, written, written_bytes  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An Arrow batch of texts; executors hold some copies of one outside their heap for each task.
ARROW_BYTES = 4 << 20
_kept: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, of one name at a time: workers outlive operators, and so would their caches."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drops what this Python worker has kept for other operators."""
    _kept.clear()


@contextmanager
def small_batches(spark: SparkSession, limit: int = ARROW_BYTES) -> Iterator[None]:
    """What is run within it hands batches of about ``limit`` bytes to Python; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``written``, in buckets of ``key``: later groupings by it shuffle nothing of this table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"isoframe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.isoframe_path, out.isoframe_table = path, table
    return out


def forget(df: DataFrame) -> None:
    """Deletes a written table that no later plan reads."""
    spark, path = df.sparkSession, df.isoframe_path
    if name := getattr(df, "isoframe_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one operator, which go together."""

    def __init__(self):
        self._tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(written(df, name))
        return self._tables[-1]

    def forget(self) -> None:
        for table in self._tables:
            forget(table)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of a few rows, so that texts become Python objects a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column | str) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")).cast("binary"))
