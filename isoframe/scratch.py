"""Tables that plans write on the way, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, as written, that is sent to every executor; beyond it joins shuffle both sides.
BROADCAST_BYTES = 32 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it may be unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="isoframe-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/isoframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives a lost executor, is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.isoframe_path = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a written table, else written: for plans that read it several times. What is returned lazily reads it, so
    the table stays until the folder is cleaned."""
    return df if hasattr(df, "isoframe_path") else written(df, name)


def written_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, to be broadcast only if its files are within ``limit`` bytes."""
    return F.broadcast(df) if written_bytes(df.sparkSession, df.isoframe_path) <= limit else df
