"""Two-pass external shuffle into shards of near equal row counts (DataFrame functions only).

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash. Pass 2 permutes each bucket by Fisher-Yates
(Spark's ``shuffle`` of an array) and numbers its rows. The buckets laid end to end are one random order of the whole
input; rank r goes to shard r mod n at slot r div n, so shard sizes differ by one row at most and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import free, written

BUCKET_BYTES = 16 << 20
#: Buckets are numbered in two levels so that no prefix sum runs over more than about the root of their number.
LEVEL = 1024


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 7, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot and grown_shard added, under the law ``rows``.

    size: UTF-8 bytes of the text plus 1; a null text has none, and its crc is that of nothing (0). The bucket of a row is
    a seeded hash of its id, its text's crc and its place in the input, so that repeated rows and null ids spread like any
    others; that place is the same whenever the rows are read, as long as the input's files are. Columns of ``df`` named like the added ones are replaced. An empty table gives no rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = [c for c in df.columns if c not in added]
    bucket, rows_, at, row_ = free(df, "__bucket", "__rows", "__at", "__row")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(*rest).withColumns({"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body)})
    total = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 64)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col("text_crc32"), F.monotonically_increasing_id())
    scattered = rows.withColumn(bucket, F.pmod(key, F.lit(n_buckets)))
    # pass 2: Fisher-Yates in each bucket
    row = F.struct(*[F.col(c) for c in [*rest, "size", "text_crc32"]])
    permuted = scattered.groupBy(bucket).agg(F.shuffle(F.collect_list(row), F.lit(seed)).alias(rows_))
    permuted = written(permuted.select(bucket, F.posexplode(rows_).alias(at, row_)), "buckets")
    counts = permuted.groupBy(F.col(bucket).alias("__bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("__level", F.floor(F.col("__bucket") / LEVEL))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy("__level").agg(F.sum("n").alias("n")).select("__level", F.coalesce(F.sum("n").over(before([], "__level")), F.lit(0)).alias("__base"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("n").over(before(["__level"], "__bucket")), F.lit(0))).join(levels, "__level")
    offsets = offsets.select(F.col("__bucket").alias(bucket), (F.col("__off") + F.col("__base")).alias("__first"))
    rank = F.col("__first") + F.col(at)
    return permuted.join(offsets, bucket).select(
        *[F.col(row_)[c].alias(c) for c in [*rest, "size", "text_crc32"]],
        F.lit("rows").alias("law"),
        F.pmod(rank, F.lit(n_shards)).cast("int").alias("shard"),
        ((rank - F.pmod(rank, F.lit(n_shards))) / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows of every shard in slot order under ``path/shard=N``."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
