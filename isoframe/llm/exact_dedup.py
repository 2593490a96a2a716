"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. Every text gets a 64-bit key. The index holds one entry per key with its number of rows, so that any number of
   copies takes one entry and a hot text cannot overfill a bucket.
2. The directory has a slot for every value of the key's first bits. It doubles, by one more bit, until no bucket holds more
   entries than the capacity; slots that need not be told apart share a bucket. Entries are written to shared files by
   bucket, so that each owner task writes one range of keys.
3. Rows find their bucket through the directory and meet its entries there. Those of keys with more than one row are chained:
   per bucket and key one link for each different text, told apart by its bytes, with its rows counted and its largest id.
   Copies are folded before they are shuffled. The row with the largest id of a link stays.

Only texts whose key occurs more than once are shuffled, one for each task that holds it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import forget, free, small, written

#: Entries of a bucket at most. The directory has about four slots for each full bucket.
CAPACITY = 50_000


def leaf_of(key: Column | str, depth: int) -> Column:
    """The first ``depth`` bits of the key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def directory(leaves: dict[int, int], capacity: int, depth: int) -> list[tuple[int, int, int]]:
    """Buckets (prefix, depth, entries) from entry counts by the first ``depth`` bits of the key."""
    done, open_ = [], [(0, 0, sorted(leaves.items()))]
    while open_:
        prefix, d, held = open_.pop()
        if sum(n for _, n in held) <= capacity or d == depth:
            done.append((prefix, d, sum(n for _, n in held)))
            continue
        middle = (2 * prefix + 1) << (depth - d - 1)
        open_ += [(2 * prefix, d + 1, [x for x in held if x[0] < middle]), (2 * prefix + 1, d + 1, [x for x in held if x[0] >= middle])]
    return sorted(done, key=lambda b: b[0] << (depth - b[1]))


def build_index(keyed: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The written index (bucket, key, n_rows) of ``keyed`` (a column ``key``), the directory (leaf, bucket) and its depth."""
    spark = keyed.sparkSession
    entries = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "entries")
    depth = max(0, (4 * entries.count() // capacity).bit_length() - 1)
    while True:
        # about 4 * entries / capacity counters reach the driver; keys differ, so at 64 bits each is alone
        leaves = {r["leaf"]: r["count"] for r in entries.groupBy(leaf_of("key", depth).alias("leaf")).count().collect()}
        if depth == 64 or max(leaves.values(), default=0) <= capacity:
            break
        depth += 1
    slots = [(0, 0)]
    if depth:
        buckets = directory(leaves, capacity, depth)
        slots = [(x, at) for at, (prefix, d, _) in enumerate(buckets) for x in (range(prefix << (depth - d), (prefix + 1) << (depth - d)) if depth <= 24 else [y for y in leaves if y >> (depth - d) == prefix])]
    # from Arrow, as rows of Python objects would start Python workers on the executors, which stay after it
    columns = [pa.array(x, kind) for x, kind in zip(zip(*slots, strict=True), (pa.int64(), pa.int32()), strict=True)]
    table = written(spark.createDataFrame(pa.table(columns, ["leaf", "bucket"])), "directory")
    dealt = entries.withColumn("leaf", leaf_of("key", depth)).join(small(table), "leaf").select("bucket", "key", "n_rows")
    out = written(dealt.repartitionByRange("bucket", "key"), "index")
    forget(entries)
    return out, table, depth


def chains_of(docs: DataFrame, text: str, doc_id: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, key, sha, keep_id, group_size) for every text on several rows, and the ids that stand on several such rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("id"), body.alias("body"), F.xxhash64(body).alias("key"))
    index, slots, depth = build_index(keyed.select("key"), capacity)
    listed = written(index.where("n_rows > 1").select(F.col("bucket").alias("b2"), F.col("key").alias("k2")), "many")
    many = small(listed)
    rows = keyed.withColumn("leaf", leaf_of("key", depth)).join(small(slots), "leaf")
    rows = rows.join(many, (F.col("key") == F.col("k2")) & (F.col("bucket") == F.col("b2")), "left_semi")
    # the rows of a text are folded within each task before they are shuffled
    links = rows.groupBy("bucket", "key", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    chains = written(links.select("bucket", "key", F.sha2("body", 256).alias("sha"), "keep_id", "group_size"), "chains")
    twice = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "twice")
    for table in (index, slots, listed):
        forget(table)
    return chains, twice


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added; of equal texts the row with the largest id stays.

    A null text counts as empty. A null id sorts before every other. Of several rows with the same text and the same
    largest id, one stays. Columns of ``docs`` named like the added ones are replaced. An empty table gives no rows.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in docs.columns if c not in names]
    key, own, of, sha, nth, of2 = free(docs, "__key", "__own", "__of", "__sha", "__nth", "__of2")
    body = F.coalesce(F.col(text), F.lit(""))
    chains, twice = chains_of(docs, text, doc_id, capacity)
    found = small(chains).select(F.col("key").alias(of), F.col("sha").alias(sha), "keep_id", "group_size")
    rows = docs.select(*rest, F.xxhash64(body).alias(key), F.col(doc_id).alias(own), F.sha2(body, 256).alias("text_sha256"))
    out = rows.join(found, (F.col(key) == F.col(of)) & (F.col("text_sha256") == F.col(sha)), "left").withColumns({
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "keep_id": F.when(F.col(of).isNull(), F.col(own)).otherwise(F.col("keep_id")),
    })
    out = out.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(own)))
    if not twice.isEmpty():
        # of rows that repeat text and id one stays: the first of each task's, then the first of those
        also = small(twice).select(F.col("id").alias(of2), F.lit(True).alias(nth))
        out = out.join(also, F.col(own).eqNullSafe(F.col(of2)), "left").withColumn(nth, F.col("kept") & (F.col("group_size") > 1) & F.coalesce(nth, F.lit(False)))
        tied, first = out.where(nth), lambda *by: F.row_number().over(Window.partitionBy("text_sha256", own, *by).orderBy(F.lit(0)))
        tied = written(tied.withColumn("kept", first(F.spark_partition_id()) == 1), "tied")
        out = out.where(~F.col(nth)).unionByName(tied.where("NOT kept")).unionByName(tied.where("kept").withColumn("kept", first() == 1))
    return out.select(*rest, *names)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
