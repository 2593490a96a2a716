"""Interval frames made from the relational test tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.cigar import exons_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt to many tasks: a small file is read in one, and each of its rows becomes many."""
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def junctions(spark: SparkSession, sf_dir: str, by_sample: bool = False) -> DataFrame:
    """Junctions counted from line items; one sample, or one for each return flag.

    They are counted by numbers, which take less of a task's memory and of the shuffle than names, and named afterwards.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        *(["l_returnflag AS sample"] if by_sample else []),
        "CAST(1 + l_suppkey % 5 AS INT) AS c",
        "CAST(l_partkey * 40 + 100 AS INT) AS start",
        "CAST((l_partkey + 1 + CAST(l_quantity AS INT) % 6) * 40 + 90 - 5 * (l_linenumber % 2) AS INT) AS end",
        "l_linestatus <=> 'O' AS plus",
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("count"))
    sample = "sample" if by_sample else "'all' AS sample"
    return counted.selectExpr(sample, "CAST(c AS STRING) AS chromosome", "start", "end", "CASE WHEN plus THEN '+' ELSE '-' END AS strand", "count")


def transcript_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exon for each part, on every chromosome and strand."""
    rows = parts(spark, sf_dir).selectExpr(
        "CAST(p_partkey * 40 + 91 AS INT) AS start", "CAST(p_partkey * 40 + 99 AS INT) AS end", "p_brand AS gene",
        "concat(p_brand, '.', p_size % 3) AS tr", "concat('E', p_partkey) AS exon_id",
    )
    placed = rows.withColumn("p", F.explode(F.array(*[F.struct(F.lit(str(c)).alias("chromosome"), F.lit(s).alias("strand")) for c in range(1, 6) for s in "+-"])))
    return placed.select(F.concat_ws("|", "tr", "p.chromosome", "p.strand").alias("transcript"), "gene", "p.chromosome", "start", "end", "p.strand", "exon_id")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcript_exons(spark, sf_dir)
    return rows.select("chromosome", "start", "end", "strand", "exon_id", F.array("gene").alias("genes"), F.array(F.substring_index("transcript", "|", 1)).alias("transcripts"))


def read_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each order (sample, name, chromosome, strand), its exons in ``b``: one for each of its parts.

    Line items are shuffled once, by order, and made distinct, collected and joined where they then are.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # else they are merged by bytes, and numbers pack well
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_partkey * 40 + 91 AS INT) AS s").repartition(tasks, "k").distinct()
    blocks = items.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("start"), (F.col("s") + 8).alias("end")))).alias("b"))
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(1 + o_custkey % 5 AS STRING) AS chromosome", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "o_orderstatus AS sample")
    return orders.join(blocks, "k").select("sample", F.concat(F.lit("r"), "k").alias("name"), "chromosome", "strand", "b")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of ``read_exons`` with introns between their exons."""
    n = F.size("b")
    introns = F.zip_with(F.slice("b", 1, n - 1), F.slice("b", 2, n - 1), lambda x, y: F.struct((x["end"] + 1).alias("start"), (y["start"] - 1).alias("end")))
    out = read_exons(spark, sf_dir).select("sample", "name", "chromosome", F.element_at("b", 1)["start"].alias("start"), F.element_at("b", -1)["end"].alias("end"), "strand", introns.alias("introns"))
    return out.withColumn("exons", exons_of(F.col("start"), F.col("end"), F.col("introns")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment blocks from line items."""
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(1 + l_suppkey % 5 AS STRING) AS chromosome", "CAST(l_partkey * 40 AS INT) AS r_start", "CAST(l_partkey * 40 + l_quantity AS INT) AS r_end")
