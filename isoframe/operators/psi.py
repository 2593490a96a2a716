"""Percent spliced in: a junction's share of all that use its start, and of all that use its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.text import junction_key
from isoframe.schemas import GRAPH


def with_psi(junctions: DataFrame, keys: list[str] = GRAPH) -> DataFrame:
    """Adds psi_start, psi_end (null where the node has no counts), n_start, n_end (fan-outs), and the range of the partners."""
    at_start, at_end = Window.partitionBy(*keys, "start"), Window.partitionBy(*keys, "end")
    share = lambda w: F.try_divide(F.col("count").cast("double"), F.sum("count").over(w).cast("double"))
    one = F.lit(1)
    out = junctions.withColumns({"psi_start": share(at_start), "n_start": F.count(one).over(at_start), "max_end": F.max("end").over(at_start), "min_end": F.min("end").over(at_start)})
    return out.withColumns({"psi_end": share(at_end), "n_end": F.count(one).over(at_end), "min_start": F.min("start").over(at_end), "max_start": F.max("start").over(at_end)})


def psi_matrix(junctions: DataFrame, side: str = "start", samples: list[str] | None = None) -> DataFrame:
    """One row for each junction, the ratio in each sample, by same start or same end."""
    ratios = with_psi(junctions)
    return ratios.groupBy(junction_key().alias("junction")).pivot("sample", samples).agg(F.first(f"psi_{side}"))


def farthest_site(junctions: DataFrame, side: str = "start", keys: list[str] = GRAPH) -> DataFrame:
    """The partner farthest from each start (the greatest end) or end (the least start)."""
    partner = F.max("end") if side == "start" else F.min("start")
    return junctions.groupBy(*keys, F.col(side).alias("node")).agg(partner.alias("site"))


def kth_site(junctions: DataFrame, k: int, keys: list[str] = GRAPH) -> DataFrame:
    """The k-th end, from 1, of every start that has as many."""
    w = Window.partitionBy(*keys, "start").orderBy("end")
    return junctions.withColumn("k", F.row_number().over(w)).where(F.col("k") == k).drop("k")


def neighbours(junctions: DataFrame, keys: list[str] = GRAPH) -> DataFrame:
    """Every start with the sorted set of its ends."""
    return junctions.groupBy(*keys, F.col("start").alias("node")).agg(F.sort_array(F.collect_set("end")).alias("sites"))
