"""Intron retention: gaps between events that match gaps between a transcript's exons, and their depth of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.functions.intervals import overlap_percent
from isoframe.operators.coverage import coverage, depth_sums, looked_up
from isoframe.operators.interval_join import both_strands, similar_join
from isoframe.operators.ordered import with_next
from isoframe.schemas import GRAPH

FLANK = 20


def event_gaps(events: DataFrame) -> DataFrame:
    """[end, next start] of events that follow each other in a graph, repeated intervals counting once."""
    each = events.select(*GRAPH, "start", "end").distinct()
    gaps = with_next(each, GRAPH, ["start", "end"], "start", "next_start").where("next_start >= end")
    return gaps.select(*GRAPH, F.col("end").alias("start"), F.col("next_start").alias("end"))


def exon_gaps(transcript_exons: DataFrame) -> DataFrame:
    """[end, next start] of a transcript's consecutive exons, with the exon before."""
    w = Window.partitionBy("transcript").orderBy("start", "end", "exon_id")
    gaps = transcript_exons.withColumn("next_start", F.lead("start").over(w)).where("next_start >= end")
    return gaps.select("chromosome", "strand", F.col("end").alias("r_start"), F.col("next_start").alias("r_end"), "transcript", "gene", "exon_id")


def retained_introns(events: DataFrame, transcript_exons: DataFrame, percent: float = 90.0) -> DataFrame:
    """IR events: an event gap and an exon gap whose overlap is more than ``percent`` of their hull.

    intron_start and intron_end are the annotated intron's first and last base; psi is null until depth is known.
    """
    left = both_strands(event_gaps(events).distinct())
    right = exon_gaps(transcript_exons).withColumnRenamed("strand", "join_strand")
    ratio = overlap_percent(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end"), "hull")
    pairs = similar_join(left, right, ["chromosome", "join_strand"], percent, ratio > percent, around="left")
    return pairs.select(
        *GRAPH,
        F.lit("IR").alias("event"),
        F.least("start", "r_start").alias("start"),
        F.greatest("end", "r_end").alias("end"),
        F.array_sort(F.array("start", "r_start", "end", "r_end")).alias("sites"),
        F.lit(None).cast("double").alias("psi"),
        (F.col("r_start") + 1).alias("intron_start"),
        (F.col("r_end") - 1).alias("intron_end"),
        "gene", "transcript", "exon_id",
    ).distinct()


def _keys(*frames: DataFrame) -> list[str]:
    return ["chromosome"] + (["sample"] if all("sample" in f.columns for f in frames) else [])


def mean_depth(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(region, depth): mean coverage of the covered positions of every region that has any.

    regions: region, chromosome, start, end; blocks: chromosome, r_start, r_end (and sample in both, if there are several).
    """
    sums = depth_sums(regions.where("end >= start"), blocks, _keys(regions, blocks), ["region"]).where("covered > 0")
    return sums.select("region", (F.col("total") / F.col("covered")).alias("depth"))


def depth_ratio(introns: DataFrame, blocks: DataFrame, flank: int = FLANK, by: list[str] | None = None) -> DataFrame:
    """(by, psi): depth inside introns (chromosome, start, end, and ``by``, a region's name unless told) over that of ``flank``
    bases on both sides.

    Means are over covered positions; without any inside or in the flanks psi is null.
    """
    by, keys = by or ["region"], _keys(introns, blocks)
    # four look-ups, each with what it adds to the sums inside and to those of the flanks
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    places = ((start - flank, 0, -1), (start, -1, 1), (end + 1, 1, -1), (end + 1 + flank, 0, 1))
    borders = F.array(*[F.struct(pos.alias("pos"), F.lit(i).alias("inside"), F.lit(o).alias("around")) for pos, i, o in places])
    own = {c: f"__by{i}" for i, c in enumerate(by) if c not in keys}
    named = introns.select(*keys, *[F.col(c).alias(n) for c, n in own.items()], F.explode(borders).alias("p"))
    found = looked_up(named.select(*keys, *own.values(), "p.*"), coverage(blocks, keys), keys)
    amount = lambda c, side: F.sum(F.col(side) * F.col(c))
    mean = lambda side: F.try_divide(amount("total", side), amount("covered", side))
    return found.groupBy(*[F.col(own.get(c, c)).alias(c) for c in by]).agg(F.try_divide(mean("inside"), mean("around")).alias("psi"))


def depth_regions(retained: DataFrame, flank: int = FLANK) -> DataFrame:
    """(chromosome, start, end) within which ``with_depth`` looks at blocks."""
    return retained.select("chromosome", (F.col("intron_start") - flank).alias("start"), (F.col("intron_end") + flank).alias("end"))


def with_depth(retained: DataFrame, blocks: DataFrame, flank: int = FLANK) -> DataFrame:
    """IR events with psi from alignment blocks (sample, chromosome, r_start, r_end)."""
    by = ["sample", "chromosome", "intron_start", "intron_end"]
    introns = retained.select(*by).distinct().where("intron_end >= intron_start").withColumns({"start": F.col("intron_start"), "end": F.col("intron_end")})
    return retained.drop("psi").join(depth_ratio(introns, blocks, flank, by), by, "left")
