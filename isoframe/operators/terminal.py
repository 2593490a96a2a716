"""Alternative first and last exons: A3 and A5 events at the second exon of transcripts that differ in the outer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.annotate import NEAR
from isoframe.operators.interval_join import BIN, both_strands
from isoframe.schemas import EVENT_KEY


def exon_ordinals(transcript_exons: DataFrame) -> DataFrame:
    """Each exon's number from the left (forward, from 0), from the right (backward, from -1) and in transcription order."""
    left = Window.partitionBy("transcript").orderBy("start", "end", "exon_id")
    right = Window.partitionBy("transcript").orderBy(F.desc("start"), F.desc("end"), F.desc("exon_id"))
    out = transcript_exons.withColumns({"forward": F.row_number().over(left) - 1, "backward": -F.row_number().over(right)})
    return out.withColumn("ordinal", F.when(F.col("strand") == "-", -F.col("backward")).otherwise(F.col("forward") + 1))


def second_exons(transcript_exons: DataFrame) -> DataFrame:
    """The second exons (by coordinates) with the outer edges of all transcripts that contain them.

    Ordinals and outer edges are found where a transcript's exons are, so that places are grouped once and nothing is joined: what
    the files of the exons measure would have a side broadcast that is many times as large.
    """
    place = ["chromosome", "strand", "start", "end"]
    whole = Window.partitionBy("transcript")
    edges = {"first_end": F.min_by("end", F.struct("start", "end")).over(whole), "last_start": F.max_by("start", F.struct("start", "end")).over(whole)}
    rows = exon_ordinals(transcript_exons.where("transcript IS NOT NULL")).withColumns(edges).where("strand IN ('+', '-')")
    owners = rows.groupBy("transcript", *place).agg(F.max(F.col("ordinal") == 2).alias("second"), *[F.first(c).alias(c) for c in edges])
    places = owners.groupBy(*place).agg(F.max("second").alias("second"), F.collect_list("first_end").alias("first_ends"), F.collect_list("last_start").alias("last_starts"))
    return places.where("second").drop("second")


def terminal_subtypes(events: DataFrame, transcript_exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """(key, terminal): AFE or ALE for the A3 and A5 events that are such; others have no row.

    The shared site lies within NEAR of a second exon's far edge, that exon is in two transcripts or more, and each of the
    two alternative sites lies within NEAR of an outer edge of theirs. A shared site is dealt to one bin, an edge to those that it
    is near to; both sides are read and shuffled once.
    """
    site = lambda i: F.element_at("sites", i)
    bins = lambda x: F.floor(x / F.lit(bin_size)).cast("long")
    side = lambda test, edge, outer: F.struct(F.lit(test).alias("same_start"), F.col(edge).alias("edge"), F.col(outer).alias("outer"))
    seconds = second_exons(transcript_exons).where("size(first_ends) >= 2 AND end >= start")
    seconds = seconds.select("chromosome", F.col("strand").alias("join_strand"), F.explode(F.array(side(True, "end", "last_starts"), side(False, "start", "first_ends"))).alias("e"))
    seconds = seconds.select("chromosome", "join_strand", "e.*").withColumn("__bin", F.explode(F.sequence(bins(F.col("edge") - NEAR), bins(F.col("edge") + NEAR))))
    alt = both_strands(events.where("event IN ('A3', 'A5')").select(*key)).withColumn("same_start", site(1) == site(2))
    shared = F.when(F.col("same_start"), site(1)).otherwise(site(4))
    pairs = alt.withColumn("__bin", bins(shared)).join(seconds.hint("merge"), ["chromosome", "join_strand", "same_start", "__bin"]).where(F.abs(shared - F.col("edge")) <= NEAR)
    has = lambda x: F.exists("outer", lambda e: F.abs(e - x) <= NEAR)
    pairs = pairs.where(has(F.when(F.col("same_start"), site(3)).otherwise(site(1))) & has(F.when(F.col("same_start"), site(4)).otherwise(site(2))))
    name = F.when(F.col("same_start") == (F.col("strand") == "-"), "AFE").otherwise("ALE")
    return pairs.select(*key, name.alias("terminal")).distinct()


def with_terminal(events: DataFrame, transcript_exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """Annotated events whose subtype is AFE or ALE where they are such."""
    found = terminal_subtypes(events, transcript_exons, bin_size, key)
    return events.join(found, key, "left").withColumn("subtype", F.coalesce("terminal", "subtype")).drop("terminal")
