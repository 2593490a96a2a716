"""Long reads and the transcripts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions.cigar import fuzzy_matches, sites_of
from isoframe.functions.intervals import overlap_percent, overlaps_within
from isoframe.operators.annotate import annotate
from isoframe.operators.events import ERROR, all_events
from isoframe.operators.interval_join import similar_join
from isoframe.schemas import EVENT_KEY, GRAPH
from isoframe.scratch import once, small, written
from isoframe.sources.annotation import exon_sets


#: What tells reads apart; a name may have several alignments.
READ = ["sample", "name", "chromosome", "strand", "start", "end"]


def assemble_transcripts(transcript_exons: DataFrame) -> DataFrame:
    """One row for each transcript: its place, gene and exons in order."""
    exon = F.struct("start", "end", "exon_id")
    return transcript_exons.groupBy("transcript", "gene", "chromosome", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(exon)).alias("exons"))


def couple(transcripts: DataFrame, reads: DataFrame, error: int = ERROR, percent: float = 90.0, exons: Column | None = None) -> DataFrame:
    """Pairs of a read and a transcript of its strand that overlap by ``percent`` of their hull and share two sites.

    reads: sample, name, chromosome, strand, start, end, exons; sites match within ``error``. Places meet first, without exons,
    and only reads and transcripts at places that overlap so far are joined with their sites; pairs of places are written. ``exons``, if not a column of the
    transcripts, is made of their columns for those only.
    """
    place, r_place = ["chromosome", "strand", "start", "end"], ["chromosome", "strand", "r_start", "r_end"]
    right = transcripts.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    ratio = overlap_percent(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), "hull")
    reads = once(reads, "reads")
    met = similar_join(reads.select(*place).distinct(), right.select(*r_place), place[:2], percent, ratio >= percent, around="left", known=True)
    met = written(met.select(*place, "r_start", "r_end").distinct(), "places")
    right = right.join(small(met), r_place, "left_semi")
    right = right.select(*r_place, "transcript", "gene", F.concat(F.array("r_start"), sites_of(F.col("exons") if exons is None else exons), F.array("r_end")).alias("r_sites"))
    # sites are columns of both sides: inside a lambda they would be made anew for every comparison
    left = reads.join(small(met), place).withColumn("__sites", sites_of(F.col("exons")))
    test = overlaps_within(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), error) & (fuzzy_matches(F.col("__sites"), F.col("r_sites"), error) >= 2)
    pairs = left.join(right.hint("merge"), r_place).where(test)
    return pairs.withColumn("overlap", ratio).drop("r_start", "r_end", "r_sites", "__sites")


def novel_reads(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads that no transcript explains. Alignments of one name are reads of their own."""
    return reads.join(pairs.select(*READ).distinct(), READ, "left_anti")


def read_summary(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample, total, coupled, novel): reads, those that a transcript explains, and the others."""
    hit = pairs.select(*READ).distinct().withColumn("hit", F.lit(1))
    per = reads.select(*READ).join(hit, READ, "left").groupBy("sample").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("coupled"))
    return per.withColumn("novel", F.col("total") - F.col("coupled"))


def templates(pairs: DataFrame) -> DataFrame:
    """Number of reads of each transcript, for each sample."""
    return pairs.groupBy("sample", "gene", "transcript").agg(F.count(F.lit(1)).alias("n_reads"))


def template_events(pairs: DataFrame, error: int = ERROR) -> DataFrame:
    """Events among the reads of one transcript: the graph is keyed by the transcript too."""
    introns = pairs.select("sample", "chromosome", "strand", "transcript", F.explode("introns").alias("i"))
    keys = [*GRAPH, "transcript"]
    junctions = introns.groupBy(*keys, F.col("i.start").alias("start"), F.col("i.end").alias("end")).agg(F.count(F.lit(1)).alias("count"))
    return all_events(junctions, error, keys)


def annotated_template_events(pairs: DataFrame, transcript_exons: DataFrame, error: int = ERROR) -> DataFrame:
    """Template events, each annotated with the exons of its own transcript; of an event of several, the first that knows it
    (of those that tie, the least ratio)."""
    own = transcript_exons.select(F.concat_ws("\x01", "chromosome", "transcript").alias("chromosome"), "start", "end", "strand", "transcript", "gene", "exon_id")
    # the transcript is part of the place, so that an event meets no other's exons
    placed = template_events(pairs, error).withColumn("chromosome", F.concat_ws("\x01", "chromosome", "transcript"))
    found = annotate(placed.drop("transcript"), exon_sets(own)).withColumn("chromosome", F.substring_index("chromosome", "\x01", 1))
    event = EVENT_KEY
    first = F.min_by(F.struct(*[c for c in found.columns if c not in event]), F.struct("is_novel", "transcripts", "exons", "psi"))
    return found.groupBy(*event).agg(first.alias("f")).select(*event, "f.*")


def prefer_graph(graph: DataFrame, template: DataFrame, key: list[str]) -> DataFrame:
    """Events of both routes; where both have one, that of the graph."""
    return graph.unionByName(template.join(graph.select(*key), key, "left_anti"))
