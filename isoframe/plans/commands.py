"""The four commands, each one lazy plan over all samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions import text as tx
from isoframe.operators import coupling, isoforms, junctions, psi, report
from isoframe.operators.annotate import annotate
from isoframe.operators.events import ERROR, all_events
from isoframe.operators.retention import depth_regions, retained_introns, with_depth
from isoframe.operators.terminal import with_terminal
from isoframe.plans import inputs
from isoframe.scratch import once, written
from isoframe.sources import alignments
from isoframe.sources.annotation import exon_sets, read_annotation
from isoframe.sources.companions import companions


def extract(spark: SparkSession, paths: list[str], min_count: int = 0) -> DataFrame:
    """Junctions with their counts."""
    return junctions.at_least(inputs.junctions(spark, paths), min_count)


def filtered(found: DataFrame, min_count: int, overall: int | None) -> DataFrame:
    """Junctions that pass the count in their sample and, over all samples, ``overall``."""
    kept = junctions.drop_low_overall(found, overall) if overall else found
    return junctions.at_least(kept, min_count)


def graph_events(found: DataFrame, transcript_exons: DataFrame, error: int, percent: float, blocks: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Events of junctions, annotated, with terminal subtypes, and retained introns with their ratio if there is depth.

    ``blocks`` gives alignment blocks, all that lie in the regions it is given, or None.
    """
    detected = written(all_events(found, error), "events")  # annotation and retention both read it
    events = with_terminal(annotate(detected, exon_sets(transcript_exons)), transcript_exons)
    retained = written(retained_introns(detected, transcript_exons, percent), "retained")
    if (depth := blocks(depth_regions(retained))) is not None:
        retained = with_depth(retained, depth)
    by = [c for c in retained.columns if c in ("sample", "event", "chromosome", "start", "end", "strand", "sites")]
    each = lambda c, name: F.sort_array(F.collect_set(c)).alias(name)
    retained = retained.groupBy(*by).agg(F.first("psi").alias("psi"), each("gene", "genes"), each("transcript", "transcripts"), each("exon_id", "exons"))
    return events.unionByName(retained.withColumns({"is_novel": F.lit(False), "subtype": F.lit("NA")}))


def is_bam(path: str) -> bool:
    return path.lower().endswith(".bam")


def depth_blocks(spark: SparkSession, paths: list[str], bam: str | None, own: bool = False, regions: DataFrame | None = None) -> DataFrame | None:
    """Alignment blocks under the sample names of the inputs; with ``own``, a BAM input has its own.

    With ``regions`` at least those that lie in them: files with an index are read there only.
    """
    pairs = companions(paths, bam) | ({p: p for p in paths if is_bam(p)} if own else {})
    pairs = {p: b for p, b in pairs.items() if b}
    if not pairs:
        return None
    from isoframe.sources.files import sample_names

    names_of, theirs = sample_names(paths), sample_names(list(pairs.values()))
    blocks = alignments.to_blocks(alignments.read_bam(spark, sorted(set(pairs.values())), regions))
    names = spark.createDataFrame([(theirs[b], names_of[p]) for p, b in pairs.items()], "bam_sample string, name string")
    return blocks.join(names, F.col("sample") == F.col("bam_sample")).select(F.col("name").alias("sample"), "chromosome", "r_start", "r_end")


def short(spark: SparkSession, paths: list[str], reference: str, min_count: int | None = None, overall: int | None = None, error: int = ERROR, percent: float = 90.0, bam: str | None = None) -> DataFrame:
    """Annotated events of short reads, one row for each sample and event."""
    count = min_count if min_count is not None else (1 if overall else 3)
    found = filtered(inputs.junctions(spark, paths), count, overall)
    return graph_events(found, read_annotation(spark, reference), error, percent, lambda regions: depth_blocks(spark, paths, bam, regions=regions))


def long(spark: SparkSession, paths: list[str], reference: str, min_count: int = 0, overall: int | None = None, error: int = ERROR, read_percent: float = 90.0, percent: float = 90.0, bam: str | None = None) -> DataFrame:
    """Annotated events of long reads: of each transcript's reads, and of all reads together."""
    reads = inputs.reads(spark, paths)
    transcript_exons = read_annotation(spark, reference)
    found = filtered(junctions.count_junctions(reads), min_count, overall)
    graph = graph_events(found, transcript_exons, error, percent, lambda regions: depth_blocks(spark, paths, bam, own=True, regions=regions))
    pairs = coupling.couple(coupling.assemble_transcripts(transcript_exons), reads, error, read_percent)
    own = coupling.annotated_template_events(pairs, transcript_exons, error)
    return coupling.prefer_graph(graph, own, ["sample", *report.EVENT])


def iso(spark: SparkSession, paths: list[str], error: int = ERROR) -> DataFrame:
    """Unique isoforms of long reads."""
    return isoforms.isoforms(isoforms.unify(inputs.reads(spark, paths), error))


def long_lines(annotated: DataFrame) -> DataFrame:
    """One line for each event and annotated exon, sorted and without repeats; events without one show NA."""
    exon = F.explode_outer("exons")
    rows = annotated.select("*", exon.alias("exon"))
    line = F.concat_ws("\t", tx.event_line(F.col("subtype")), F.col("is_novel").cast("int"), tx.joined(F.col("genes")), tx.joined(F.col("transcripts")), F.coalesce("exon", F.lit(tx.MISSING)), tx.ratio(F.col("psi")))
    return rows.select(line.alias("value")).distinct().orderBy("value")


def write_tables(found: DataFrame, out: str, counts: bool, ratios: bool, min_count: int) -> None:
    """Count matrix (no filter) and ratio matrices (filter within the sample only) beside the event table."""
    key = tx.junction_key().alias("key")
    if counts:
        report.write_matrix(found.groupBy(key, "sample").agg(F.sum("count").cast("string").alias("v")), f"{out}.junction_counts.tab")
    if ratios:
        kept = once(psi.with_psi(junctions.at_least(found, min_count)), "ratios")
        for side, name in (("start", "sameStart"), ("end", "sameEnd")):
            report.write_matrix(kept.select(key, "sample", F.when(F.col(f"psi_{side}").isNotNull(), tx.ratio(F.col(f"psi_{side}"))).alias("v")), f"{out}.{name}.PSI.tab")
