"""Wide outputs: event table, matrices, and the text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.functions import text as tx
from isoframe.scratch import once

EVENT = ["event", "chromosome", "start", "end", "strand", "sites"]


def events_of_all(annotated: DataFrame, *more: Column) -> DataFrame:
    """One row for each event over all samples: what it is and what annotates it, sets united over samples."""
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))
    return annotated.withColumn("key", F.struct(*EVENT)).groupBy("key").agg(
        F.array_sort(F.collect_set(F.nullif("subtype", F.lit("NA")))).alias("subtypes"),
        F.min(F.col("is_novel").cast("int")).alias("novel"),
        *[flat(c).alias(c) for c in ("genes", "transcripts", "exons")],
        *more,
    ).select("key.*", "*")


def _shown() -> list[Column]:
    return [
        tx.event_range().alias("spliceRange"),
        F.col("event").alias("spliceType"),
        tx.joined(F.col("subtypes")).alias("subtype"),
        tx.event_sites().alias("spliceSites"),
        F.col("novel").alias("isNovel"),
        tx.joined(F.col("genes")).alias("gene"),
        tx.joined(F.col("transcripts")).alias("transcript"),
        tx.joined(F.col("exons")).alias("exon"),
    ]


def samples_of(df: DataFrame) -> list[str]:
    return sorted(r[0] for r in df.select("sample").distinct().collect())


def event_table(annotated: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """One row for each event over all samples: what it is, what annotates it, and its ratio in each sample.

    Sets are united over samples; a sample without the event shows NA. A column for each sample: of very many,
    ``write_events`` makes lines instead.
    """
    if samples is None:
        annotated = once(annotated, "annotated")
        samples = samples_of(annotated)
    # ratios by sample are one map, so that sets and ratios come from one grouping
    ratios = F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("psi").isNotNull(), F.struct("sample", "psi")))))
    named = events_of_all(annotated, ratios.alias("ratios"))
    return named.select(*_shown(), *[tx.ratio(F.try_element_at("ratios", F.lit(c))).alias(c) for c in samples])


def filled(cells: Column, n: int) -> Column:
    """Text of ``n`` tab-separated cells from those (i, v) that there are, NA for the others; work grows with the text only."""
    cells = F.array_sort(cells)
    before = F.concat(F.array(F.lit(-1)), F.transform(cells, lambda x: x["i"]))
    gap = lambda k: F.repeat(F.lit(f"{tx.MISSING}\t"), k)
    parts = F.zip_with(cells, F.slice(before, 1, F.size(cells)), lambda x, p: F.concat(gap(x["i"] - p - 1), x["v"]))
    rest = F.repeat(F.lit(f"\t{tx.MISSING}"), F.lit(n - 1) - F.element_at(before, -1))
    return F.when(F.size(cells) > 0, F.concat(F.array_join(parts, "\t"), rest)).otherwise(F.lit("\t".join([tx.MISSING] * n)))


def _numbered(rows: DataFrame, samples: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place of the sample; one short row for each sample is sent to all."""
    places = rows.sparkSession.createDataFrame(list(enumerate(samples)), "i int, sample string")
    return rows.join(F.broadcast(places), "sample")


def matrix_lines(cells: DataFrame, samples: list[str]) -> DataFrame:
    """(line): key and a cell for each sample, of cells (key, sample, v as text); any number of samples."""
    rows = _numbered(cells.where("v IS NOT NULL"), samples)
    return rows.groupBy("key").agg(F.collect_list(F.struct("i", "v")).alias("cells")).select(F.concat_ws("\t", "key", filled(F.col("cells"), len(samples))).alias("line"))


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Lines under a header with a ``#`` before it."""
    lines.select(F.col("line").alias(f"#{header}")).write.mode("overwrite").option("sep", "\x02").option("header", True).option("quote", "").option("comment", "\x01").csv(path)


def write_matrix(cells: DataFrame, path: str) -> None:
    """A matrix of junctions by samples."""
    cells = once(cells, "cells")
    samples = samples_of(cells)
    write_lines(matrix_lines(cells, samples), "\t".join(["junctions", *samples]), path)


def write_events(annotated: DataFrame, path: str) -> None:
    """The event table as text, for any number of samples."""
    annotated = once(annotated, "annotated")
    samples = samples_of(annotated)
    cells = F.array_distinct(F.collect_list(F.when(F.col("psi").isNotNull(), F.struct("i", tx.ratio(F.col("psi")).alias("v")))))
    named = events_of_all(_numbered(annotated, samples), cells.alias("cells"))
    shown = _shown()
    names = ["spliceRange", "spliceType", "subtype", "spliceSites", "isNovel", "gene", "transcript", "exon"]
    line = F.concat_ws("\t", *[c.cast("string") for c in shown], filled(F.col("cells"), len(samples)))
    write_lines(named.select(line.alias("line")), "\t".join([*names, *samples]), path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header whose first name carries a ``#``; folders are made as needed.

    The writer quotes what starts with its comment sign, so that is set to one that does not occur.
    """
    first = df.columns[0]
    df.withColumnRenamed(first, f"#{first}").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("comment", "\x01").csv(path)


def write_junctions(junctions: DataFrame, path: str) -> None:
    """Junction text, a folder for each sample."""
    junctions.select("sample", tx.junction_line().alias("value")).write.mode("overwrite").partitionBy("sample").text(path)


def write_gtf(lines: DataFrame, path: str) -> None:
    """Lines in genomic order, each isoform's together."""
    ordered = lines.repartitionByRange("chromosome", "start", "end", "name").sortWithinPartitions("chromosome", "start", "end", "name", "nth")
    ordered.select("value").write.mode("overwrite").text(path)


def with_missing(matrix: DataFrame, key: str, digits: bool = False) -> DataFrame:
    """A matrix as text, NA where a cell is null."""
    cell = lambda c: tx.ratio(F.col(f"`{c}`")) if digits else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(tx.MISSING))
    return matrix.select(key, *[cell(c).alias(c) for c in matrix.columns if c != key])
