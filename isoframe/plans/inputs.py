"""Inputs of any supported format as reads or junctions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from isoframe.operators.junctions import count_junctions
from isoframe.sources import alignments, junction_files
from isoframe.sources.sniff import sniff

READS = {
    "bam": lambda s, p: alignments.to_reads(alignments.read_bam(s, p)),
    "sam": lambda s, p: alignments.to_reads(alignments.read_sam(s, p)),
    "gmap": alignments.read_alignment_text,
    "gmap_extract": alignments.read_extract,
}
JUNCTIONS = {"star": junction_files.read_star, "sj": junction_files.read_junctions}


def by_format(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p in paths:
        out.setdefault(sniff(spark, p), []).append(p)
    if unknown := out.get("unknown", []) + out.get("gff", []) + out.get("gtf", []):
        raise ValueError(f"not alignments or junctions: {', '.join(unknown)}")
    return out


def reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = by_format(spark, paths)
    if wrong := [p for k in JUNCTIONS for p in found.get(k, [])]:
        raise ValueError(f"junctions have no reads: {', '.join(wrong)}")
    return reduce(DataFrame.unionByName, [READS[k](spark, p) for k, p in found.items()])


def junctions(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = by_format(spark, paths)
    return reduce(DataFrame.unionByName, [JUNCTIONS[k](spark, p) if k in JUNCTIONS else count_junctions(READS[k](spark, p)) for k, p in found.items()])
