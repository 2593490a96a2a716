"""CIGAR strings and read structure, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the SAM format: operations that consume the reference, and the one that skips it.
CONSUMES, SKIP = ("M", "D", "N", "=", "X"), "N"


def walk(cigar: Column, pos: Column, kinds: tuple[str, ...] = (SKIP,)) -> Column:
    """``found``, the intervals of the operations of these kinds, and ``pos``, the place after the last base.

    One pass over the operations; keep the result as a column where both are used.
    """
    start = F.struct(pos.cast("int").alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc, x):
        op, n = F.substring(x, -1, 1), F.rtrim(x, F.lit("MIDNSHP=X")).cast("int")
        here = F.struct(acc["pos"].alias("start"), (acc["pos"] + n - 1).alias("end"))
        after = acc["pos"] + F.when(op.isin(*CONSUMES), n).otherwise(0)
        return F.struct(after.alias("pos"), F.when(op.isin(*kinds), F.concat(acc["found"], F.array(here))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), start, step)


def introns(cigar: Column, pos: Column) -> Column:
    """Skipped regions as an array of (start, end), first and last skipped base."""
    return walk(cigar, pos)["found"]


def read_end(cigar: Column, pos: Column) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{''.join(CONSUMES)}]"), F.lit(1))
    return F.aggregate(lengths, pos.cast("int"), lambda end, n: end + n.cast("int")) - 1


def blocks(cigar: Column, pos: Column) -> Column:
    """Aligned stretches (M, =, X), deletions and skips being gaps."""
    return walk(cigar, pos, ("M", "=", "X"))["found"]


def exons_of(start: Column, end: Column, gaps: Column) -> Column:
    """The exons between a read's introns, ends included; a read without introns is one exon."""
    ordered = F.array_sort(gaps)
    lefts = F.concat(F.array(start), F.transform(ordered, lambda g: g["end"] + 1))
    rights = F.concat(F.transform(ordered, lambda g: g["start"] - 1), F.array(end))
    return F.zip_with(lefts, rights, lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))


def sites_of(exons: Column) -> Column:
    """Exon boundaries, flattened."""
    return F.flatten(F.transform(exons, lambda x: F.array(x["start"], x["end"])))


def fuzzy_matches(reads: Column, others: Column, error: int) -> Column:
    """How many of the first sites have one of the second within ``error``."""
    return F.size(F.filter(reads, lambda r: F.exists(others, lambda g: F.abs(g - r) <= error)))


def read_strand(flag: Column) -> Column:
    """Strand of an alignment: of the mate for the first of a pair, else its own."""
    bit = lambda b: flag.bitwiseAND(b) != 0
    reverse = F.when(bit(1) & bit(64), bit(32)).otherwise(bit(16))
    return F.when(reverse, "-").otherwise("+")
