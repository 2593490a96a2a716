"""Interval join by bins of several widths: an equi-join that hash-partitions, where a range condition alone would not.

Bins of a level are FACTOR times as wide as those of the level below. An interval's own level is the first whose bins are as
long as it is, so that it touches two of them at most, there and above. A pair meets at the higher of its two levels. So an
interval is dealt to two bins at most for each level that the data has from its own on: one of a whole chromosome is two rows,
not one for every bin of the narrowest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest bins.
BIN = 256
FACTOR_BITS, LEVELS = 4, 7


def level_of(length: Column, bin_size: int = BIN) -> Column:
    """The first level whose bins have ``length`` bases or more."""
    steps = [(length > (bin_size << FACTOR_BITS * k)).cast("int") for k in range(LEVELS - 1)]
    out = steps[0]
    for s in steps[1:]:
        out = out + s
    return out


def bin_of(place: Column, level: Column, bin_size: int = BIN) -> Column:
    return F.floor(place / (F.lit(bin_size).cast("long") * F.pow(F.lit(1 << FACTOR_BITS), level).cast("long")))


def dealt(df: DataFrame, lo: Column, hi: Column, found: Column, bin_size: int) -> DataFrame:
    """``df`` with __lo, __hi, __own (its level), and a row for each __level of ``found`` from there on and __bin it touches."""
    out = df.withColumns({"__lo": lo, "__hi": hi}).withColumn("__own", level_of(F.col("__hi") - F.col("__lo") + 1, bin_size))
    out = out.withColumn("__level", F.explode(found)).where("__level >= __own")
    first, last = bin_of(F.col("__lo"), F.col("__level"), bin_size), bin_of(F.col("__hi"), F.col("__level"), bin_size)
    return out.withColumn("__bin", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], bin_size: int = BIN, slack: int = 0, condition: Column | None = None) -> DataFrame:
    """Pairs whose intervals, the left one widened by ``slack``, share a base and that agree on ``on``.

    Left needs start and end, right r_start and r_end, and no other common column than ``on``. A pair is kept only in the bin
    where both are first together, so none is repeated. ``condition`` is any further test. Invalid or null intervals meet
    nothing. Which levels the data has is found by a subquery over both sides' lengths, so a side that is dear to make should
    be written first. Both sides are shuffled, whatever their files measure: rows are dealt to bins after the scan, which no estimate
    knows, and a side taken for small would go whole through the driver. Skewed keys are split by the adaptive sort-merge join.
    """
    a, b = left.where("end >= start"), right.where("r_end >= r_start")
    lo, hi = F.col("start") - slack, F.col("end") + slack
    levels = a.select(level_of(hi - lo + 1, bin_size).alias("x")).unionAll(b.select(level_of(F.col("r_end") - F.col("r_start") + 1, bin_size).alias("x")))
    found = levels.agg(F.collect_set("x")).scalar()
    a = dealt(a, lo, hi, found, bin_size)
    b = dealt(b, F.col("r_start"), F.col("r_end"), found, bin_size).drop("__lo", "__hi").withColumnRenamed("__own", "__other")
    joined = a.join(b.hint("merge"), [*on, "__level", "__bin"]).where("__lo <= r_end AND __hi >= r_start AND __level = greatest(__own, __other)")
    joined = joined.where(F.col("__bin") == bin_of(F.greatest("__lo", "r_start"), F.col("__level"), bin_size))
    if condition is not None:
        joined = joined.where(condition)
    return joined.drop("__lo", "__hi", "__own", "__other", "__level", "__bin")


def similar_join(left: DataFrame, right: DataFrame, on: list[str], percent: float, condition: Column, around: str = "right", known: bool = False) -> DataFrame:
    """Pairs that share ``percent`` (more than 0) of their hull, or a little less, and pass ``condition``.

    Columns as in ``interval_join``; lengths are end - start. What shares a part p of its hull differs in length by 1/p at most,
    and its starts lie within (1/p - 1) times either length. So one side is dealt to one (band of lengths, cell of starts)
    each, and the side named by ``around`` looks into the bands and cells next to its own: nine, whatever else overlaps there.
    With ``known`` it looks only into bands that the other side has, which is read once more for that. Both sides are shuffled,
    as in ``interval_join``.
    """
    p = min(percent, 99.0) / 100
    step = -math.log(p) * (1 + 1e-6)  # so that rounding cannot put a pair two bands apart
    length = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1))
    band = lambda a, b: F.floor(F.log(length(a, b).cast("double")) / step).cast("int")
    # cells of a band are as wide as starts of its longest may lie apart
    width = lambda k: F.ceil(F.exp((k + 1) * step) * (1 / p - 1)).cast("long") + 1
    cell = lambda place, k: F.floor(F.col(place) / width(k)).cast("long")
    next_to = lambda c: F.sequence(c - 1, c + 1)
    sides = {"left": (left.where("end >= start"), "start", "end"), "right": (right.where("r_end >= r_start"), "r_start", "r_end")}
    wide, wide_from, wide_to = sides.pop(around)
    [(one, one_from, one_to)] = sides.values()
    one = one.withColumn("__band", band(one_from, one_to))
    bands = next_to(band(wide_from, wide_to))
    if known:
        bands = F.array_intersect(bands, one.agg(F.collect_set("__band")).scalar())
    one = one.withColumn("__cell", cell(one_from, F.col("__band")))
    wide = wide.withColumn("__band", F.explode(bands))
    wide = wide.withColumn("__cell", F.explode(next_to(cell(wide_from, F.col("__band")))))
    a, b = (wide, one) if around == "left" else (one, wide)
    return a.join(b.hint("merge"), [*on, "__band", "__cell"]).where(condition).drop("__band", "__cell")


def beside(left: DataFrame, right: DataFrame, on: list[str], at: Column, places: list[str], width: int) -> DataFrame:
    """``left`` with ``beside``: the rows of ``right`` that have one of their ``places`` in [at, at + width], and more from around there.

    They come as an array of structs, null where there is none; what of it is meant is for the caller to test. A row of left is
    looked up once and stays one row: no pairs, and nothing to be grouped and joined back. Rows of right are dealt to two cells for
    each of their places, and both sides are shuffled.
    """
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    cells = F.array_distinct(F.flatten(F.array(*[F.array(cell(F.col(p)) - 1, cell(F.col(p))) for p in places])))
    row = F.struct(*[c for c in right.columns if c not in on])
    lists = right.withColumn("__cell", F.explode(cells)).groupBy(*on, "__cell").agg(F.collect_list(row).alias("beside"))
    return left.withColumn("__cell", cell(at)).join(lists.hint("merge"), [*on, "__cell"], "left").drop("__cell")


def both_strands(df: DataFrame) -> DataFrame:
    """Rows without a strand count for either: ``join_strand`` is the strand to join on."""
    either = F.when(F.col("strand") == ".", F.array(F.lit("+"), F.lit("-"), F.lit("."))).otherwise(F.array("strand"))
    return df.withColumn("join_strand", F.explode(either))
