"""Which annotated exons an event falls on, and what that makes of it.

Events and exons meet in a binned interval join, A3, A5 and MXE of usual width in one look-up for each event; an event without an
exon stays, as novel, with null sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.operators.interval_join import BIN, beside, both_strands, interval_join
from isoframe.schemas import EVENT_KEY
from isoframe.scratch import once

#: How far a splice site may lie from an annotated edge; fixed, whatever the error of the detection.
NEAR = 3


def _right(exons: DataFrame) -> DataFrame:
    return exons.select("chromosome", F.col("strand").alias("join_strand"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "exon_id", "genes", "transcripts")


def _sets(*more):
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return [flat("genes").alias("genes"), flat("transcripts").alias("transcripts"), F.array_sort(F.collect_set("exon_id")).alias("exons"), *more]


def _onto(events: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Left join of what was found back onto the events."""
    out = events.join(found, key, "left")
    return out.withColumns({"is_novel": F.coalesce("is_novel", F.lit(True)), "subtype": F.coalesce("subtype", F.lit("NA"))})


def annotate_skipped(events: DataFrame, exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """SE events with the exons inside [e1, s1].

    Each exon is exact (both edges next to the site, within a base), part (one edge) or other. One kind and set of
    transcripts gives the kind; several give single (all of one set of transcripts) or multi; none gives NA.
    """
    events = once(events, "skipped")
    pairs = interval_join(both_strands(events.select(*key)), _right(exons), ["chromosome", "join_strand"], bin_size, condition=(F.col("start") <= F.col("r_start")) & (F.col("end") >= F.col("r_end")))
    at = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= 1).cast("int")
    near = at("start", "r_start") + at("end", "r_end")
    kind = F.when(near == 2, "exact").when(near == 1, "part").otherwise("other")
    entry = F.struct(kind.alias("kind"), F.array_sort("transcripts").alias("of"))
    found = pairs.groupBy(*key).agg(*_sets(F.collect_set(entry).alias("entries")))
    subtype = F.when(F.size("entries") == 1, F.element_at("entries", 1)["kind"]).when(F.size(F.array_distinct(F.col("entries.of"))) == 1, "single").otherwise("multi")
    return _onto(events, found.withColumns({"subtype": subtype, "is_novel": F.lit(False)}).drop("entries"), key)


def _site(i: int) -> Column:
    """The i-th site, from 1; null if there are fewer."""
    return F.get("sites", i - 1)


def _with_found(events: DataFrame, exons: DataFrame, lo: Column, hi: Column, slack: int, test: Callable[[Column, Column], Column], bin_size: int, reach: int, key: list[str]) -> DataFrame:
    """Written events with ``found``: the exons with an edge in [lo, hi], give or take ``slack``, that pass ``test`` of their edges.

    An event no wider than ``reach`` is shuffled once, to where the exons of its cell are; wider ones, if there are any, are paired
    with exons, grouped and joined back.
    """
    lo, hi = lo.cast("long") - slack, hi.cast("long") + slack
    close = F.coalesce(hi - lo <= reach, F.lit(False))
    # an exon is looked for on its strand, and among events without one
    without = events.where("strand = '.'").agg(F.count(F.lit(1)) > 0).scalar()
    strands = F.when(without & F.col("join_strand").isin("+", "-"), F.array(F.col("join_strand"), F.lit("."))).otherwise(F.array("join_strand"))
    # sets as arrays without null, which are then read off an array of exons without a lambda
    none = F.array().cast("array<string>")
    of = {"genes": F.coalesce("genes", none), "transcripts": F.coalesce("transcripts", none), "exon_id": F.when(F.col("exon_id").isNotNull(), F.array("exon_id")).otherwise(none)}
    right = _right(exons.withColumns(of)).where("r_end >= r_start")
    one = beside(events.where(close).withColumn("join_strand", F.col("strand")), right.withColumn("join_strand", F.explode(strands)), ["chromosome", "join_strand"], lo, ["r_start", "r_end"], reach)
    out = one.withColumn("found", F.filter("beside", lambda x: test(x["r_start"], x["r_end"]))).drop("beside", "join_strand")
    wide = events.where(~close)
    if wide.isEmpty():
        return out
    pairs = interval_join(both_strands(wide.select(*key)), right, ["chromosome", "join_strand"], bin_size, slack=slack, condition=test(F.col("r_start"), F.col("r_end")))
    lists = pairs.groupBy(*key).agg(F.collect_list(F.struct("r_start", "r_end", "exon_id", "genes", "transcripts")).alias("found"))
    return out.unionByName(wide.join(lists, key, "left"))


def _sets_of(found: Column) -> list[Column]:
    """Genes, transcripts and exons of an array of exons, as sorted sets."""
    flat = lambda name: F.array_sort(F.array_distinct(F.flatten(found[name])))
    return [flat("genes").alias("genes"), flat("transcripts").alias("transcripts"), flat("exon_id").alias("exons")]


def annotate_alternative(events: DataFrame, exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """A3 and A5 events with the exons whose edge lies within NEAR of one of the alternative sites."""
    events = once(events, "alternative")
    same_start = _site(1) == _site(2)
    near = lambda i, edge: F.abs(_site(i) - edge) <= NEAR
    test = lambda start, end: F.when(same_start, near(3, start) | near(4, start)).otherwise(near(1, end) | near(2, end))
    lo, hi = F.when(same_start, _site(3)).otherwise(_site(1)), F.when(same_start, _site(4)).otherwise(_site(2))
    found = _with_found(events, exons, F.least(lo, hi), F.greatest(lo, hi), NEAR, test, bin_size, bin_size, key)
    any_found = F.coalesce(F.size("found") > 0, F.lit(False))
    out = found.withColumn("found", F.when(any_found, F.col("found")))
    return out.select(*events.columns, *_sets_of(F.col("found")), F.lit("NA").alias("subtype"), F.col("found").isNull().alias("is_novel"))


def annotate_exclusive(events: DataFrame, exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """MXE events. If exons of one gene lie in both skipped regions, those of the first such gene support the event.

    Otherwise the exons of the first region, or else of the second, are listed and the event stays novel.
    """
    events = once(events, "exclusive")
    inside = lambda a, b: lambda start, end: (_site(a) <= start) & (_site(b) >= end)
    test = lambda start, end: inside(2, 3)(start, end) | inside(4, 5)(start, end)
    exons = exons.withColumn("genes", F.array_compact("genes"))
    found = _with_found(events, exons, F.least(_site(2), _site(4)), F.greatest(_site(3), _site(5)), 0, test, bin_size, 2 * bin_size, key)
    within = lambda a, b: F.filter("found", lambda x: inside(a, b)(x["r_start"], x["r_end"]))
    found = found.withColumns({"in1": within(2, 3), "in2": within(4, 5)})
    found = found.withColumn("best", F.array_min(F.array_intersect(F.flatten("in1.genes"), F.flatten("in2.genes"))))
    # exons of the best gene, else of the first region if it has any, else of the second
    chosen = F.when(F.col("best").isNotNull(), F.filter("found", lambda x: F.array_contains(x["genes"], F.col("best")))).when(F.size("in1") > 0, F.col("in1")).when(F.size("found") > 0, F.col("found"))
    found = found.withColumn("found", chosen)
    genes, transcripts, ids = _sets_of(F.col("found"))
    only = F.when(F.col("best").isNotNull(), F.array("best")).otherwise(genes).alias("genes")
    return found.select(*events.columns, only, transcripts, ids, F.lit("NA").alias("subtype"), F.col("best").isNull().alias("is_novel"))


def _part(written_events: DataFrame, test: str) -> DataFrame:
    """Some of the events of a written table, which is as cheap to read again."""
    out = written_events.where(test)
    out.isoframe_path = written_events.isoframe_path
    return out


def annotate(events: DataFrame, exons: DataFrame, bin_size: int = BIN, key: list[str] = EVENT_KEY) -> DataFrame:
    """Every event by the rule of its type; types without one pass through unannotated, as novel."""
    events = once(events, "events")
    of = lambda test: _part(events, test)
    out = annotate_skipped(of("event = 'SE'"), exons, bin_size, key)
    out = out.unionByName(annotate_alternative(of("event IN ('A3', 'A5')"), exons, bin_size, key))
    out = out.unionByName(annotate_exclusive(of("event = 'MXE'"), exons, bin_size, key))
    rest = events.where("event NOT IN ('SE', 'A3', 'A5', 'MXE')")
    empty = F.lit(None).cast("array<string>")
    return out.unionByName(rest.withColumns({"genes": empty, "transcripts": empty, "exons": empty, "subtype": F.lit("NA"), "is_novel": F.lit(True)}))
