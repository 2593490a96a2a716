"""What keeps work from growing faster than the input: numbers of jobs, scans and shuffles, and rows that are compared."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from isoframe.operators import annotate, coverage, events, isoforms, psi, retention, terminal
from isoframe.plans import views
from isoframe.schemas import EXONS, JUNCTIONS, TRANSCRIPT_EXONS
from isoframe.scratch import written
from isoframe.sources import alignments


def test_isoform_segments_are_read_in_one_job(spark):
    df = spark.range(600).selectExpr("'s' AS sample", "concat('r', id) AS name", "'1' AS chromosome", "CAST(100 * id AS INT) AS start", "CAST(100 * id + 50 AS INT) AS end", "'+' AS strand")
    df = df.withColumn("exons", F.array(F.struct("start", "end")))
    spark.sparkContext.setJobGroup("segments", "segments")
    try:
        assert isoforms.unify(df, segments=24).where("name = leader").count() == 600
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("segments")) < 24


def test_isoform_fold_compares_near_rows_only(monkeypatch):
    ends = [(100, 200), (101, 201), (300, 400), (500, 600), (502, 602), (504, 604), (505, 605)]
    rows = [{"part": 0, "nth": i, "sample": "s", "name": f"r{i}", "chromosome": "1", "start": a, "end": b, "strand": "+", "exons": [{"start": a, "end": b}]} for i, (a, b) in enumerate(ends)]
    want, leader = [], None
    for i, row in enumerate(rows):
        leader = leader if leader is not None and isoforms.absorbs(rows[leader], row, 3, "any") else i
        want.append(leader)
    asked, absorbs = [], isoforms.absorbs
    monkeypatch.setattr(isoforms, "absorbs", lambda a, b, *more: asked.append(b["name"]) or absorbs(a, b, *more))
    batch = pa.RecordBatch.from_pylist(rows)
    for cut in range(1, len(rows)):
        walk, got = isoforms.Fold(3, "any", {}), []
        for piece in (batch.slice(0, cut), batch.slice(cut)):
            at, older = walk.take(piece)
            names = [*piece.column("name").to_pylist(), *(x["name"] for x in older)]
            got += [int(names[i][1:]) for i in np.asarray(at)]
        assert got == want
    assert asked.count("r2") == asked.count("r3") == 1  # where a batch begins with them


def test_region_records_decode_each_file_once(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('r', id) AS name", "0 AS flag", "'chr1' AS chromosome", "CAST(1 + 10 * id AS INT) AS pos", "'5M3N2I4M' AS cigar", "IF(id % 2 = 0, 1, NULL) AS nh")
    alignments.write_bam(rows, str(tmp_path / "b"), [("chr1", 1 << 20)])
    regions = spark.createDataFrame([("1", 995, 1009), ("chr1", 1000, 1031), ("chr1", 4991, 9000), ("chr1", 9, 3)], "chromosome string, start int, end int")
    found = alignments.region_records(spark, str(tmp_path / "b"), regions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isoframe_bam" not in plan and "BatchScan" not in plan
    assert sorted((r.pos, r.end, r.nh) for r in found.collect()) == [(991, 1002, None), (1001, 1012, 1), (1011, 1022, None), (1021, 1032, 1), (1031, 1042, None), (4981, 4992, 1), (4991, 5002, None)]


def exchanges(df) -> int:
    """Shuffles of the plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(" Exchange ")


def test_pairs_of_a_node_take_one_shuffle(spark):
    rows = [("s", "1", s, e, "+", s % 7 + 1) for s in (10, 20, 30) for e in (100, 105, 111)]
    j = psi.with_psi(spark.createDataFrame(rows, JUNCTIONS).localCheckpoint())
    got = events.same_start_pairs(j)
    assert sorted((r.S, r.e1, r.e2) for r in got.collect()) == [(s, *p) for s in (10, 20, 30) for p in ((100, 105), (100, 111), (105, 111))]
    assert all(abs(r.psi1 - 1 / 3) < 1e-9 and r.max_end == 111 for r in got.collect())
    assert exchanges(got) == 1
    # events are not shuffled once more to tell them apart
    found = events.all_events(spark.createDataFrame(rows, JUNCTIONS))
    keys = ["sample", "event", "chromosome", "start", "end", "strand", "sites"]
    assert "Deduplicate" not in found._jdf.queryExecution().analyzed().toString().split("Union")[0]
    assert found.count() == found.select(*keys).distinct().count() > 0


def test_depth_ratio_looks_up_each_border_once(spark, monkeypatch):
    asked, looked_up = [], coverage.looked_up
    watched = lambda points, *more: asked.append(points.count()) or looked_up(points, *more)
    for module in (coverage, retention):
        monkeypatch.setattr(module, "looked_up", watched, raising=False)
    introns = spark.createDataFrame([("a", "1", 100, 199), ("b", "1", 500, 520), ("c", "2", 5, 9)], "region string, chromosome string, start int, end int")
    blocks = spark.createDataFrame([("1", 90, 104), ("1", 190, 209), ("1", 90, 95), ("1", 510, 511)], "chromosome string, r_start int, r_end int")
    got = {r.region: r.psi for r in retention.depth_ratio(introns, blocks).collect()}
    assert got == {"a": 1 / (26 / 20), "b": None, "c": None}
    assert sum(asked) == 4 * 3


def test_junctions_are_counted_by_numbers(spark):
    """Of the keys that a task holds for each junction only the sample is text."""
    for by_sample, texts in ((False, 0), (True, 1)):
        plan = views.junctions(spark, "/root/testdata/sf0.001", by_sample)._jdf.queryExecution().optimizedPlan()
        while "Aggregate" not in plan.nodeName():
            plan = plan.children().apply(0)
        keys = plan.groupingExpressions()
        assert [keys.apply(i).dataType().simpleString() for i in range(keys.size())].count("string") == texts


def annotated_both_ways(spark, annotated, events_of):
    """The annotated events by (chromosome, strand, sites), and the shuffles; wide events are paired with exons to the same end."""
    exons = [
        ("1", 30, 45, "+", "x1", ["g2", "g1"], ["g2.1"]), ("1", 30, 44, "+", "x2", ["g3"], None), ("1", 70, 80, "+", "x3", ["g2"], ["g2.2", "g2.1"]),
        ("1", 72, 80, "-", "x4", ["g4"], ["g4.1"]), ("1", 31, 40, "-", "x5", None, ["g5.1"]), ("1", 31, 45, ".", "x6", ["g6"], ["g6.1"]),
        ("1", 300, 310, "+", "x7", ["g7"], ["g7.1"]), ("2", 30, 45, "+", "x8", ["g2"], ["g2.1"]), ("1", 45, 30, "+", "x9", ["g9"], ["g9.1"]), ("1", 3, 2000, "+", None, ["g1"], []),
    ]
    rows = [("s", kind, chromosome, lo, hi, strand, sites, 0.5) for kind, lo, hi, sites in events_of for chromosome in ("1", "3") for strand in "+-."]
    found = written(spark.createDataFrame(rows, "sample string, event string, chromosome string, start int, end int, strand string, sites array<int>, psi double"), "events")
    one, pairs = [annotated(found, spark.createDataFrame(exons, EXONS), bin_size=b) for b in (256, 8)]
    by = lambda df: {(r.chromosome, r.strand, tuple(r.sites)): r for r in df.select(*one.columns).collect()}
    got = by(one)
    assert len(got) == one.count() == len(rows) and got == by(pairs)
    assert all(r.is_novel and r.genes is r.transcripts is r.exons is None for r in got.values() if r.chromosome == "3")
    return {(strand, *sites): (r.is_novel, r.genes, r.transcripts, r.exons) for (chromosome, strand, sites), r in got.items() if chromosome == "1"}, exchanges(one)


def test_exclusive_events_are_shuffled_once(spark):
    a, b, c = (10, 28, 50, 65, 85, 100), (10, 31, 46, 200, 205, 220), (10, 46, 50, 69, 81, 100)
    got, shuffles = annotated_both_ways(spark, annotate.annotate_exclusive, [("MXE", s[0], s[5], list(s)) for s in (a, b, c)])
    assert got["+", *a] == got[".", *a] == (False, ["g2"], ["g2.1", "g2.2"], ["x1", "x3"])
    assert got["-", *a] == got["-", *b] == (True, [], ["g5.1"], ["x5"])
    assert got["+", *b] == (True, None, None, None) and got[".", *b] == (True, ["g6"], ["g5.1", "g6.1"], ["x5", "x6"])
    assert got["+", *c] == (True, ["g2"], ["g2.1", "g2.2"], ["x3"]) and got[".", *c] == (True, ["g2", "g4"], ["g2.1", "g2.2", "g4.1"], ["x3", "x4"])
    assert shuffles <= 3


def test_alternative_events_are_shuffled_once(spark):
    a, b, c = (10, 10, 27, 60), (48, 83, 100, 100), (5, 200, 210, 210)
    got, shuffles = annotated_both_ways(spark, annotate.annotate_alternative, [("A3", 27, 60, list(a)), ("A5", 48, 83, list(b)), ("A5", 5, 200, list(c))])
    assert got["+", *a] == got[".", *a] == (False, ["g1", "g2", "g3"], ["g2.1"], ["x1", "x2"])
    assert got["+", *b] == (False, ["g1", "g2"], ["g2.1", "g2.2"], ["x1", "x3"]) and got["-", *b] == (False, ["g4"], ["g4.1"], ["x4"])
    assert got["-", *a] == got["+", *c] == got["-", *c] == (True, None, None, None)
    assert shuffles <= 3


def test_terminal_exons_are_sent_nowhere_whole(spark):
    """Second exons without a join of their own, events in one shuffle; nothing is broadcast, however small the files."""
    placed = [(t, "g", "1", a, b, strand, f"{t}{a}") for strand, name in (("+", "p"), ("-", "m")) for t, outer in ((f"{name}1", 500), (f"{name}2", 900)) for a, b in ((100, 150), (300, 350), (outer, outer + 50))]
    placed += [placed[1], (None, "g", "1", 300, 350, "+", "x"), ("q1", "g", "1", 40, 50, "+", "y"), ("q1", "g", "1", 300, 352, "+", "z")]
    exons = spark.createDataFrame(placed, TRANSCRIPT_EXONS).localCheckpoint()
    edges = {(r.strand, r.start, r.end): (sorted(r.first_ends), sorted(r.last_starts)) for r in terminal.second_exons(exons).collect()}
    assert edges == {("+", 300, 350): ([150, 150], [500, 900]), ("+", 300, 352): ([50], [300]), ("-", 300, 350): ([150, 150], [500, 900])} and exchanges(terminal.second_exons(exons)) == 2
    alt = [(kind, a, b, strand, [351, 351, a, b]) for kind, a, b in (("A3", 499, 899), ("A3", 496, 899)) for strand in "+-."] + [("A3", 497, 903, "+", [347, 347, 497, 903]), ("SE", 500, 900, "+", [350, 350, 500, 900]), ("A5", 149, 150, "+", [149, 150, 299, 299])]
    found = spark.createDataFrame([("s", kind, "1", a, b, strand, sites) for kind, a, b, strand, sites in [*alt, alt[0]]], "sample string, event string, chromosome string, start int, end int, strand string, sites array<int>").localCheckpoint()
    for bin_size in (256, 5):
        out = terminal.terminal_subtypes(found, exons, bin_size)
        assert sorted((r.strand, r.start, r.terminal) for r in out.collect()) == [("+", 149, "AFE"), ("+", 497, "ALE"), ("+", 499, "ALE"), ("-", 499, "AFE"), (".", 499, "ALE")]
        assert exchanges(out) <= 5 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
