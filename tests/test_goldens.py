"""Small worked examples of every operator, and properties that hold for any input."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoframe.functions import cigar as cg
from isoframe.functions import intervals as iv
from isoframe.operators import annotate, coupling, events, isoforms, junctions, psi, report, retention
from isoframe.operators.interval_join import dealt, interval_join, similar_join
from isoframe.operators.ordered import with_next
from isoframe.schemas import EXONS, JUNCTIONS


def graph(spark, rows, strand="+", sample="a"):
    return spark.createDataFrame([(sample, "1", s, e, strand, c) for s, e, c in rows], JUNCTIONS)


G1 = [(100, 200, 30), (300, 400, 10), (100, 400, 20)]


def found(df):
    return {(r.event, tuple(r.sites)): r.psi and round(r.psi, 6) for r in df.collect()}


@pytest.mark.parametrize(("strand", "left", "right"), [("+", "A3", "A5"), ("-", "A5", "A3")])
def test_skipped_exon(spark, strand, left, right):
    assert found(events.all_events(graph(spark, G1, strand))) == {
        ("SE", (100, 200, 300, 400)): 0.466667, (left, (100, 100, 200, 400)): 0.6, (right, (100, 300, 400, 400)): 0.333333,
    }


def test_mutually_exclusive(spark):
    got = found(events.all_events(graph(spark, [(100, 200, 12), (300, 600, 8), (100, 400, 4), (500, 600, 24)])))
    assert got == {("A3", (100, 100, 200, 400)): 0.75, ("A5", (300, 500, 600, 600)): 0.75, ("MXE", (100, 200, 300, 400, 500, 600)): 0.5}


def test_error_is_closed_at_starts_only(spark):
    got = found(events.all_events(graph(spark, [(100, 200, 5), (100, 203, 5), (500, 900, 5), (503, 900, 5)])))
    assert list(got) == [("A3", (100, 100, 200, 203))]


T1, T2 = ["T1"], ["T2"]


@pytest.mark.parametrize(
    ("exons", "subtype"),
    [
        ([(201, 299, T1)], "exact"), ([(201, 280, T1)], "part"), ([(220, 280, T1)], "other"), ([(201, 240, T1), (250, 260, T1)], "single"),
        ([(201, 240, T1), (260, 299, T1)], "part"), ([(201, 240, T1), (260, 299, T2)], "multi"), ([], "NA"),
    ],
)
def test_subtypes(spark, exons, subtype):
    rows = [("1", s, e, "+", f"x{s}", ["A"], t) for s, e, t in exons]
    out = annotate.annotate_skipped(events.skipped_exons(psi.with_psi(graph(spark, G1))), spark.createDataFrame(rows, EXONS)).collect()
    assert [(r.subtype, r.is_novel) for r in out] == [(subtype, not exons)]


def test_no_strand_meets_both(spark):
    rows = [("1", 201, 299, s, f"x{s}", ["A"], T1) for s in "+-"]
    out = annotate.annotate_skipped(events.skipped_exons(psi.with_psi(graph(spark, G1, "."))), spark.createDataFrame(rows, EXONS)).first()
    assert out.exons == ["x+", "x-"]


def test_overall_filter_and_matrix(spark):
    both = graph(spark, [(100, 200, 2)]).unionByName(graph(spark, [(100, 200, 1), (100, 300, 9)], sample="b"))
    assert [(r.start, r.end) for r in junctions.drop_low_overall(both, 4).collect()] == [(100, 300)]
    matrix = report.with_missing(junctions.count_matrix(junctions.drop_low_overall(both, 4), ["a", "b"]), "junction")
    assert [tuple(r) for r in matrix.collect()] == [("1:100-300+", "NA", "9")]


def test_cigar(spark):
    df = spark.createDataFrame([("10M5N10M3D2M4I6M", 100), ("*", 7), (None, 7)], "c string, p int")
    got = df.select(cg.introns(F.col("c"), F.col("p")).alias("i"), cg.read_end(F.col("c"), F.col("p")).alias("e"), cg.blocks(F.col("c"), F.col("p")).alias("b")).collect()
    assert [tuple(x) for x in got[0].i] == [(110, 114)]
    assert got[0].e == 135
    assert [tuple(x) for x in got[0].b] == [(100, 109), (115, 124), (128, 129), (130, 135)]
    assert got[1].i == []
    assert got[2].i is None


def test_read_strand(spark):
    df = spark.createDataFrame([(0,), (16,), (99,), (147,)], "f int")
    assert [r[0] for r in df.select(cg.read_strand(F.col("f"))).collect()] == ["+", "-", "-", "-"]


def test_exons_of_a_read(spark):
    df = spark.sql("SELECT 50 AS s, 450 AS e, array(named_struct('start', 100, 'end', 199), named_struct('start', 300, 'end', 399)) AS i")
    assert [tuple(x) for x in df.select(cg.exons_of(F.col("s"), F.col("e"), F.col("i")).alias("x")).first().x] == [(50, 99), (200, 299), (400, 450)]


def test_interval_predicates(spark):
    df = spark.createDataFrame([(100, 200, 200, 300), (100, 200, 199, 300), (100, 200, 150, 250)], "a int, b int, c int, d int")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = df.select(iv.overlaps_within(a, b, c, d), iv.overlaps(a, b, c, d), *[F.round(iv.overlap_percent(a, b, c, d, m), 3) for m in ("self", "hull", "narrow")]).collect()
    assert [r[0] for r in got] == [False, True, True]
    assert all(r[1] for r in got)
    assert tuple(got[2])[2:] == (50.0, 33.333, 50.0)
    assert spark.range(1).select(iv.overlap_percent(*[F.lit(5)] * 4)).first()[0] is None
    assert spark.range(1).select(iv.chromosome(F.lit("chr1")), iv.chromosome(F.lit("1chr")), iv.strand(F.lit("x"))).first()[:] == ("1", "1chr", ".")


def test_depth_ratio(spark):
    region = spark.createDataFrame([("r", "1", 101, 200), ("none", "2", 101, 200)], "region string, chromosome string, start int, end int")
    blocks = spark.createDataFrame([("1", 101, 200)] * 4 + [("1", 81, 100)] * 8 + [("1", 201, 220)] * 8, "chromosome string, r_start int, r_end int")
    assert dict(retention.depth_ratio(region, blocks).collect()) == {"r": 0.5, "none": None}


def reads(spark, rows):
    df = spark.createDataFrame([("a", n, "1", s, e, "+", i) for n, s, e, i in rows], "sample string, name string, chromosome string, start int, end int, strand string, introns array<struct<start:int,end:int>>")
    return df.withColumn("exons", cg.exons_of(F.col("start"), F.col("end"), F.col("introns")))


@pytest.mark.parametrize(("third", "leaders"), [((200, 900, [(300, 399)]), {"A": "A", "B": "A", "C": "C"}), ((100, 900, [(200, 299)]), {"A": "A", "C": "C", "B": "B"})])
def test_isoforms(spark, third, leaders):
    df = reads(spark, [("A", 100, 500, [(200, 299)]), ("B", 101, 501, [(200, 299)]), ("C", *third)])
    assert {r.name: r.leader for r in isoforms.unify(df).collect()} == leaders
    lines = [r.value.split("\t") for r in isoforms.to_gtf(isoforms.isoforms(isoforms.unify(df))).collect()]
    assert {len(x) for x in lines} == {9}


def test_coupling(spark):
    t = spark.createDataFrame([("T", "G", "1", "+", 100, 400, [(100, 200, "x"), (300, 400, "y")])], "transcript string, gene string, chromosome string, strand string, start int, end int, exons array<struct<start:int,end:int,exon_id:string>>")
    df = reads(spark, [("hit", 101, 400, [(202, 298)]), ("far", 1000, 1400, [(1100, 1200)])])
    pairs = coupling.couple(t, df)
    assert [r.name for r in pairs.collect()] == ["hit"]
    assert [r.name for r in coupling.novel_reads(df, pairs).collect()] == ["far"]


def test_retained_intron(spark):
    ev = spark.createDataFrame([("a", "1", "+", 10, 100), ("a", "1", "+", 200, 300)], "sample string, chromosome string, strand string, start int, end int")
    ex = spark.createDataFrame([("T", "G", "1", 50, 101, "+", "x"), ("T", "G", "1", 200, 250, "+", "y")], "transcript string, gene string, chromosome string, start int, end int, strand string, exon_id string")
    out = retention.retained_introns(ev, ex, 90).first()
    assert (out.start, out.end, out.sites, out.intron_start, out.intron_end) == (100, 200, [100, 101, 200, 200], 102, 199)


spans = st.lists(st.tuples(st.integers(1, 300), st.integers(0, 60)), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spans, spans, st.sampled_from([1, 7, 64, 4096]), st.integers(0, 4))
def test_interval_join_is_the_plain_one(spark, left, right, bin_size, slack):
    a = spark.createDataFrame([(i, s, s + n) for i, (s, n) in enumerate(left)], "i int, start int, end int").withColumn("c", F.lit("1"))
    b = spark.createDataFrame([(i, s, s + n) for i, (s, n) in enumerate(right)], "j int, r_start int, r_end int").withColumn("c", F.lit("1"))
    want = sorted((i, j) for i, (s, n) in enumerate(left) for j, (x, m) in enumerate(right) if s - slack <= x + m and s + n + slack >= x)
    assert sorted((r.i, r.j) for r in interval_join(a, b, ["c"], bin_size, slack).collect()) == want


def test_a_long_interval_is_a_few_rows(spark):
    """One of 250 Mb beside short ones: two bins at most for each level in use, and every pair."""
    short = [(1 + 50_000 * i, 1 + 50_000 * i + 90) for i in range(4000)]
    a = spark.createDataFrame([(1, 250_000_000), *short[:50]], "start int, end int").withColumn("c", F.lit("1"))
    b = spark.createDataFrame([*short, (5, 249_000_000)], "r_start int, r_end int").withColumn("c", F.lit("1"))
    assert interval_join(a, b, ["c"]).count() == 4001 + 50 + 50
    levels = spark.range(1).select(F.array(F.lit(0), F.lit(5)).alias("x")).select(F.explode("x").alias("x")).agg(F.collect_set("x")).scalar()
    rows = dealt(a.where("end - start > 1000000"), F.col("start"), F.col("end"), levels, 256)
    assert rows.count() <= 2
    assert dealt(b.where("r_start > 1000"), F.col("r_start"), F.col("r_end"), levels, 256).count() <= 4 * 4000


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 400), st.sampled_from([0, 1, 9, 10, 90, 99, 100, 101, 111, 300])), max_size=30), st.lists(st.tuples(st.integers(1, 400), st.sampled_from([0, 1, 8, 9, 81, 90, 100, 110, 280])), max_size=30), st.sampled_from([1.0, 50.0, 60.0, 90.0, 99.0, 100.0]))
def test_similar_intervals_are_all_found(spark, left, right, percent):
    a = spark.createDataFrame([(i, s, s + n) for i, (s, n) in enumerate(left)], "i int, start int, end int").withColumn("c", F.lit("1"))
    b = spark.createDataFrame([(i, s, s + n) for i, (s, n) in enumerate(right)], "j int, r_start int, r_end int").withColumn("c", F.lit("1"))
    inner = F.least("end", "r_end") - F.greatest("start", "r_start")
    hull = F.greatest("end", "r_end") - F.least("start", "r_start")
    share = lambda s, n, x, m: 100 * (min(s + n, x + m) - max(s, x)) >= percent * (max(s + n, x + m) - min(s, x)) and max(n, m) > 0
    want = sorted((i, j) for i, (s, n) in enumerate(left) for j, (x, m) in enumerate(right) if share(s, n, x, m))
    found = similar_join(a, b, ["c"], percent, (100 * inner >= percent * hull) & (hull > 0))
    assert sorted((r.i, r.j) for r in found.collect()) == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 120), st.integers(-1, 40)), max_size=25), st.lists(st.tuples(st.integers(1, 150), st.integers(0, 60)), max_size=8), st.sampled_from([7, 64, 1 << 20]))
def test_depth_by_sweep_is_that_of_every_base(spark, blocks, regions, stretch):
    from isoframe.operators import coverage

    keep, coverage.STRETCH = coverage.STRETCH, stretch
    try:
        b = spark.createDataFrame([("1", s, s + n) for s, n in blocks], "chromosome string, r_start int, r_end int")
        r = spark.createDataFrame([(i, "1", s, s + n) for i, (s, n) in enumerate(regions)], "region int, chromosome string, start int, end int")
        got = {x.region: (x.total, x.covered) for x in coverage.depth_sums(r, b, ["chromosome"], ["region"]).collect()}
    finally:
        coverage.STRETCH = keep
    depth = [sum(s <= x <= s + n for s, n in blocks) for x in range(300)]
    assert got == {i: (sum(depth[s : s + n + 1]), sum(d > 0 for d in depth[s : s + n + 1])) for i, (s, n) in enumerate(regions)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 200), min_size=1, max_size=30), st.sampled_from([3, 16, 1 << 20]))
def test_order_over_stretches(spark, places, stretch):
    df = spark.createDataFrame([("k", p) for p in sorted(set(places))], "k string, start int")
    ordered = sorted(set(places))
    got = {r.start: r.nxt for r in with_next(df, ["k"], ["start"], "start", "nxt", stretch).collect()}
    assert got == dict(zip(ordered, [*ordered[1:], None], strict=True))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12), st.integers(30, 34), st.sampled_from("+-"), st.integers(1, 3)), min_size=1, max_size=60), st.sampled_from([1, 4, 23]), st.sampled_from(["any", "all"]))
def test_isoforms_in_segments_are_those_of_one_walk(spark, rows, segments, match):
    reads_ = []
    for i, (sample, start, end, strand, n) in enumerate(rows):
        exons = [(start, end)] if n == 1 else [(start, start + 5), *[(10 + k, 11 + k) for k in range(n - 2)], (end - 3, end)]
        reads_.append((sample, f"r{i % 7}", "1", start, end, strand, exons))
    df = spark.createDataFrame(reads_, "sample string, name string, chromosome string, start int, end int, strand string, exons array<struct<start:int,end:int>>")
    shown = lambda r: {"sample": r[0], "chromosome": r[2], "start": r[3], "end": r[4], "strand": r[5], "exons": [{"start": a, "end": b} for a, b in r[6]], "name": r[1]}
    want, leader = {}, None
    for r in map(shown, sorted(reads_, key=lambda r: (r[0], r[2], r[3], r[4], len(r[6]), r[6], r[5], r[1]))):
        if leader is None or not isoforms.absorbs(leader, r, 3, match):
            leader = r
            want[len(want)] = [(r["sample"], r["name"], r["start"], r["end"]), 0]
        want[len(want) - 1][1] += 1
    got = isoforms.isoforms(isoforms.unify(df, 3, match, segments)).collect()
    assert sorted(((r.sample, r.name, r.start, r.end), r.n_reads) for r in got) == sorted(map(tuple, want.values()))


def test_one_isoform_through_many_segments(spark):
    """A locus of equal reads is shared by all segments, and resolved in a few passes."""
    df = spark.range(3000).selectExpr("'s' AS sample", "concat('r', id) AS name", "'1' AS chromosome", "CAST(100 + id % 2 AS INT) AS start", "CAST(500 AS INT) AS end", "'+' AS strand")
    df = df.withColumn("exons", F.array(F.struct(F.col("start"), F.lit(200).alias("end")), F.struct(F.lit(300).alias("start"), F.col("end"))))
    asked, walked = [], isoforms._walked
    isoforms._walked = lambda table, missing, *more: asked.append(len(missing)) or walked(table, missing, *more)
    try:
        got = isoforms.isoforms(isoforms.unify(df, segments=30)).collect()
    finally:
        isoforms._walked = walked
    assert [(r.start, r.n_reads) for r in got] == [(100, 3000)]
    assert len(asked) <= 2 and max(asked) >= 25


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(1, 6), st.integers(7, 12)), st.integers(1, 9), min_size=1))
def test_ratios_of_a_node_sum_to_one(spark, rows):
    j = psi.with_psi(graph(spark, [(s * 10, e * 10, c) for (s, e), c in rows.items()]))
    for side in ("start", "end"):
        assert all(abs(r[1] - 1) < 1e-9 for r in j.groupBy(side).agg(F.sum(f"psi_{side}")).collect())


def test_empty_inputs(spark):
    assert events.all_events(graph(spark, []).limit(0)).count() == 0
    assert isoforms.unify(reads(spark, []).limit(0)).count() == 0


def test_no_side_of_a_place_join_goes_through_the_driver(spark):
    # the files of one side are small, its dealt rows need not be: estimates would broadcast either side
    a = spark.range(50).selectExpr("'1' AS c", "CAST(id * 7 AS INT) AS start", "CAST(id * 7 + id % 90 AS INT) AS end")
    b = spark.range(50).selectExpr("'1' AS c", "CAST(id * 9 AS INT) AS r_start", "CAST(id * 9 + id % 70 AS INT) AS r_end")
    want = {(x.start, x.end, y.r_start, y.r_end) for x in a.collect() for y in b.collect() if x.start <= y.r_end and x.end >= y.r_start}
    found = interval_join(a, b, ["c"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.start, r.end, r.r_start, r.r_end) for r in found.collect()} == want
    ratio = iv.overlap_percent(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), "hull")
    near = {p for p in want if (max(p[1], p[3]) - min(p[0], p[2])) * 60 <= 100 * (min(p[1], p[3]) - max(p[0], p[2])) and max(p[1], p[3]) > min(p[0], p[2])}
    assert near
    for around in ("left", "right"):
        for known in (False, True):
            found = similar_join(a, b, ["c"], 60.0, ratio >= 60, around, known)
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.start, r.end, r.r_start, r.r_end) for r in found.collect()) == sorted(near)
