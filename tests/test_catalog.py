"""Every registered query of the splicing engine against its SQL."""

from collections import Counter

import pytest

from isoframe import catalog
from tests.duck import same, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        same(df, con, catalog.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_transcripts_of_all_parts(spark, con):
    reads = con.sql(f"WITH {catalog.READS} SELECT sample, name, chromosome, strand, parts FROM reads").fetchall()
    parts = [p for (p,) in con.sql("SELECT p_partkey FROM part").fetchall()]
    want, explained = {}, set()
    for sample, name, chromosome, strand, own in reads:
        start, end = own[0] * 40 + 91, own[-1] * 40 + 99
        for p in parts:
            for k in (20, 60, 140):
                s, e = p * 40 + 91, (p + k - 1) * 40 + 99
                inner, hull = min(end, e) - max(start, s), max(end, e) - min(start, s)
                if start <= e and end >= s and inner * 100 >= 60 * hull and any(p <= x < p + k for x in own):
                    want[sample, name, f"{p}.{k}|{chromosome}|{strand}"] = inner * 100 / hull
                    explained.add((sample, name))
    assert any(int(t.split(".")[0]) % 5 for _, _, t in want)
    run = lambda name: catalog.queries()[name](spark, SF).collect()
    got = {(r.sample, r.name, r.transcript): r.overlap for r in run("read_transcript_coupling")}
    assert got == pytest.approx(want, abs=1e-6)
    assert {(r.sample, r.name) for r in run("novel_reads")} == {(r[0], r[1]) for r in reads} - explained
    sizes = Counter((s, t) for s, _, t in want)
    assert {(r.sample, r.transcript): r.n_reads for r in run("template_sizes")} == sizes
