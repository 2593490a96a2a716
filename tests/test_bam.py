"""BAM by ranges of blocks, by region through the index, and written: against a plain walk over all records."""

import random
import struct

import pytest

from isoframe.sources import alignments, bam
from tests.test_sources import _bgzf

OPS = "MIDNSHP=X"


def record(rng, i, ref, pos):
    ops = [(rng.randrange(1, 60), rng.choice("MIDNSX=")) for _ in range(rng.randrange(1, 6))]
    name, n = f"read/{i}", rng.choice([0, 5, 90, 90, 2000, 150_000 if rng.random() < 0.02 else 30])
    tags = b"".join(rng.sample([b"XAZab c\0", b"NHC\x02", b"NMi\x01\0\0\0", b"ZBBS\x03\0\0\0abcdef", b"ASc\xff", b"XXAq"], rng.randrange(0, 6)))
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), rng.choice([0, 16, 4]), n, -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", k << 4 | OPS.index(op)) for k, op in ops) + rng.randbytes((n + 1) // 2) + rng.randbytes(n) + tags
    cigar = "".join(f"{k}{op}" for k, op in ops)
    nh = 2 if b"NHC" in tags else None
    return struct.pack("<i", len(body)) + body, (name, struct.unpack_from("<H", body, 14)[0], f"chr{ref + 1}" if ref >= 0 else "*", pos, cigar, nh)


@pytest.fixture(scope="module")
def plain(tmp_path_factory):
    """A file of many blocks without an index, and its rows; records cross blocks and some are longer than many."""
    rng, data, rows = random.Random(2), b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2), []
    data += b"".join(struct.pack("<i", 5) + n + struct.pack("<i", 1 << 28) for n in (b"chr1\0", b"chr2\0"))
    for i in range(1500):
        raw, row = record(rng, i, i // 700 if i < 1400 else -1, 1 + 40 * (i % 700) if i < 1400 else 0)
        data += raw
        rows.append(row)
    at, blocks = 0, []
    while at < len(data):
        n = rng.choice([1, 300, 5000, 40_000])
        blocks.append(_bgzf(data[at : at + n]))
        at += n
    path = tmp_path_factory.mktemp("bam") / "plain.bam"
    path.write_bytes(b"".join(blocks) + bam.LAST_BLOCK)
    return str(path), sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.drop("sample").collect())


@pytest.mark.parametrize("split", [1 << 30, 200_000, 20_000, 3_000])
def test_every_record_is_read_once(spark, plain, split):
    path, rows = plain
    df = alignments.read_bam(spark, path, split=split)
    assert got(df) == rows
    if split == 20_000:
        assert df.rdd.getNumPartitions() > 20


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng, rows = random.Random(5), []
    for i in range(30_000):
        chromosome = rng.choice(["chr1", "chr2", "chrX"])
        cigar = f"{rng.randrange(1, 80)}M{rng.choice([10, 100, 5000, 400_000])}N{rng.randrange(1, 80)}M"
        rows.append((f"r{i}", 16 * (i % 2), chromosome, rng.randrange(1, 3_000_000), cigar, 1 + i % 3))
    rows += [("odd", 4, "*", 0, "*", None), ("other", 0, "chrUn", 7, "5M", 1)]
    path = str(tmp_path_factory.mktemp("bam") / "sorted")
    records = spark.createDataFrame(rows, "name string, flag int, chromosome string, pos int, cigar string, nh int")
    alignments.write_bam(records.repartition(3), path, [("chr1", 4_000_000), ("chr2", 4_000_000), ("chrX", 4_000_000)])
    import glob

    return sorted(glob.glob(path + "/*.bam")), rows


def end_of(row):
    return row[3] - 1 + sum(int(n) for n in row[4].replace("M", " ").replace("N", " ").split())


def test_round_trip(spark, indexed):
    paths, rows = indexed
    want = sorted((r[0], r[1], "*" if r[2] == "chrUn" else r[2], *r[3:]) for r in rows)
    assert sorted(map(str, got(alignments.read_bam(spark, paths)))) == sorted(map(str, want))
    assert sorted(map(str, got(alignments.read_bam(spark, paths, split=9_000)))) == sorted(map(str, want))


REGIONS = [("1", 500_000, 500_100), ("chr1", 500_050, 520_000), ("2", 1, 1), ("X", 2_999_000, 9_000_000), ("7", 1, 9), ("2", 16_384, 16_385)]


@pytest.mark.parametrize("split", [1 << 25, 9_000])
def test_regions_through_the_index(spark, indexed, split):
    paths, rows = indexed
    touch = lambda r: any(r[2] == "chr" + c.removeprefix("chr") and r[3] <= b and end_of(r) >= a for c, a, b in REGIONS)
    want = sorted(r for r in rows if r[4] != "*" and r[2] != "chrUn" and touch(r))
    assert got(alignments.read_bam(spark, paths, REGIONS, split)) == want
    table = spark.createDataFrame(REGIONS, "chromosome string, start int, end int")
    assert got(alignments.region_records(spark, paths, table).drop("end")) == want
    assert got(alignments.read_bam(spark, paths, [])) == []


def test_only_named_blocks_are_read(indexed, monkeypatch):
    paths, _ = indexed
    seen, more = set(), bam.Stream.more

    def watched(self):
        seen.add(self.next)
        return more(self)

    monkeypatch.setattr(bam.Stream, "more", watched)
    reader = bam.BamReader(paths, [("chr1", 1_000_000, 1_000_500)], bam.SPLIT)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    few, _ = len(seen), seen.clear()
    reader = bam.BamReader(paths, None, bam.SPLIT)
    assert rows < sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) / 4
    assert few < len(seen) / 2


def test_filters_become_regions(spark, indexed):
    paths, rows = indexed
    df = alignments.read_bam(spark, paths).where("chromosome = 'chr2' AND pos >= 100000 AND pos < 110000")
    assert got(df) == sorted(r for r in rows if r[2] == "chr2" and 100_000 <= r[3] < 110_000)
    reader = bam.BamReader(paths, None, bam.SPLIT)
    kept = [bam.EqualTo(("chromosome",), "chr2"), bam.GreaterThanOrEqual(("pos",), 5), bam.LessThan(("pos",), 9)]
    assert list(reader.pushFilters(kept)) == kept
    assert reader.regions == [("chr2", 5, 9)]


def test_not_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(b"hello")
    with pytest.raises(Exception, match="not a BAM file"):
        alignments.read_bam(spark, str(tmp_path / "x.bam")).collect()


def test_a_bam_input_is_its_own_depth(spark, indexed):
    """Of indexed files only what lies in the regions is read; depth there is that of the whole file."""
    from isoframe.operators import retention
    from isoframe.plans import commands

    paths, _ = indexed
    path = paths[0]
    name = path.rpartition("/")[2]
    whole = commands.depth_blocks(spark, [path], None, own=True)
    chromosome, start = (r := whole.orderBy("r_start").first()).chromosome, r.r_start
    retained = spark.createDataFrame([(name, chromosome, start + 50, start + 4000), (name, chromosome, start + 900_000, start + 900_700)], "sample string, chromosome string, intron_start int, intron_end int").withColumn("psi", whole.sparkSession.range(1).selectExpr("CAST(NULL AS DOUBLE)").scalar())
    near = commands.depth_blocks(spark, [path], None, own=True, regions=retention.depth_regions(retained))
    assert 0 < near.count() < whole.count()
    ratios = lambda blocks: sorted((r.intron_start, r.psi) for r in retention.with_depth(retained, blocks).collect())
    assert ratios(near) == ratios(whole)
    assert any(p is not None for _, p in ratios(near))
    assert commands.depth_blocks(spark, [path], None) is None
