"""Files in, files out: formats, the four commands, and the arrival of files in a stream."""

import gzip
import random
import struct

import pytest

from isoframe import cli
from isoframe.plans import commands, inputs, views
from isoframe.sources import alignments, annotation, companions, files, junction_files
from isoframe.sources.sniff import sniff

STAR = "chr1\t100\t200\t1\t1\t0\t30\t2\t40\nchr1\t300\t400\t1\t1\t1\t10\t0\t40\nchr1\t100\t400\t1\t1\t1\t20\t0\t40\n1\t5\t9\t0\t0\t0\t7\t0\t3\n"
SJ = "# a comment\n1:100-200+\t5\n1:300-400-\t6\nX:1-9\t7\n"
SAM = "@HD\tVN:1.6\nr1\t0\tchr1\t50\t60\t50M100N101M100N50M\t*\t0\t0\t*\t*\tNH:i:1\nr2\t16\tchr1\t50\t60\t50M100N50M\t*\t0\t0\t*\t*\tNH:i:1\nr3\t0\tchr1\t50\t60\t50M100N50M\t*\t0\t0\t*\t*\tNH:i:2\nr4\t0\tchr1\t50\t60\t50M100N50M\t*\t0\t0\t*\t*\n"
GTF = '#!x\n1\tx\tgene\t50\t450\t.\t+\t.\tgene_id "A"; gene_name "a b";\n1\tx\texon\t50\t99\t.\t+\t.\tgene_id "A"; transcript_id "T1"; exon_id "e1";\n1\tx\texon\t201\t299\t.\t+\t.\tgene_id "A"; transcript_id "T1";\n1\tx\tCDS\t201\t299\t.\t+\t0\tgene_id "A"; transcript_id "T1";\n'
GFF = "##gff-version 3\nchr1\tx\texon\t201\t299\t.\t+\t.\tID=exon:e2;Parent=transcript:T1\nchr1\tx\tmRNA\t50\t450\t.\t+\t.\tID=transcript:T1;Parent=gene:ABC\n"
GMAP = ">read1\n  +X:100-150  (1-51)   100% ->   ...10...  0.997, 0.999\n  +X:200-250  (52-102)   100%\n\n>read2\n  -X:400-350  (1-51)   100% <-   ...\n  -X:300-250  (52-102)   99%"
GMAPE = "chr2\t10\t90\t+\t20,29,40,49\nchr2\t10\t90\t+\t\n"


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def bam(tmp_path, name):
    def record(qname, flag, pos, ops, nh):
        tags = b"XAZab\0" + b"NHC" + bytes([nh])
        body = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(qname) + 1, 60, 0, len(ops), flag, 4, -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in ops) + b"\x12\x48" + b"\xff" * 4 + tags
        return struct.pack("<i", len(body)) + body

    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data += record("r1", 0, 50, [(50, "M"), (100, "N"), (50, "M")], 1) + record("r2", 16, 60, [(40, "M"), (100, "N"), (50, "M")], 2)
    blocks = b"".join(_bgzf(data[i : i + 60]) for i in range(0, len(data), 60))
    (tmp_path / name).write_bytes(blocks)
    return str(tmp_path / name)


def _bgzf(part):
    body = gzip.compress(part)
    # a BGZF block is a gzip member whose extra field gives its size
    return body[:3] + bytes([4]) + body[4:10] + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 8 - 1) + body[10:]


@pytest.mark.parametrize(("text", "kind"), [(STAR, "star"), (SJ, "sj"), (SAM, "sam"), (GTF, "gtf"), (GFF, "gff"), (GMAP, "gmap"), (GMAPE, "gmap_extract"), ("hello\n", "unknown"), ("", "unknown")])
def test_sniff(spark, tmp_path, text, kind):
    assert sniff(spark, put(tmp_path, "x", text)) == kind


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_junction_files(spark, tmp_path):
    star = junction_files.read_star(spark, put(tmp_path, "s.tab", STAR))
    assert rows(star, "chromosome", "start", "end", "strand", "count") == [("1", 5, 9, ".", 7), ("1", 100, 200, "+", 30), ("1", 100, 400, "+", 20), ("1", 300, 400, "+", 10)]
    sj = junction_files.read_junctions(spark, put(tmp_path, "j.txt", SJ))
    assert rows(sj, "chromosome", "start", "end", "strand", "count") == [("1", 100, 200, "+", 5), ("1", 300, 400, "-", 6), ("X", 1, 9, ".", 7)]


def test_alignments(spark, tmp_path):
    reads = alignments.to_reads(alignments.read_sam(spark, put(tmp_path, "a.sam", SAM)))
    assert rows(reads, "name", "chromosome", "start", "end", "strand") == [("r1", "1", 50, 450, "+"), ("r2", "1", 50, 249, "-")]
    path = bam(tmp_path, "a.bam")
    assert sniff(spark, path) == "bam"
    got = alignments.read_bam(spark, path)
    assert rows(got, "name", "flag", "chromosome", "pos", "cigar", "nh") == [("r1", 0, "chr1", 50, "50M100N50M", 1), ("r2", 16, "chr1", 60, "40M100N50M", 2)]
    assert rows(alignments.to_blocks(got), "r_start", "r_end") == [(50, 99), (60, 99), (200, 249), (200, 249)]
    text = alignments.read_alignment_text(spark, put(tmp_path, "g.txt", GMAP))
    assert rows(text, "chromosome", "start", "end", "strand") == [("X", 100, 250, "+"), ("X", 250, 400, "-")]
    assert [tuple(i) for r in text.orderBy("start").collect() for i in r.introns] == [(151, 199), (301, 349)]
    one = alignments.read_extract(spark, put(tmp_path, "e.txt", GMAPE)).collect()
    assert [[tuple(i) for i in r.introns] for r in one] == [[(20, 29), (40, 49)]]
    counted = inputs.junctions(spark, [str(tmp_path / "a.sam"), path])
    assert rows(counted, "sample", "start", "end", "strand", "count") == [("a.bam", 100, 199, "+", 1), ("a.sam", 100, 199, "+", 1), ("a.sam", 100, 199, "-", 1), ("a.sam", 301, 400, "+", 1)]


def gmap_reads(text):
    """Reads of alignment text, line by line: (chromosome, strand, exons)."""
    import re

    out, on, exons = [], None, []
    for line in [*text.split("\n"), ""]:
        m = re.match(r"^\s+([+-])([\w.]+):(\d+)-(\d+)\s+\(\d+-\d+\)\s+\d+%", line)
        place = m and (m[2], m[1])
        if place != on:
            if len(exons) > 1:
                out.append((*on, tuple(sorted(exons))))
            exons = []
        on = place
        if m:
            exons.append(tuple(sorted((int(m[3]), int(m[4])))))
    return sorted(out)


@pytest.mark.parametrize("split", [64, 1000, 64 << 10, 1 << 27])
def test_alignment_text_across_splits(spark, tmp_path, split):
    rng = random.Random(6)
    text = []
    for i in range(400 if split < 1 << 16 else 9000):
        if rng.random() < 0.6:
            text.append(f">read{i}")
        chrom, strand, at = rng.choice("12X"), rng.choice("+-"), rng.randrange(1, 9999)
        exons = [(at + 100 * k, at + 100 * k + 50) for k in range(rng.choice([1, 1, 2, 3, 30]))]
        shown = exons if strand == "+" else [(b, a) for a, b in reversed(exons)]
        text += [f"  {strand}{chrom}:{a}-{b}  (1-51)   100% ->   ...{'x' * rng.randrange(0, 40)}" for a, b in shown]
        text += rng.choice([[], [""], ["    some alignment", ""]])
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    paths = [put(tmp_path / "x", "a.txt", "\n".join(text)), put(tmp_path / "y", "a.txt", GMAP)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(split))
        df = alignments.read_alignment_text(spark, paths)
        got = [(r.sample, r.chromosome, r.strand, tuple((x.start, x.end) for x in r.exons), r.name) for r in df.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r[1:4] for r in got if r[0] == "x/a.txt") == gmap_reads("\n".join(text))
    assert sorted(r[1:4] for r in got if r[0] == "y/a.txt") == gmap_reads(GMAP)
    assert len({(r[0], r[4]) for r in got}) == len(got)


@pytest.mark.parametrize("records", [7, 300])
def test_alignment_text_across_batches(spark, tmp_path, records):
    rng = random.Random(8)
    text = []
    for i in range(60):
        strand, at = rng.choice("+-"), rng.randrange(1, 9999)
        exons = [(at + 100 * k, at + 100 * k + 50) for k in range(rng.choice([1, 2, 5, 90, 700]))]
        text += [f"\t {strand}chr1.a:{a}-{b}  (1-51)   99% ->" for a, b in (exons if strand == "+" else [(b, a) for a, b in reversed(exons)])] + rng.choice([[], [">x"], ["", ""]])
    odd = ["  +2:1-9  (1-9)  9%", "  +2:20-29  (1-9)  9%\u2028x", "  +2:40-49  (1-9)  9%\u2028", "  +2:30-39  (1-9)  9%"]  # a line break within is no exon line
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, (str(records), "20000"), strict=True):
            spark.conf.set(k, v)
        df = alignments.read_alignment_text(spark, put(tmp_path, "a.txt", "\n".join([*text, *odd])))
        got = sorted((r.chromosome, r.strand, tuple((x.start, x.end) for x in r.exons)) for r in df.collect())
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)
    want = [(c.removeprefix("chr"), *rest) for c, *rest in gmap_reads("\n".join(text))] + [("2", "+", ((30, 39), (40, 49)))]
    assert got == sorted(want)


def test_lines_of_alignment_text_are_not_shuffled(spark, tmp_path):
    df = alignments.read_alignment_text(spark, put(tmp_path, "g.txt", GMAP))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") <= 2
    # one for the order of edges, one for reads of several splits
    assert plan.count("Exchange hashpartitioning") <= 2


def test_reads_of_line_items_are_shuffled_once(spark):
    plan = views.read_exons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 + ("SortMergeJoin" in plan)


def test_alignments_of_one_name_are_reads_of_their_own(spark):
    from isoframe.operators import coupling, isoforms

    schema = "sample string, name string, chromosome string, start int, end int, strand string, introns array<struct<start:int,end:int>>, exons array<struct<start:int,end:int>>"
    row = lambda name, at: ("s", name, "1", at, at + 300, "+", [(at + 101, at + 199)], [(at, at + 100), (at + 200, at + 300)])
    reads = spark.createDataFrame([row("r1", 100), row("r1", 5000), row("r2", 101), row("r1", 101), row("r1", 101)], schema)
    got = sorted((r.name, r.start, r.n_reads) for r in isoforms.isoforms(isoforms.unify(reads)).collect())
    assert got == [("r1", 100, 4), ("r1", 5000, 1)]
    exons = spark.createDataFrame([("T", "G", "1", s, e, "+", f"e{s}") for s, e in ((100, 200), (300, 400))], "transcript string, gene string, chromosome string, start int, end int, strand string, exon_id string")
    pairs = coupling.couple(coupling.assemble_transcripts(exons), reads)
    assert sorted((r.name, r.start) for r in coupling.novel_reads(reads, pairs).collect()) == [("r1", 5000)]


def test_annotation(spark, tmp_path):
    gtf = annotation.read_annotation(spark, put(tmp_path, "a.gtf", GTF))
    assert rows(gtf, "transcript", "gene", "start", "exon_id") == [("T1", "A", 50, "e1"), ("T1", "A", 201, "T1.2")]
    gff = annotation.read_annotation(spark, put(tmp_path, "a.gff", GFF))
    assert rows(gff, "transcript", "gene", "chromosome", "exon_id") == [("T1", "ABC", "1", "e2")]
    with pytest.raises(ValueError, match="neither"):
        annotation.read_annotation(spark, put(tmp_path, "x", "hello\n"))


def test_samples_and_companions(tmp_path):
    assert files.sample_names(["/a/x.tab", "/b/x.tab", "/b/y.tab"]) == {"/a/x.tab": "a/x.tab", "/b/x.tab": "b/x.tab", "/b/y.tab": "y.tab"}
    (tmp_path / "s1.sorted.bam").touch()
    paths = [str(tmp_path / "s1.SJ.out.tab"), str(tmp_path / "s2.SJ.out.tab")]
    assert companions.companions(paths, None) == dict.fromkeys(paths)
    assert list(companions.companions(paths, "auto").values()) == [str(tmp_path / "s1.sorted.bam"), None]
    assert list(companions.companions(paths, "x.bam,y.bam").values()) == ["x.bam", "y.bam"]


def test_commands(spark, tmp_path):
    star, gtf, sam = put(tmp_path, "s1.tab", STAR), put(tmp_path, "a.gtf", GTF), put(tmp_path, "l.sam", SAM)
    found = {(r.event, tuple(r.sites)): (r.subtype, r.exons) for r in commands.short(spark, [star], gtf).collect()}
    assert found[("SE", (100, 200, 300, 400))] == ("exact", ["T1.2"])
    out = str(tmp_path / "out")
    cli.run(spark, cli.parser().parse_args(["short", star, "-r", gtf, "-o", out, "--psi-table", "--count-table"]))
    table = spark.read.text(out).collect()
    assert any(r.value.startswith("#spliceRange\t") for r in table)
    assert any("1:100-200-300-400\t0\tA\tT1\tT1.2\t0.467" in r.value for r in table)
    assert spark.read.text(f"{out}.junction_counts.tab").count() >= 5
    cli.run(spark, cli.parser().parse_args(["extract", "-i", sam, "-o", out + "x"]))
    assert "1:100-199+\t1" in [r.value for r in spark.read.text(out + "x").collect()]
    cli.run(spark, cli.parser().parse_args(["iso", sam, "-o", out + "i"]))
    assert spark.read.text(out + "i").count() == 7
    cli.run(spark, cli.parser().parse_args(["long", sam, "-r", gtf, "-o", out + "l"]))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["short", star, "-r", gtf, "-o", out, "--overlap-exon-intron", "0"])


def test_matrices_of_very_many_samples(spark, tmp_path):
    from isoframe.operators import report

    n = 12_000
    samples = [f"s{i:05d}" for i in range(n)]
    cells = [("1:5-9+", s, str(i)) for i, s in enumerate(samples)] + [("1:1-2", samples[0], "a"), ("2:1-2", samples[-1], "z"), ("3:1-2", samples[5000], "m")]
    report.write_matrix(spark.createDataFrame(cells, "key string, sample string, v string"), str(tmp_path / "m"))
    lines = {r.value.split("\t")[0]: r.value.split("\t")[1:] for r in spark.read.text(str(tmp_path / "m")).collect()}
    assert lines["#junctions"] == samples
    assert lines["1:5-9+"] == [str(i) for i in range(n)]
    one = lambda at, v: [v if i == at else "NA" for i in range(n)]
    assert (lines["1:1-2"], lines["2:1-2"], lines["3:1-2"]) == (one(0, "a"), one(n - 1, "z"), one(5000, "m"))


def test_last_line_of_a_key_counts(spark, tmp_path):
    text = "".join(f"chr1\t100\t200\t1\t1\t0\t{n}\t2\t40\n" for n in (30, 90, 7))
    assert [r["count"] for r in junction_files.read_star(spark, put(tmp_path, "s.tab", text)).collect()] == [7]
    assert [r["count"] for r in junction_files.read_junctions(spark, put(tmp_path, "j", "1:1-9\t8\n1:1-9\t2\n")).collect()] == [2]


def test_stream(spark, tmp_path):
    from isoframe.streaming.junctions import stream_junctions

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.tab", STAR)
    query = stream_junctions(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    try:
        query.processAllAvailable()
        put(tmp_path / "in", "b.tab", STAR)
        query.processAllAvailable()
        assert {(r.start, r.end): r["count"] for r in spark.table("arrived").collect()}[(100, 200)] == 60
    finally:
        query.stop()
