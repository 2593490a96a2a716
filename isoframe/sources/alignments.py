"""Alignments as reads: SAM text, BAM, alignment text of a long-read mapper and its extract."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.functions import cigar as cg
from isoframe.functions.intervals import chromosome
from isoframe.operators.interval_join import interval_join
from isoframe.scratch import written
from isoframe.sources.bam import SPLIT, WINDOW_BITS, BamDataSource
from isoframe.sources.files import lines, placed_lines

PAIRS = "array<struct<start:int,end:int>>"
#: An exon line of alignment text (see ``sniff.LINE_FORMATS``, whose classes are Java's), and what no such line has.
EXON = "^S+(?P<strand>[+-])(?P<chrom>[A-Za-z0-9_.]+):(?P<a>[0-9]+)-(?P<b>[0-9]+)S+\\([0-9]+-[0-9]+\\)S+[0-9]+%".replace("S", "[\t\n\x0b\f\r ]")
BROKEN = "(?s)[\u0085\u2028\u2029]."
#: Exon lines that follow each other: whole ones with exons; what a split begins (edge 0) and ends (1) with, or that it is no
#: exon, with its part of a read, one row for both if it is all of the split.
RUNS = f"sample string, path string, split long, edge int, line long, chrom string, strand string, exons {PAIRS}, part {PAIRS}"


def sam_lines(found: DataFrame) -> DataFrame:
    """(sample, name, flag, chromosome, pos, cigar, nh) of SAM lines; header lines are skipped."""
    c = F.split("value", "\t")
    rows = found.where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    nh = F.regexp_extract("value", r"\tNH:i:(\d+)", 1).try_cast("int")
    return rows.select("sample", F.get(c, 0).alias("name"), F.get(c, 1).try_cast("int").alias("flag"), F.get(c, 2).alias("chromosome"), F.get(c, 3).try_cast("int").alias("pos"), F.get(c, 5).alias("cigar"), nh.alias("nh"))


def unique_only(records: DataFrame) -> DataFrame:
    """Records that map to one place; those that do not say are dropped."""
    return records.where("nh = 1")


def to_reads(records: DataFrame) -> DataFrame:
    """Reads (sample, name, chromosome, start, end, strand, introns, exons) of uniquely mapped records."""
    ok = unique_only(records).where("cigar <> '*' AND chromosome <> '*' AND pos > 0").withColumn("walk", cg.walk(F.col("cigar"), F.col("pos")))
    place = ok.select(
        "sample", "name", chromosome(F.col("chromosome")).alias("chromosome"), F.col("pos").alias("start"),
        (F.col("walk.pos") - 1).alias("end"), cg.read_strand(F.col("flag")).alias("strand"), F.col("walk.found").alias("introns"),
    )
    return place.withColumn("exons", cg.exons_of(F.col("start"), F.col("end"), F.col("introns")))


def to_blocks(records: DataFrame) -> DataFrame:
    """(sample, chromosome, r_start, r_end) of every aligned stretch, for depth; unmapped records have none."""
    ok = records.where("cigar <> '*' AND chromosome <> '*' AND pos > 0")
    each = ok.select("sample", chromosome(F.col("chromosome")).alias("chromosome"), F.explode(cg.blocks(F.col("cigar"), F.col("pos"))).alias("b"))
    return each.select("sample", "chromosome", F.col("b.start").alias("r_start"), F.col("b.end").alias("r_end"))


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return sam_lines(lines(spark, paths))


def windows_of(regions: DataFrame) -> list[tuple[str, int, int]]:
    """The stretches of windows (2**14 bases) that regions (chromosome, start, end) touch; a genome has some 200,000 windows."""
    number = lambda c: F.shiftright(F.greatest(F.col(c), F.lit(1)) - 1, WINDOW_BITS)
    touched = regions.where("end >= start AND end > 0").select(chromosome(F.col("chromosome")).alias("c"), F.explode(F.sequence(number("start"), number("end"))).alias("w")).distinct()
    before = F.lag("w").over(Window.partitionBy("c").orderBy("w"))
    first = touched.withColumn("opens", F.coalesce(before < F.col("w") - 1, F.lit(True)).cast("int"))
    runs = first.withColumn("run", F.sum("opens").over(Window.partitionBy("c").orderBy("w"))).groupBy("c", "run").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return [(r["c"], (r["a"] << WINDOW_BITS) + 1, (r["b"] + 1) << WINDOW_BITS) for r in runs.collect()]


def read_bam(spark: SparkSession, paths: str | list[str], regions: list[tuple[str, int, int]] | DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """Records of BAM files, a task for each range of ``split`` bytes; a folder of them is one sample.

    With ``regions`` (chromosome, first and last base; ``chr`` aside) only records that touch one, of a DataFrame those that touch
    a window of 2**14 bases that one touches; where a file has an index (``.bai``), only their blocks are read. A filter of the
    result by one chromosome and by pos is such a region, too.
    """
    spark.dataSource.register(BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that can push filters down
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("isoframe_bam").option("paths", "\n".join(paths)).option("split", split)
    if regions is not None:
        listed = windows_of(regions) if isinstance(regions, DataFrame) else regions
        found = found.option("regions", "\n".join(f"{c}\t{a}\t{b}" for c, a, b in listed))
    return found.load()


def write_bam(records: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """BAM files with their indexes in a folder, one for each range of (chromosome, pos); records as ``read_bam`` gives them.

    References are in the order of ``references``; records of others are written without a place.
    """
    records.sparkSession.dataSource.register(BamDataSource)
    order = F.create_map(*[x for i, (n, _) in enumerate(references) for x in (F.lit(n), F.lit(i))])
    rows = records.select("name", "flag", "chromosome", "pos", "cigar", "nh").withColumn("nth", F.coalesce(F.try_element_at(order, F.col("chromosome")), F.lit(len(references))))
    rows = rows.repartitionByRange("nth", "pos").sortWithinPartitions("nth", "pos").drop("nth")
    rows.write.format("isoframe_bam").option("path", path).option("references", "\n".join(f"{n}\t{size}" for n, size in references)).mode("append").save()


def region_records(spark: SparkSession, paths: str | list[str], regions: DataFrame) -> DataFrame:
    """Records (with ``end``, their last base) that touch a region (chromosome, start, end), each once.

    Records are decoded once and written, as the join reads them twice.
    """
    found = read_bam(spark, paths, regions).where("cigar <> '*' AND chromosome <> '*' AND pos > 0")
    found = found.select(*found.columns, cg.read_end(F.col("cigar"), F.col("pos")).alias("end"), F.monotonically_increasing_id().alias("uid"))
    left = written(found, "region_records").withColumns({"place": chromosome(F.col("chromosome")), "start": F.col("pos")})
    right = regions.select(chromosome(F.col("chromosome")).alias("place"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).distinct()
    return interval_join(left, right, ["place"]).dropDuplicates(["uid"]).select(*found.columns).drop("uid")


def _from_introns(df: DataFrame) -> DataFrame:
    return df.withColumn("exons", cg.exons_of(F.col("start"), F.col("end"), F.col("introns")))


def extract_lines(found: DataFrame) -> DataFrame:
    """Reads of extract lines (chromosome, start, end, strand, introns as a comma list); those without introns are skipped."""
    c = F.split("value", "\t")
    numbers = F.transform(F.split(F.get(c, 4), ","), lambda x: x.try_cast("int"))
    rows = found.where((F.size(c) == 5) & F.get(c, 4).rlike(r"^\d+,\d+(,\d+,\d+)*$"))
    introns = F.transform(F.sequence(F.lit(0), F.size(numbers) - 2, F.lit(2)), lambda i: F.struct(F.get(numbers, i).alias("start"), F.get(numbers, i + 1).alias("end")))
    name = F.concat_ws(":", F.get(c, 0), F.get(c, 1), F.get(c, 2), F.xxhash64("value").cast("string"))
    return _from_introns(rows.select("sample", name.alias("name"), chromosome(F.get(c, 0)).alias("chromosome"), F.get(c, 1).cast("int").alias("start"), F.get(c, 2).cast("int").alias("end"), F.get(c, 3).alias("strand"), introns.alias("introns")))


class _Runs:
    """Exon lines that follow each other, of the lines of one split after another; rows are those of ``RUNS``: edges or whole ones."""

    def __init__(self, edges: bool):
        self.edges, self.place, self.lines, self.open, self.out = edges, None, 0, None, []

    def _row(self, edge: int | None, run: tuple | None) -> None:
        if self.edges == (edge is None):
            return
        line, chrom, strand, found = run or (0, None, None, [])
        lo, hi = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int32) for i in (0, 1))
        if edge is None and len(lo) > 1:
            self._whole([line], [chrom], [strand], [len(lo)], *(x[np.lexsort((hi, lo))] for x in (lo, hi)))
        elif edge is not None:
            sample, path, split = self.place
            exons = _exon_lists([len(lo)], lo, hi)
            self.out.append(_run_batch([sample], [path], [split], [edge], [line], [chrom], [strand], pa.nulls(1, exons.type), exons))

    def _whole(self, line, chrom, strand, size, lo, hi) -> None:
        n, exons = len(line), _exon_lists(size, lo, hi)
        self.out.append(_run_batch(pa.repeat(self.place[0], n), pa.nulls(n, pa.string()), pa.repeat(self.place[2], n), pa.nulls(n, pa.int32()), line, chrom, strand, exons, pa.nulls(n, exons.type)))

    def close(self, ends: bool) -> None:
        """The open run is over; so is the split, if it ends."""
        if self.open is not None:
            first = self.open[0] == 0
            self._row(0 if first else 1 if ends else None, self.open)
            self.open = None
        elif ends and self.place is not None:
            self._row(1, None)

    def enter(self, place: tuple[str, str, int]) -> None:
        if place != self.place:
            self.close(True)
            self.place, self.lines = place, 0

    def take(self, hit: np.ndarray, on: np.ndarray, names: list[tuple[str, str]], lo: np.ndarray, hi: np.ndarray) -> None:
        """Lines of the split: whether each is an exon, the number of its chromosome and strand, its places."""
        n, base = len(hit), self.lines
        differs = np.r_[True, (on[1:] != on[:-1]) | ~hit[:-1], True]
        first, last = np.flatnonzero(hit & differs[:-1]), np.flatnonzero(hit & (differs[1:] | ~np.r_[hit[1:], False])) + 1
        self.lines += n
        if self.open is not None and hit[0] and names[on[0]] == self.open[1:3]:
            self.open[3].append((lo[: last[0]], hi[: last[0]]))
            first, last, more = first[1:], last[1:], last[0] == n
        else:
            more = False
        if not more:
            self.close(False)
        if base == 0 and not hit[0]:
            self._row(0, None)
        run = lambda i: (int(base + first[i]), *names[on[first[i]]], [(lo[first[i] : last[i]], hi[first[i] : last[i]])])
        ahead = None
        if len(last) and last[-1] == n:
            ahead, first, last = run(-1), first[:-1], last[:-1]
        if len(first) and base + first[0] == 0:
            self._row(0, run(0))
            first, last = first[1:], last[1:]
        size = last - first
        first, last, size = (x[size > 1] for x in (first, last, size))
        if len(first) and not self.edges:
            chroms, strands = (pa.array([x[i] for x in names]).take(pa.array(on[first])) for i in (0, 1))
            down = np.array([x[1] == "-" for x in names])[on[first]]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(np.where(down, last - 1, first), size) + np.repeat(np.where(down, -1, 1), size) * within
            a, b = lo[at], hi[at]
            if (((a[1:] < a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] < b[:-1]))) & (within[1:] > 0)).any():
                order = np.lexsort((b, a, np.repeat(np.arange(len(size)), size)))
                a, b = a[order], b[order]
            self._whole(base + first, chroms, strands, size, a, b)
        if ahead is not None:
            self.open = ahead


def _exon_lists(size, lo: np.ndarray, hi: np.ndarray) -> pa.ListArray:
    exons = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), exons)


def _run_batch(sample, path, split, edge, line, chrom, strand, exons, part) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    columns = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((sample, path, split, edge, line, chrom, strand), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, exons, part], ["sample", "path", "split", "edge", "line", "chrom", "strand", "exons", "part"])


def _parsed(value: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]], np.ndarray, np.ndarray]:
    """Of lines what ``_Runs.take`` takes."""
    got = pc.extract_regex(value, EXON)
    hit = pc.and_(pc.is_valid(got), pc.invert(pc.match_substring_regex(value, BROKEN)))
    got, hit = got.filter(hit), hit.to_numpy(zero_copy_only=False)
    chrom, strand = got.field("chrom").dictionary_encode(), got.field("strand")
    names = [(c, s) for c in chrom.dictionary.to_pylist() for s in "+-"]
    on, lo, hi = (np.zeros(len(hit), np.int32) for _ in range(3))
    on[hit] = 2 * chrom.indices.to_numpy() + pc.equal(strand, "-").to_numpy(zero_copy_only=False)
    a, b = (pc.cast(got.field(c), pa.int32()).to_numpy() for c in "ab")
    lo[hit], hi[hit] = np.minimum(a, b), np.maximum(a, b)
    return hit, on, names, lo, hi


def _finding(edges: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Runs(edges)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sample, path, split, value = (batch.column(c) for c in ("sample", "path", "split", "value"))
            place = lambda i: (sample[i].as_py(), path[i].as_py(), split[i].as_py())  # noqa: B023, E731
            if edges and own.place == place(0) == place(n - 1) and (own.open is None or own.open[0]):
                # within a split, all but the lines that may be its last read can be passed over
                k, found = 64, None
                while k < n:
                    found = _parsed(value[n - k :])
                    if not (found[0].all() and (found[1] == found[1][0]).all()):
                        break
                    k, found = 4 * k, None
                if found is not None:
                    own.open, own.lines = None, own.lines + n - k
                    own.take(*found)
                    continue
            hit, on, names, lo, hi = _parsed(value)
            other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(split[1:], split[:-1])).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(other) + 1).tolist(), n]
            for i, j in zip(borders[:-1], borders[1:], strict=True):
                own.enter(place(i))
                own.take(hit[i:j], on[i:j], names, lo[i:j], hi[i:j])
            if own.open is not None:  # not to hold on to the batch's arrays
                own.open[3][:] = [tuple(x.copy() for x in y) for y in own.open[3]]
            yield from own.out
            own.out.clear()
        own.close(True)
        yield from own.out

    return run


def alignment_text(found: DataFrame) -> DataFrame:
    """Reads of alignment text given as placed lines: exon lines that follow each other are one read, across splits too.

    Introns are the gaps between its exons; a read of one exon is skipped. A read ends where a line is no exon, and where another
    chromosome or strand begins. On the minus strand coordinates descend. A read's name is its chromosome, and the split and line
    it begins at. Lines are taken in the order of the scan, by its own tasks; only what a split begins and ends with is shuffled,
    to be linked to its neighbours. For that they are read a second time, but few of them parsed.
    """
    lines_ = found.select("sample", "path", "split", "value")
    whole, runs = (lines_.mapInArrow(_finding(x), RUNS) for x in (False, True))
    file, on = Window.partitionBy("path").orderBy("split", "edge"), F.struct("chrom", "strand")
    follows = (F.col("edge") == 0) & F.col("chrom").isNotNull() & (F.lag(on).over(file) == on)
    edges = runs.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("read", F.sum("opens").over(file))
    linked = edges.where("chrom IS NOT NULL").groupBy("sample", "path", "read", "chrom", "strand").agg(F.min(F.struct("split", "line")).alias("head"), F.array_sort(F.flatten(F.collect_list("part"))).alias("exons"))
    columns = ["sample", "chrom", "strand", "exons"]
    reads = whole.select(*columns, "split", "line").unionByName(linked.where("size(exons) > 1").select(*columns, "head.split", "head.line"))
    x = F.col("exons")
    introns = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct((a["end"] + 1).alias("start"), (b["start"] - 1).alias("end")))
    name = F.concat_ws(".", "chrom", F.col("split").cast("string"), F.col("line").cast("string"))
    return reads.select("sample", name.alias("name"), chromosome(F.col("chrom")).alias("chromosome"), F.element_at(x, 1)["start"].alias("start"), F.element_at(x, -1)["end"].alias("end"), "strand", introns.alias("introns"), "exons")


def read_alignment_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of alignment text; large files are read in splits, side by side."""
    return alignment_text(placed_lines(spark, paths))


def read_extract(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return extract_lines(lines(spark, paths))
