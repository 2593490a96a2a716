"""Unique isoforms: nearly equal long reads collapse into the first of them.

The fold is sequential, as a read is compared with the current leader only. Reads are dealt by range into segments in their
order, and each segment is folded on its own as if its first read were a leader. Where the leader that a segment ends with
absorbs the first read of the next one, that one is walked again with it, until both walks have the same leader; from there on
nothing changes. So only starts of segments are walked twice, and a locus of any depth is shared by many tasks. The driver
sees two reads of each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.operators.events import ERROR
from isoframe.scratch import written

PLACE = ["sample", "chromosome"]
COLUMNS = ["sample", "name", "chromosome", "start", "end", "strand", "exons"]


def same_read(a: dict, b: dict, error: int, match: str = "any") -> bool:
    """Ends within ``error``, one strand, as many exons, and any (or all) of the exons but the last within ``error``.

    A read of a single exon is compared by its ends alone.
    """
    near = lambda x, y: abs(x["start"] - y["start"]) < error and abs(x["end"] - y["end"]) < error
    if a["strand"] != b["strand"] or len(a["exons"]) != len(b["exons"]) or not near(a, b):
        return False
    inner = [near(x, y) for x, y in zip(a["exons"][:-1], b["exons"][:-1], strict=True)]
    return not inner or (any(inner) if match == "any" else all(inner))


def absorbs(leader: dict, row: dict, error: int, match: str) -> bool:
    return all(leader[k] == row[k] for k in PLACE) and same_read(leader, row, error, match)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(segment, its rows) one after the other; rows that were not taken are passed by."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        now = row["part"]

        def own(now=now) -> Iterator[dict]:
            nonlocal row
            while row is not None and row["part"] == now:
                yield row
                row = next(rows, None)

        each = own()
        yield now, each
        for _ in each:
            pass


class Fold:
    """The fold of reads that come in batches, in order; a segment begins with its leader of ``before``, if it has one.

    A row that one leader absorbs together with the row before is of that row's place, strand and number of exons, its ends less
    than twice ``error`` away. Any other is a leader, whatever came before; so only rows near the one before are compared.
    """

    def __init__(self, error: int, match: str, before: dict[int, dict]):
        self.error, self.match, self.before = error, match, before
        self.part, self.leader = None, None

    def _near(self, batch: pa.RecordBatch) -> np.ndarray:
        """Whether each row but the first is near the one before."""
        values = [pc.list_value_length(batch.column("exons")), *(batch.column(c) for c in ("part", *PLACE, "strand"))]
        same = [np.asarray(pc.fill_null(pc.equal(v[1:], v[:-1]), True)) for v in values]
        close = [np.abs(np.diff(np.asarray(batch.column(c)).astype(np.int64))) < 2 * self.error for c in ("start", "end")]
        return np.logical_and.reduce([*same, *close])

    def take(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[dict]]:
        """The place of each row's leader in the batch; those beyond its end are of the leaders from before, returned with it."""
        n, parts, older = batch.num_rows, np.asarray(batch.column("part")), []
        at = np.arange(n)
        row = lambda i: batch.slice(i, 1).to_pylist()[0]
        opens = np.concatenate([[parts[0] != self.part], parts[1:] != parts[:-1]])
        tried = np.concatenate([[True], self._near(batch)]) | opens
        leader, last = self.leader, -1
        for i in np.flatnonzero(tried).tolist():
            if opens[i]:
                leader = self.before.get(int(parts[i]))
                place = n + len(older)
            elif last != i - 1:
                leader, place = row(i - 1), i - 1
            elif i == 0:
                place = n
            last, own = i, row(i)
            if leader is not None and absorbs(leader, own, self.error, self.match):
                if place == n + len(older):
                    older.append(leader)
                at[i] = place
            else:
                leader, place = own, i
        self.part, self.leader = int(parts[-1]), leader if last == n - 1 else row(n - 1)
        return at, older


def _ends(table: DataFrame, error: int, match: str) -> dict[int, tuple[dict, dict]]:
    """segment -> its first read, and the leader it ends with on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(error, match, {})
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if parts[a] != fold.part:
                    if fold.leader is not None:
                        yield pa.RecordBatch.from_pylist([first, fold.leader], schema=batch_schema)
                    first = batch.slice(a, 1).to_pylist()[0]
                fold.take(batch.slice(a, b - a))
        if fold.leader is not None:
            yield pa.RecordBatch.from_pylist([first, fold.leader], schema=batch_schema)

    batch_schema = _arrow(table)
    found: dict[int, list[dict]] = {}
    for r in _in_order(table).mapInArrow(run, table.schema).collect():
        found.setdefault(r["part"], []).append(r.asDict(recursive=True))
    return {k: tuple(v) for k, v in found.items()}


def _arrow(table: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(table.schema)


def _in_order(table: DataFrame) -> DataFrame:
    # a task for each segment, as hashes would deal several to one
    parts = int(table.agg(F.max("part")).first()[0] or 0) + 1
    return table.repartitionById(parts, "part").sortWithinPartitions("part", "nth")


def _walked(table: DataFrame, asked: dict[int, dict[int, dict]], error: int, match: str) -> dict[tuple[int, int], dict | None]:
    """(segment, number of the leader before it) -> the leader it ends with then, or None if that is the same as on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _segments(batches):
            own, todo = None, {n: leader for n, leader in asked[part].items()}
            for row in rows:
                own = own if own is not None and absorbs(own, row, error, match) else row
                for n, leader in list(todo.items()):
                    if not absorbs(leader, row, error, match):
                        todo[n] = row
                    if todo[n]["nth"] == own["nth"]:
                        del todo[n]
                if not todo:
                    break
            if todo:
                # the segment and the leader asked with take the places of the read's own
                out = [leader | {"part": part, "asked": n} for n, leader in todo.items()]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = _arrow(table).append(pa.field("asked", pa.int64()))
    some = table.where(F.col("part").isin(list(asked)))
    found = _in_order(some).mapInArrow(run, table.withColumn("asked", F.lit(0).cast("long")).schema)
    out: dict[tuple[int, int], dict | None] = {(part, n): None for part, leaders in asked.items() for n in leaders}
    for r in found.collect():
        row = r.asDict(recursive=True)
        out[row["part"], row.pop("asked")] = row
    return out


def leaders_before(table: DataFrame, error: int, match: str) -> dict[int, dict]:
    """segment -> the leader it begins with, where an earlier one reaches into it."""
    ends, known = _ends(table, error, match), {}
    while True:
        missing: dict[int, dict[int, dict]] = {}
        before, now, parts = {}, None, sorted(ends)
        for k, part in enumerate(parts):
            first, own = ends[part]
            if now is None or not absorbs(now, first, error, match):
                now = own
                continue
            before[part] = now
            if (part, now["nth"]) in known:
                now = known[part, now["nth"]] or own
                continue
            # asked of all segments that it may run through; then as if it ended within this one
            for later in parts[k:]:
                if not absorbs(now, ends[later][0], error, match):
                    break
                if (later, now["nth"]) not in known:
                    missing.setdefault(later, {})[now["nth"]] = now
            now = own
        if not missing:
            return before
        known |= _walked(table, missing, error, match)


def unify(reads: DataFrame, error: int = ERROR, match: str = "any", segments: int | None = None) -> DataFrame:
    """reads (sample, name, chromosome, start, end, strand, exons) with ``leader``, the name of the read that absorbs each, and
    ``isoform``, a number for each leader: names may repeat.

    Reads are taken by start, end, number of exons, exons, strand and name; a read like the current leader is absorbed,
    any other becomes the leader. Reads are written in that order, in ``segments`` parts (else Spark's number).
    """
    rows = reads.select(*COLUMNS).withColumns({"n": F.size("exons"), "uid": F.monotonically_increasing_id()})
    by = [*PLACE, "start", "end", "n", "exons", "strand", "name", "uid"]
    dealt = rows.repartitionByRange(*([segments] if segments else []), *by).sortWithinPartitions(*by)
    table = written(dealt.select(*COLUMNS, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "ordered_reads")
    before = leaders_before(table, error, match)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Fold(error, match, before)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, older = walk.take(batch)
            of = lambda c, kind: pa.concat_arrays([batch.column(c).cast(kind), pa.array([x[c] for x in older], kind)]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), of("name", pa.string()), of("nth", pa.int64())], [*COLUMNS, "leader", "isoform"])

    kinds = dict(table.dtypes)
    return _in_order(table).mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in COLUMNS) + ", leader string, isoform long")


def isoforms(unified: DataFrame) -> DataFrame:
    """The leaders, with the number of reads each stands for."""
    keys = ["sample", "chromosome"]
    read = ["start", "end", F.size("exons").alias("n"), "exons", "strand", "name"]
    # a leader is the first of its reads
    found = unified.groupBy(*keys, "isoform").agg(F.min(F.struct(*read)).alias("r"), F.count(F.lit(1)).alias("n_reads"))
    return found.select("sample", "r.name", "chromosome", "r.start", "r.end", "r.strand", "r.exons", "n_reads")


def to_gtf(found: DataFrame, source: str = "isoframe") -> DataFrame:
    """GTF lines: a transcript and its exons for each isoform."""
    attrs = F.concat(F.lit('gene_id "'), "name", F.lit('"; transcript_id "'), "name", F.lit('";'))
    line = lambda kind, s, e, more: F.concat_ws("\t", "chromosome", F.lit(source), F.lit(kind), s, e, F.lit("."), "strand", F.lit("."), F.concat(attrs, more))
    exon = F.transform("exons", lambda x, i: line("exon", x["start"], x["end"], F.concat(F.lit(' exon_id "'), "name", F.lit("."), (i + 1).cast("string"), F.lit('";'))))
    lines = F.concat(F.array(line("transcript", F.col("start"), F.col("end"), F.lit(""))), exon)
    return found.select("chromosome", "start", "end", "name", F.posexplode(lines).alias("nth", "value"))
