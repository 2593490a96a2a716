"""BAM as a Spark data source: read by ranges of compressed blocks, by region through the index, and written with an index.

A file is dealt to tasks by byte ranges. A task finds the first block that begins in its range and the first record that begins
in those blocks, and reads records up to the first that begins in a later range; so every record is read once. Where an index
lies beside the file, record places come from it; else a place counts as a record's if everything from it on reads as records.
For regions only the blocks that the index names are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed by the format: CIGAR operations by code, and the sizes of tag values by type.
CIGAR_OPS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
#: Fixed by the format: the first bytes of a block, the last block of a file, and most bytes of a block's contents.
MAGIC, BLOCK_MOST = b"\x1f\x8b\x08\x04", 65280
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Fixed by the index: bins by length (bits) with their first number, the bin of counts, bits of a window.
LEVELS, COUNTS_BIN, WINDOW_BITS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)), 37450, 14
SCHEMA = "sample string, name string, flag int, chromosome string, pos int, cigar string, nh int"
ARROW = pa.schema([("sample", pa.string()), ("name", pa.string()), ("flag", pa.int32()), ("chromosome", pa.string()), ("pos", pa.int32()), ("cigar", pa.string()), ("nh", pa.int32())])
BATCH, SPLIT = 10_000, 32 << 20
#: Records that must follow each other from a place for it to count as a record's.
CHAIN = 8
#: Bytes of a record at most, where its place is not in an index.
RECORD_MOST = 64 << 20
#: CIGAR strings that a task remembers.
CIGARS = 1 << 16
_HEAD, _BODY, _RECORD, _SIZE = struct.Struct("<iiiBBHHHiii"), struct.Struct("<iiBBHHHi"), struct.Struct("<iiiBBHHHiiii"), struct.Struct("<i")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, inner


def _files(path: str) -> list[tuple[str, int]]:
    """The file with its size, or the BAM files of a folder."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith(".bam")]
        return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)
    if not info.size:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def block_size(data: bytes, at: int) -> int:
    """Bytes of the block that begins at ``at``, or 0 if none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return 0
    end = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    at += 12
    while at + 6 <= min(end, len(data)):
        n = int.from_bytes(data[at + 2 : at + 4], "little")
        if data[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(data[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


class Bytes:
    """A file's bytes by place, read a window at a time."""

    def __init__(self, file, size: int, window: int = 1 << 20):
        self.file, self.size, self.window, self.at, self.held = file, size, window, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, self.window), self.size - at), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]


def next_block(data: Bytes, at: int) -> int:
    """The first place from ``at`` on where a block begins, with others after it; the file's size if none does."""
    while at < data.size:
        found = data.get(at, 1 << 17)
        i = found.find(MAGIC)
        while i >= 0:
            place = at + i
            for _ in range(3):
                if place >= data.size or not (n := block_size(data.get(place, 1 << 10), 0)):
                    break
                place += n
            if place == data.size or place > at + i and block_size(data.get(place, 1 << 10), 0):
                return at + i
            i = found.find(MAGIC, i + 1)
        at += max(1, len(found) - 3)
    return data.size


class Stream:
    """Inflated contents from a block on, with the file's place of every byte."""

    def __init__(self, data: Bytes, at: int):
        self.data, self.next, self.keep = data, at, False
        self.held, self.pos, self.starts, self.places = bytearray(), 0, [], []

    def more(self) -> bool:
        n = block_size(self.data.get(self.next, 1 << 16), 0)
        if not n:
            if self.next < self.data.size:
                raise ValueError(f"no block at byte {self.next}")
            return False
        block = self.data.get(self.next, n)
        if self.pos > 1 << 20 and not self.keep:
            keep = bisect_right(self.starts, self.pos) - 1
            cut = self.starts[keep]
            del self.held[:cut]
            self.starts, self.places, self.pos = [s - cut for s in self.starts[keep:]], self.places[keep:], self.pos - cut
        self.starts.append(len(self.held))
        self.places.append(self.next)
        self.held += zlib.decompress(block, 31)
        self.next += n
        return True

    def need(self, n: int) -> bool:
        while len(self.held) - self.pos < n:
            if not self.more():
                return False
        return True

    def where(self) -> int:
        """The virtual offset of the next byte, or past all if there is none."""
        if not self.need(1):
            return self.data.size << 16
        i = bisect_right(self.starts, self.pos) - 1
        return self.places[i] << 16 | self.pos - self.starts[i]

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the file ends within a record")
        self.pos += n
        return bytes(self.held[self.pos - n : self.pos])


def references(data: Bytes) -> tuple[list[str], int]:
    """Names of the references, and the virtual offset of the first record."""
    if not block_size(data.get(0, 1 << 10), 0):
        raise ValueError("not a BAM file")
    stream = Stream(data, 0)
    magic, size = struct.unpack("<4si", stream.take(8))
    if magic != b"BAM\x01":
        raise ValueError("not a BAM file")
    stream.take(size)
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return names, stream.where()


def tags_end(data: bytes, at: int, end: int) -> int:
    """Where the tags that begin at ``at`` stop reading as tags; ``end`` if all do."""
    while at + 3 <= end:
        kind, start = chr(data[at + 2]), at + 3
        if kind in "ZH":
            after = data.find(0, start, end) + 1 or end + 1
        elif kind == "B" and start + 5 <= end and chr(data[start]) in TAG_SIZES:
            after = start + 5 + TAG_SIZES[chr(data[start])] * int.from_bytes(data[start + 1 : start + 5], "little")
        elif kind in TAG_SIZES:
            after = start + TAG_SIZES[kind]
        else:
            return at
        if after > end:
            return at
        at = after
    return at


def is_record(data: bytes, at: int) -> bool:
    """Whether the bytes at ``at``, a whole record by their length, read as one."""
    size, _, _, l_name, _, _, n_ops, _, l_seq, _, _ = _HEAD.unpack_from(data, at)
    end, name_end = at + 4 + size, at + 36 + l_name
    ops_end = name_end + 4 * n_ops
    if name_end > end or data[name_end - 1] or not all(33 <= c <= 126 for c in data[at + 36 : name_end - 1]):
        return False
    if ops_end + (l_seq + 1) // 2 + l_seq > end or any(x & 15 > 8 for x in struct.unpack_from(f"<{n_ops}I", data, name_end)):
        return False
    return tags_end(data, ops_end + (l_seq + 1) // 2 + l_seq, end) == end


def may_begin(data: bytes, at: int, refs: int) -> int:
    """The length of the record that may begin at ``at``, by its fixed fields; 0 if none may."""
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos = _HEAD.unpack_from(data, at)
    ok = size <= RECORD_MOST and -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name > 0 and l_seq >= 0
    return 4 + size if ok and 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size else 0


def reads_on(stream: Stream, refs: int) -> bool:
    """Whether CHAIN records, or all up to the end of the file, follow from here."""
    for _ in range(CHAIN):
        if not stream.need(36):
            return not stream.need(1)
        n = may_begin(stream.held, stream.pos, refs)
        if not n or not stream.need(n) or not is_record(stream.held, stream.pos):
            return False
        stream.pos += n
    return True


def to_first_record(stream: Stream, refs: int) -> None:
    """Moves to the first place from which everything reads as records."""
    stream.keep = True
    while stream.need(36):
        begin = stream.pos
        if reads_on(stream, refs):
            stream.pos = begin
            break
        stream.pos = begin + 1
    else:
        stream.pos = len(stream.held)
    stream.keep = False


class Index:
    """A ``.bai``: chunks of records by bin, and the first record of each window."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\x01":
            raise ValueError("not a BAM index")
        self.refs, self.cuts, at = [], set(), 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins, n_bins, at = {}, struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bins):
                number, n, at = *struct.unpack_from("<Ii", data, at), at + 8
                chunks = struct.unpack_from(f"<{2 * n}Q", data, at)
                at += 16 * n
                if number != COUNTS_BIN:
                    bins[number] = list(zip(chunks[::2], chunks[1::2], strict=True))
                    self.cuts.update(chunks[::2])
            n = struct.unpack_from("<i", data, at)[0]
            windows = struct.unpack_from(f"<{n}Q", data, at + 4)
            at += 4 + 8 * n
            self.cuts.update(windows)
            self.refs.append((bins, windows))
        self.cuts = sorted(self.cuts - {0})

    def spans(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Virtual offsets between which are all records of ``ref`` that touch [start, end] (1-based, closed)."""
        if ref >= len(self.refs):
            return []
        bins, windows = self.refs[ref]
        lo, hi = max(start, 1) - 1, max(end, 1) - 1
        least = windows[min(lo >> WINDOW_BITS, len(windows) - 1)] if windows else 0
        near = (b for bits, first in LEVELS for b in range(first + (lo >> bits), first + (hi >> bits) + 1) if b in bins)
        return [(max(a, least), b) for n in near for a, b in bins[n] if b > least]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def read_index(path: str) -> Index | None:
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        system, inner = _open(name)
        if system.get_file_info(inner).is_file:
            with system.open_input_stream(inner) as f:
                return Index(f.read())
    return None


class BamRange(InputPartition):
    def __init__(self, path: str, sample: str, lo: int, hi: int, size: int):
        self.path, self.sample, self.lo, self.hi, self.size = path, sample, lo, hi, size


class Regions:
    """Stretches by chromosome, the front ``chr`` aside, merged."""

    def __init__(self, regions: list[tuple[str, int, int]]):
        by: dict[str, list] = {}
        for name, a, b in regions:
            by.setdefault(name.removeprefix("chr"), []).append((a, b + 1))
        self.by = {name: union(spans) for name, spans in by.items()}
        self.starts = {name: [a for a, _ in spans] for name, spans in self.by.items()}

    def touch(self, name: str, start: int, end: int) -> bool:
        spans = self.by.get(name)
        if not spans:
            return False
        i = bisect_right(self.starts[name], end) - 1
        return i >= 0 and spans[i][1] > start


def spans_of(part: BamRange, index: Index | None, regions: Regions | None, names: list[str], first: int) -> list[tuple[int, int]] | None:
    """Virtual offsets to read for a range, from record to record; None if they are to be found in the file."""
    if index is None:
        return None
    if regions is None:
        wanted = [(first, part.size << 16)]
    else:
        wanted = union([s for ref, name in enumerate(names) for a, b in regions.by.get(name.removeprefix("chr"), []) for s in index.spans(ref, a, b - 1)])
    # a span is cut where the index knows a record to begin; each piece belongs to the range it begins in
    lo, hi = max(part.lo << 16, first), part.hi << 16
    cut = lambda x: index.cuts[i] if (i := bisect_left(index.cuts, x)) < len(index.cuts) else part.size << 16
    lo, hi = first if part.lo == 0 else cut(lo), cut(hi) if part.hi < part.size else part.size << 16
    return [(max(a, lo), min(b, hi)) for a, b in wanted if max(a, lo) < min(b, hi)]


def bodies(data: Bytes, part: BamRange, spans: list[tuple[int, int]] | None, refs: int, first: int) -> Iterator[bytes]:
    """The records of a range, without their length."""
    if spans is None:
        at = first >> 16 if part.lo == 0 else next_block(data, part.lo)
        if at >= part.hi:
            return
        stream = Stream(data, at)
        if part.lo == 0:
            stream.need(first & 0xFFFF)
            stream.pos = first & 0xFFFF
        else:
            to_first_record(stream, refs)
        stop = part.hi << 16
        yield from _until(stream, stop)
        return
    for a, b in spans:
        stream = Stream(data, a >> 16)
        stream.need(a & 0xFFFF)
        stream.pos = a & 0xFFFF
        yield from _until(stream, b)


def _until(stream: Stream, stop: int) -> Iterator[bytes]:
    size_at = _SIZE.unpack_from
    while stream.where() < stop and stream.need(4):
        # the records of this block, up to the first that is not held whole
        held, pos, n = stream.held, stream.pos, len(stream.held)
        i = bisect_right(stream.starts, pos) - 1
        least = stream.starts[i + 1] if i + 1 < len(stream.starts) else n
        if stream.places[i] == stop >> 16:
            least = min(least, stream.starts[i] + (stop & 0xFFFF))
        while pos < least and pos + 4 <= n and (end := pos + 4 + size_at(held, pos)[0]) <= n:
            stream.pos = end
            yield bytes(held[pos + 4 : end])
            pos = end
        if pos < least:
            yield stream.take(int.from_bytes(stream.take(4), "little"))


def nh_tag(tags: bytes) -> int | None:
    at = 0
    while at + 3 <= len(tags):
        name, kind, at = tags[at : at + 2], chr(tags[at + 2]), at + 3
        if name == b"NH" and kind in TAG_CODES:
            return struct.unpack_from("<" + TAG_CODES[kind], tags, at)[0]
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(tags[at])] * int.from_bytes(tags[at + 1 : at + 5], "little")
        else:
            at += TAG_SIZES[kind]
    return None


@lru_cache(CIGARS)
def cigar_of(ops: bytes) -> tuple[str, int]:
    """CIGAR as text, and the bases of the reference that it takes."""
    codes = struct.unpack(f"<{len(ops) // 4}I", ops)
    return "".join([f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in codes]) or "*", sum([x >> 4 for x in codes if x & 15 in (0, 2, 3, 7, 8)])


def fields(body: bytes, names: list[str]) -> tuple:
    """(name, flag, chromosome, pos, cigar, nh, last base) of a record."""
    ref, pos, l_name, _, _, n_ops, flag, l_seq = _BODY.unpack_from(body)
    at = 32 + l_name
    cigar, length = cigar_of(body[at : at + 4 * n_ops])
    tags = body[at + 4 * n_ops + (l_seq + 1) // 2 + l_seq :]
    return body[32 : at - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, cigar, nh_tag(tags), pos + max(length, 1)


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], regions: list[tuple[str, int, int]] | None, split: int):
        self.paths, self.regions, self.split = paths, regions, split

    def pushFilters(self, filters):  # noqa: N802
        """A chromosome, and bounds of pos, become a region; Spark tests them again."""
        name, lo, hi = None, 1, (1 << 31) - 2
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chromosome",):
                name = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("pos",):
                lo, hi = max(lo, f.value), min(hi, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("pos",):
                lo = max(lo, f.value)
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("pos",):
                hi = min(hi, f.value)
            yield f
        if name not in (None, "*") and self.regions is None:
            self.regions = [(name, lo, hi)] if lo <= hi else []

    def partitions(self) -> list[InputPartition]:
        from isoframe.sources.files import sample_names

        names, out = sample_names(self.paths), []
        for p in self.paths:
            for path, size in _files(p):
                n = -(-size // self.split)
                out += [BamRange(path, names[p], size * i // n, size * (i + 1) // n, size) for i in range(n)]
        return out

    def read(self, partition: BamRange) -> Iterator[pa.RecordBatch]:
        regions = None if self.regions is None else Regions(self.regions)
        system, inner = _open(partition.path)
        with system.open_input_file(inner) as file:
            data = Bytes(file, partition.size)
            names, first = references(data)
            spans = spans_of(partition, read_index(partition.path), regions, names, first)
            plain, rows = [n.removeprefix("chr") for n in names], []
            known = dict(zip(names, plain, strict=True))
            for body in bodies(data, partition, spans, len(names), first):
                row = fields(body, names)
                if regions is None or regions.touch(known.get(row[2], "*"), row[3], row[6]):
                    rows.append((partition.sample, *row[:6]))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end) (from 0)."""
    last = end - 1
    for bits, first in LEVELS:
        if start >> bits == last >> bits:
            return first + (start >> bits)
    raise ValueError(f"no bin holds {start} to {end}")


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class BamWriter(DataSourceArrowWriter):
    """A file for each task, and its index; rows of a task must be in order of reference and place."""

    def __init__(self, path: str, refs: list[tuple[str, int]]):
        self.path, self.refs, self.job = path, refs, uuid.uuid4().hex

    def write(self, iterator) -> Written | None:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.path}/part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}.bam"
        system, inner = _open(name)
        numbers = {n: i for i, (n, _) in enumerate(self.refs)}
        bins: list[dict[int, list]] = [{} for _ in self.refs]
        windows: list[dict[int, int]] = [{} for _ in self.refs]
        held, place, last = bytearray(), 0, (-1, 0)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:

            def flush(least: int) -> None:
                nonlocal held, place
                while len(held) > least:
                    block = squeezed(bytes(held[:BLOCK_MOST]))
                    out.write(block)
                    place += len(block)
                    del held[:BLOCK_MOST]

            text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.refs).encode()
            held += b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs))
            for n, size in self.refs:
                held += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
            flush(0)
            empty = True
            for name_, flag, chromosome, pos, cigar, nh in _rows(iterator):
                empty = False
                if len(held) >= BLOCK_MOST:
                    flush(BLOCK_MOST - 1)
                begin = place << 16 | len(held)
                ref, start = numbers.get(chromosome, -1), pos - 1
                body, end = packed(name_, flag, pos, cigar, nh, ref)
                if ref >= 0:
                    if (ref, start) < last:
                        raise ValueError("rows of a task must be in order of reference and place")
                    last = ref, start
                held += body
                if len(held) >= BLOCK_MOST:
                    flush(BLOCK_MOST - 1)
                if ref >= 0:
                    number, after = bin_of(start, end), place << 16 | len(held)
                    chunks = bins[ref].get(number)
                    if chunks is None:
                        bins[ref][number] = [[begin, after]]
                    elif chunks[-1][1] == begin:
                        chunks[-1][1] = after
                    else:
                        chunks.append([begin, after])
                    first = windows[ref]
                    for w in range(start >> WINDOW_BITS, ((end - 1) >> WINDOW_BITS) + 1):
                        if w not in first:
                            first[w] = begin
            flush(0)
            out.write(LAST_BLOCK)
        if empty:
            system.delete_file(inner)
            return None
        with system.open_output_stream(inner + ".bai") as out:
            out.write(b"BAI\x01" + struct.pack("<i", len(self.refs)))
            for own, first in zip(bins, windows, strict=True):
                out.write(struct.pack("<i", len(own)))
                for number, chunks in sorted(own.items()):
                    out.write(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(x for c in chunks for x in c)))
                line, before = [], 0
                for w in range(max(first, default=-1) + 1):
                    before = first.get(w, before)
                    line.append(before)
                out.write(struct.pack(f"<i{len(line)}Q", len(line), *line))
        return Written(name)

    def commit(self, messages) -> None:
        self._keep({m.path for m in messages if m is not None})

    def abort(self, messages) -> None:
        self._keep(set())

    def _keep(self, names: set[str]) -> None:
        """Files of failed or repeated tasks go."""
        from pyarrow import fs

        system, inner = _open(self.path)
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if self.job in info.base_name and not any(n.endswith("/" + info.base_name.removesuffix(".bai")) for n in names):
                system.delete_file(info.path)


def squeezed(data: bytes) -> bytes:
    """A block of these bytes."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return LAST_BLOCK[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(name, flag, chromosome, pos, cigar, nh) of every row."""
    # numpy's lists are made many times faster than Arrow's, but have no null
    listed = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
    for batch in batches:
        yield from zip(*[listed(batch.column(c)) for c in ("name", "flag", "chromosome", "pos", "cigar", "nh")], strict=True)


@lru_cache(CIGARS)
def packed_cigar(cigar: str) -> tuple[bytes, int, int]:
    """Operations as bytes, how many they are, and the bases of the reference that they take."""
    ops, n = [], 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append((n, CIGAR_OPS.index(c)))
            n = 0
    return struct.pack(f"<{len(ops)}I", *(n << 4 | op for n, op in ops)), len(ops), sum(n for n, op in ops if op in (0, 2, 3, 7, 8))


def packed(name: str, flag: int, pos: int, cigar: str, nh: int | None, ref: int) -> tuple[bytes, int]:
    """A record without sequence, and the place (from 0) after its last base."""
    ops, n_ops, length = packed_cigar(cigar)
    start, called = pos - 1, name.encode()
    end = start + max(1, length)
    tags = b"" if nh is None else b"NHi" + _SIZE.pack(nh)
    size = 33 + len(called) + len(ops) + len(tags)
    head = _RECORD.pack(size, ref, start, len(called) + 1, 255, bin_of(max(start, 0), max(end, 1)), n_ops, flag, 0, -1, -1, 0)
    return b"".join((head, called, b"\0", ops, tags)), end


class BamDataSource(DataSource):
    """Options: ``paths`` and ``regions`` (chromosome, start, end by tabs), a line each; ``split``, bytes of a range. To write:
    ``path``, a folder, and ``references`` (name and length by a tab), a line each."""

    @classmethod
    def name(cls) -> str:
        return "isoframe_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        regions = None
        if (text := self.options.get("regions")) is not None:
            regions = [(c, int(a), int(b)) for c, a, b in (x.split("\t") for x in text.split("\n") if x)]
        return BamReader([p for p in self.options["paths"].split("\n") if p], regions, int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        refs = [(n, int(size)) for n, size in (x.split("\t") for x in self.options["references"].split("\n") if x)]
        return BamWriter(self.options["path"], refs)
