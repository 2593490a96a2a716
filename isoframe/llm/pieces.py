"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation takes, at each place of a text, the longest prefix that the model's compiled character map has (a double array)
or else one character, and records for every byte that it writes where in the source it came from. Spaces become U+2581, and
one is put in front. Pieces are then merged by score, and each piece is projected by that record to the bytes of the source
it stands for. A model without a map (as the 32k one) leaves characters as they are; its offsets follow from lengths alone.

No piece of such a vocabulary has a space after another character, so words never merge with what follows, and a bounded
cache of words gives the same pieces as merging whole texts. Spark deals the texts; nothing is shuffled.

With a model without a map, a slice of texts is cut at once wherever no piece has the two characters next to each other, as
nothing merges across such a place. What is cut off is looked up, and those that are new are merged side by side in numpy, one
merge of each in a round.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

SPACE = "▁"
#: Kinds of pieces and models; fixed by the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Words whose pieces are kept, each shorter than LONG characters.
CACHE, LONG = 200_000, 40
#: Words are merged side by side with others of up to so many characters.
WIDTHS = [4, 8, 12, 20, LONG - 1]
#: Below every score, and beyond every rank.
NEVER, LAST = -math.inf, np.iinfo(np.int32).max
#: Texts are taken in parts of about so many characters, and batches in slices of about so many bytes.
PART, SLICE = 1 << 20, 1 << 20
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CUT = re.compile(r"(?<=[^ ]) ")


class CharMap:
    """The compiled map: a double array whose leaves are offsets of NUL-terminated replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest prefix of data[at:] that the map has."""
        if not self.units:
            return None
        found, place = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = self.units[place] if place < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit & 256:
                found = i + 1 - at, self.units[place] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(0, found[1])])


class Merges:
    """The merges of a vocabulary in arrays. Symbols are ids of pieces, then other characters that pieces have, then ``other``."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        symbols = dict(ids)
        self.pieces = max(ids.values(), default=-1) + 1
        for c in {c for p in ids for c in p}:
            symbols.setdefault(c, len(symbols) + self.pieces)
        self.other = max(symbols.values(), default=0) + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        found = sorted((symbols[p[:k]] * (self.other + 1) + symbols[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        # a last key that none is
        self.keys, self.to = np.array([*(k for k, _ in found), np.iinfo(np.int64).max], np.int64), np.array([*(i for _, i in found), self.other], np.int32)
        self.rank = np.full(self.other + 1, LAST, np.int32)
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        for p, i in ids.items():
            self.rank[i] = order[scores[p]]
        # whether a piece may have two characters next to each other: by hash, so that some seem to be that are not
        self.near = np.zeros(1 << 20, bool)
        pairs = np.array([(ord(a), ord(b)) for p in ids for a, b in zip(p, p[1:])], np.uint32).reshape(-1, 2)
        self.near[self._hash(pairs[:, 0], pairs[:, 1])] = True

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether nothing merges across the place before each character; true for the first."""
        out = np.ones(len(codes), bool)
        out[1:] = ~self.near[self._hash(codes[:-1], codes[1:])]
        return out

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that symbols a and b make, ``other`` for none."""
        key = a.astype(np.int64) * (self.other + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.other)

    def merged(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of symbols of each word, symbols of all) of words of up to ``width`` characters: see ``Codec.merged``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # a row for each word, with a place in front and one behind that join with nothing
        wide = width + 2
        sym = np.full((len(words), wide), self.other, np.int32)
        held = (np.arange(wide) > 0) & (np.arange(wide) <= sizes[:, None])
        sym[held] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        to = np.full(sym.shape, self.other, np.int32)
        to[:, :-1] = self.joined(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(-1, wide - 1)
        after, before = (np.tile(np.arange(wide, dtype=np.int16) + i, (len(words), 1)) for i in (1, -1))
        rank, row, out = self.rank[to], np.arange(len(words)), sym.copy()
        while len(row):
            best = rank.argmin(1)
            live = rank[np.arange(len(row)), best] < LAST
            if 2 * live.sum() <= len(row):  # those that are done are put away
                out[row[~live]] = sym[~live]
                sym, to, after, before, rank, row, best = (x[live] for x in (sym, to, after, before, rank, row, best))
                live = live[live]
            r = np.flatnonzero(live)
            i = best[r]
            j, new = after[r, i], to[r, i]
            k, h = after[r, j], before[r, i]
            sym[r, i], sym[r, j], rank[r, j], after[r, i], before[r, k] = new, -1, LAST, k, i
            for x, a, b in ((i, new, sym[r, k]), (h, sym[r, h], new)):
                to[r, x] = piece = self.joined(a, b)
                rank[r, x] = self.rank[piece]
        held &= out >= 0
        return held.sum(1), out[held]


class Codec(dict):
    """word -> (ids, bytes of each piece), the words beginning with U+2581.

    Bytes are those of the source where the model has plain rules, else those of the normalised text.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rule, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != BPE or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("only merge models without user-defined or unused pieces")
        self.map = CharMap(rule.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.unk, self.begin, self.end = kinds.index(UNKNOWN), *(next(i for i, p in enumerate(proto.pieces) if p.piece == s) for s in (proto.trainer_spec.bos_piece, proto.trainer_spec.eos_piece))
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.plain = self.apart and self.prefix and self.escape and not (self.map.units or self.squeeze or self.suffix)
        surface = {UNKNOWN: proto.trainer_spec.unk_surface.encode(), CONTROL: b""}
        self.kinds = kinds
        self.table = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else surface.get(p.type, p.piece.replace(SPACE, " ").encode()) for p in proto.pieces]
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        if self.plain:
            self.merges = Merges(self.ids, self.scores)
            self.sizes = np.array([len(p.piece.encode()) - 2 * p.piece.count(SPACE) for p in proto.pieces], np.uint16)
            # stretch -> its number, how many ids those of each number have, and all ids with the bytes of their pieces
            self.known: dict[str, int] = {}
            self.counts, self.flat = np.zeros(0, np.int64), (np.zeros(0, np.uint32), np.zeros(0, np.uint16))

    def merged(self, word: str) -> list[str]:
        """The symbols that are left when, again and again, the neighbours with the best score (the first of them) are joined."""
        if len(word) >= LONG:
            return self._merged_long(word)
        at, get = list(word), self.scores.get
        found = [get(a + b, NEVER) for a, b in zip(at, at[1:])]
        while found and (best := max(found)) != NEVER:
            i = found.index(best)
            at[i : i + 2] = [at[i] + at[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get(at[i - 1] + at[i], NEVER)
            if i < len(found):
                found[i] = get(at[i] + at[i + 1], NEVER)
        return at

    def _merged_long(self, word: str) -> list[str]:
        at, after, before = list(word), [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            score = self.scores.get(at[i] + at[j])
            if score is not None:
                heapq.heappush(heap, (-score, i, at[i], at[j]))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue  # one of them has been joined with another since
            at[i], at[j], after[i] = a + b, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in at if x]

    def made(self, word: str, source: bool) -> tuple[bytes, bytes]:
        ids, sizes = array("I"), array("H")
        for piece in self.merged(word):
            n = len(piece.encode())
            own = n - 2 * piece.count(SPACE) if source else n
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
                sizes.append(own)
            elif self.bytes:
                # the last byte stands for the whole character, the others for nothing
                ids.extend(self.bytes[b] for b in piece.encode())
                sizes.extend([0] * (n - 1) + [own])
            else:
                ids.append(self.unk)
                sizes.append(own)
        return ids.tobytes(), sizes.tobytes()

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        out = self.made(word, self.plain)
        if len(self) < CACHE and len(word) < LONG:
            self[word] = out
        return out

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is split, and for each of its bytes (and its end) the byte of the source it came from."""
        data, at, parts = text.encode(), 0, []
        while at < len(data):  # (replacement, its place in the source)
            found = self.map.longest(data, at)
            if found is None:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = n, data[at : at + n]
            parts.append((found[1], at))
            at += found[0]
        space, end = SPACE.encode() if self.escape else b" ", len(data)
        if self.squeeze:
            parts = parts[next((k for k, (x, _) in enumerate(parts) if x != b" "), len(parts)) :]
        front = [(b" ", parts[0][1])] if parts and self.prefix and not self.suffix else []
        if self.squeeze:
            parts = self._squeezed(parts)
        parts = front + parts
        written = [(x.replace(b" ", space), i) for x, i in parts]
        align = np.repeat(np.array([i for _, i in written], np.int64), [len(x) for x, _ in written])
        norm = b"".join(x for x, _ in written)
        if self.squeeze:  # spaces at the end go, those that the source wrote as U+2581 too
            while norm.endswith(space):
                norm, end = norm[: -len(space)], int(align[len(norm) - len(space)])
            align = align[: len(norm)]
        if parts and self.prefix and self.suffix:
            norm, align = norm + space, np.r_[align, [end] * len(space)]
        return norm.decode(), np.r_[align, end]

    @staticmethod
    def _squeezed(parts: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
        """Without spaces in front, and one for each run of spaces."""
        out: list[tuple[bytes, int]] = []
        for x, i in parts:
            if not out or out[-1][0].endswith(b" "):
                x = x.lstrip(b" ")
            if x:
                out.append((x, i))
        return out

    def encode(self, text: str) -> tuple[bytes, bytes, bytes]:
        """(ids, starts, ends), unsigned 32 bits each, of all pieces with the begin and end ids; spans are bytes of ``text``."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """``encode`` of each text; of plain ones, parts of PART characters or so are taken at a time, be they many texts or one."""
        plain = [self.plain and SPACE not in text for text in texts]
        parts = self._plain_parts(text for text, x in zip(texts, plain, strict=True) if x)
        for text, x in zip(texts, plain, strict=True):
            size = len(text.encode())
            if x:
                got = [next(parts)]
                while got[-1] is not None:
                    got.append(next(parts))
                ids, lengths = got[0][:2] if len(got) == 2 else (np.concatenate(y) for y in zip(*got[:-1]))
                # the space in front is none of the source's
                ends = np.maximum(np.cumsum(lengths, dtype=np.int64) - 1, 0)
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
            else:
                norm, align = self.normalised(text)
                words = _WORD.findall(norm) if self.apart else [norm] if norm else []
                found = [self.made(w, False) if self.plain else self[w] for w in words]
                ids, n = np.frombuffer(b"".join(y[0] for y in found), "<u4"), np.frombuffer(b"".join(y[1] for y in found), "<u2").astype(np.int64)
                at = np.cumsum(n)
                starts, ends = align[at - n], align[at]
            yield tuple(_edged(*y) for y in ((ids, self.begin, self.end), (starts, 0, size), (ends, 0, size)))

    def _plain_parts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """(ids, bytes of each piece) of the parts of each text, one at least, and then None."""
        some: list[tuple[str, bool]] = []
        room = PART

        def flush():
            got = iter(self._stretches([x for x, _ in some]))
            for _, last in some:
                yield next(got)
                if last:
                    yield None
            some.clear()

        for text in texts:
            at = 0
            while True:
                cut = _CUT.search(text, at + PART) if len(text) > at + PART else None
                end = cut.start() if cut else len(text)
                some.append((((SPACE if not at and text else "") + text[at:end].replace(" ", SPACE)), end == len(text)))
                room, at = room - (end - at), end
                if room < 0:
                    yield from flush()
                    room = PART
                if at == len(text):
                    break
        yield from flush()

    def _stretches(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bytes of each piece) of each part, merged by stretches that nothing merges with."""
        text = "".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.cumsum([0, *map(len, parts)])
        cut = np.r_[self.merges.cuts(codes), True]
        cut[ends] = True
        n = np.cumsum(cut)
        sign = next(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if c not in text)
        apart = np.full(max(len(codes) + n[-1] - 2, 0), ord(sign), "<u4")
        apart[np.arange(len(codes)) + n[:-1] - 1] = codes
        words = apart.tobytes().decode("utf-32-le").split(sign) if len(codes) else []
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        fresh, counts, flat = self._fresh(dict.fromkeys(words[i] for i in missing))
        own = dict(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh))))
        at[missing] = [own[words[i]] for i in missing]
        counts, flat = np.r_[self.counts, counts], tuple(map(np.concatenate, zip(self.flat, flat)))
        if len(self.known) < CACHE and fresh:
            kept = next((i for i, w in enumerate(fresh) if len(w) >= LONG), len(fresh))  # long ones come last
            self.known.update(zip(fresh[:kept], own.values()))
            self.counts = counts[: len(self.known)]
            self.flat = tuple(x[: self.counts.sum()] for x in flat)
        size = counts[at]
        upto = np.r_[0, np.cumsum(size)]
        places = np.repeat((np.cumsum(counts) - counts)[at] - upto[:-1], size) + np.arange(upto[-1])
        ids, lengths = (x[places] for x in flat)
        bounds = upto[n[ends] - 1].tolist()
        return ((ids[a:b], lengths[a:b]) for a, b in zip(bounds, bounds[1:]))

    def _fresh(self, words: Iterable[str]) -> tuple[list[str], np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Words, those of LONG characters and more last, how many ids each has, and all (ids, bytes of their pieces)."""
        groups: list[list[str]] = [[] for _ in WIDTHS]
        rest, done, counts, ids, sizes = [], [], [], [], []
        for w in words:
            (rest if len(w) >= LONG or len(w) < 2 else groups[next(i for i, x in enumerate(WIDTHS) if len(w) <= x)]).append(w)
        for group, width in zip(groups, WIDTHS, strict=True):
            if not group:
                continue
            n, symbols = self.merges.merged(group, width)
            # characters that are no pieces are written otherwise
            odd = np.bincount(np.repeat(np.arange(len(group)), n)[symbols >= self.merges.pieces], minlength=len(group)) > 0
            if odd.any():
                rest += [w for w, x in zip(group, odd) if x]
                group, symbols, n = [w for w, x in zip(group, odd) if not x], symbols[~np.repeat(odd, n)], n[~odd]
            done += group
            counts.append(n)
            ids.append(symbols.astype(np.uint32))
            sizes.append(self.sizes[symbols])
        for w in sorted(rest, key=len):
            x, y = self.made(w, True)
            ids.append(np.frombuffer(x, np.uint32))
            sizes.append(np.frombuffer(y, np.uint16))
            counts.append([len(ids[-1])])
            done.append(w)
        return done, np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64), tuple(np.concatenate([np.zeros(0, x.dtype), *y]) for x, y in zip(self.flat, (ids, sizes)))

    def decode(self, ids: bytes) -> str:
        """The text of ids (unsigned 32 bits): bytes that form no character become U+FFFD each, the space in front goes."""
        order = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.table.__getitem__, order))
        cut = 0
        for i in order if self.prefix or self.squeeze else ():
            if self.table[i]:
                cut += i in self.spaced
                # where spaces in front go, a piece that is one gives its turn to the next
                if not (self.squeeze and i in self.spaced and self.table[i] == b" "):
                    break
        try:
            return out[cut:].decode()
        except UnicodeDecodeError:
            return self._broken(order)[cut:]

    def _broken(self, order: list[int]) -> str:
        out, run = [], b""
        for i in [*order, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.table[i]
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _is_char(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]
            if i is not None:
                out.append(self.table[i].decode())
        return "".join(out)


def _edged(x: np.ndarray, first: int, last: int) -> bytes:
    out = np.empty(len(x) + 2, "<u4")
    out[0], out[1:-1], out[-1] = first, x, last
    return out.tobytes()


def _is_char(x: bytes) -> bool:
    try:
        return len(x.decode()) == 1
    except UnicodeDecodeError:
        return False


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Codec(f.read())
    return _loaded[path]


def parts_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices with about ``limit`` bytes of a column, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


ENCODED = ["ids", "starts", "ends"]


def _added(df: DataFrame, names: list[str], kind) -> tuple[list[str], StructType]:
    rest = [c for c in df.columns if c not in names]
    return rest, StructType([df.schema[c] for c in rest] + [StructField(n, kind) for n in names])


def _encoding(rest: list[str], text: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in parts_of(batches, text):
            got = list(own.encode_all([t or "" for t in batch.column(text).to_pylist()]))
            more = [pa.array([g[i] for g in got], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more], [*rest, *ENCODED])

    return run


def _decoding(rest: list[str], ids: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in parts_of(batches, ids):
            got = pa.array([own.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), got], [*rest, "decoded"])

    return run


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, starts and ends added: little-endian unsigned 32-bit numbers, the begin and end ids included.

    starts and ends are bytes of the text's UTF-8. A piece made of the space in front alone, and all but the last of the byte
    pieces of a character, have an empty span. A null text counts as empty, and has the begin and end ids only. Rows that
    repeat are each encoded. Columns of ``docs`` named like the added ones are replaced. An empty table gives no rows.
    """
    rest, schema = _added(docs, ENCODED, BinaryType())
    return docs.mapInArrow(_encoding(rest, text, model), schema)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` added: the text of the ids. Null ids count as none. A column ``decoded`` is replaced."""
    rest, schema = _added(df, ["decoded"], StringType())
    return df.mapInArrow(_decoding(rest, ids, model), schema)


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``decode`` of ``encode``, in one pass through Python; the text itself is left out."""
    rest, schema = _added(docs, [*ENCODED, text, "decoded"], BinaryType())
    schema = schema.fields[: len(rest)] + _added(docs, ENCODED, BinaryType())[1].fields[-3:] + [StructField("decoded", StringType())]
    encoded, decoded = _encoding(rest, text, model), _decoding([*rest, *ENCODED], "ids", model)
    return docs.mapInArrow(lambda batches: decoded(encoded(batches)), StructType(schema))
