"""Removal of passages that repeat across documents, by FM-indexes over shards.

1. Every window of WINDOW words has an anchor, the least hash of its K-word runs. Equal windows have equal anchors, so only
   anchors that two documents share can hold a repeat. Of each document its distinct anchors are counted (a shuffle of
   about one narrow row for 22 words). The shared ones go into a Bloom filter of bounded size; false positives cost time.
2. Documents are read again. Consecutive windows of one shared anchor form a segment; segments of equal words form a class
   with its least document: in all its other documents the segment repeats.
3. A shard holds the classes of some anchors. Its words are indexed (Burrows-Wheeler transform under a wavelet matrix);
   every class is then streamed backwards through the index, which tells for each stretch whether it also occurs in a
   smaller document. Anchors of very many classes are dealt in pairs of blocks, so a shard is bounded in size.
4. Repeats found in segments are put together by document and the words they cover are removed.

Anchors of a single class need no index: there is nothing else they could match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import free, slices, small, written
from isoframe.llm.fm_index import FMIndex, repeated
from isoframe.llm.shingles import mix

WINDOW = 50
K = 8
#: The filter's bits: BITS_PER_KEY for each shared anchor, MAX_BITS at most.
BITS_PER_KEY, MAX_BITS = 16, 1 << 28
SEGMENT_BITS = 1 << 21
#: Words of an index, about; classes of a block; words of a lane.
INDEX_WORDS, BLOCK, LANE = 400_000, 4000, 300
_SALTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Hasher(dict):
    """word -> 64-bit hash; forgets when it grows beyond bounds."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 300_000:
            self.clear()
        self[word] = value
        return value


def anchors(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the least k-run hash, and its place (the first of equals)."""
    n = len(words) - k + 1
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs += words[i : i + n] * _SALTS[i]
    runs = mix(runs)
    w = window - k + 1
    least, place, size = runs, np.arange(n), 1
    while size < w:  # the least of 2 * size, or of the last overlap that makes w
        step = min(size, w - size)
        a, b = least[:-step], least[step:]
        place = np.where(b < a, place[step:], place[:-step])
        least = np.minimum(a, b)
        size += step
    return least, place


def _scan(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("tkey"), body.alias("body"))


def _bits(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(n_bits - 1), mix(keys) & np.uint64(n_bits - 1)


def _bloom(shared: DataFrame) -> tuple[int, bytes]:
    """The filter of the shared anchors; its bytes are at most MAX_BITS / 8, made in segments by the executors."""
    n = shared.count()
    n_bits = SEGMENT_BITS
    while n_bits < min(MAX_BITS, BITS_PER_KEY * n):
        n_bits *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), n_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT_BITS), pa.array((at % SEGMENT_BITS).astype(np.int32))], ["seg", "bit"])

    def build(rows: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pa.table({"seg": rows["seg"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = shared.select("m").mapInArrow(spread, "seg long, bit int").groupBy("seg").applyInArrow(build, "seg long, bits binary")
    out = bytearray(n_bits // 8)
    for row in parts.toLocalIterator():
        at = row["seg"] * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = row["bits"]
    return n_bits, bytes(out)


def _segments(scan: DataFrame, bloom, kind: str, window: int, k: int) -> DataFrame:
    """(m, seg, id, tkey, at, len): the segments of windows whose anchor may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bits, data = bloom.value
        table = np.frombuffer(data, np.uint8)
        has = lambda at: table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        get = Hasher().__getitem__
        for batch in slices(batches):
            rows, out = [], []
            for row, body in enumerate(batch.column(2).to_pylist()):
                names = split(body)
                if len(names) < window:
                    continue
                words = np.array(list(map(get, names)), np.uint64)
                m, place = anchors(words, window, k)
                first, second = _bits(m, n_bits)
                maybe = (has(first) & has(second)).astype(bool)
                cut = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(m)]
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if maybe[lo]:
                        part = words[lo : hi + window - 1]
                        rows.append(row)
                        out.append((int(m[lo].view(np.int64)), hashlib.blake2b(part.tobytes(), digest_size=16).digest(), lo, hi - lo + window - 1))
            if rows:
                take = pa.array(rows)
                m, seg, at, size = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(seg, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(size, pa.int32())], ["m", "seg", "id", "tkey", "at", "len"])

    return scan.mapInArrow(run, f"m long, seg binary, id {kind}, tkey long, at int, len int")


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    """The words (as hashes) of the classes' own segments, from (id, body, segs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Hasher().__getitem__
        for batch in slices(batches):
            out = []
            for owner, body, segs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = np.array(list(map(get, split(body))), np.uint64)
                out += [(s["m"], s["blk"], s["nb"], s["seg"], owner, words[s["at"] : s["at"] + s["len"]].tobytes()) for s in segs]
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), batch.schema.field(0).type, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["m", "blk", "nb", "seg", "id", "words"])

    return rows.mapInArrow(run, f"m long, blk int, nb int, seg binary, id {kind}, words binary")


def judge_shard(words: list[bytes], owners: np.ndarray, window: int) -> list[list[dict[str, int]]]:
    """For each sequence the stretches [from, to) whose windows occur in a smaller owner's sequence."""
    lengths = np.array([len(w) // 8 for w in words])
    every, ids = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
    ids = ids.astype(np.int64) + 1
    begin = np.cumsum(lengths) - lengths
    index = FMIndex(ids, lengths, owners, len(every) + 1)
    # long sequences are searched in lanes that overlap by a window less a word
    step = LANE - window + 1
    lanes = np.maximum(1, -(-(lengths - window + 1) // step))
    of = np.repeat(np.arange(len(lengths)), lanes)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lo = begin[of] + nth * step
    hi = np.minimum(lo + LANE, begin[of] + lengths[of])
    hit = repeated(index, ids, lo, hi, owners[of], window)
    out = []
    for b, n in zip(begin.tolist(), lengths.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.r_[0, hit[b : b + n].astype(np.int8), 0]))
        out.append([{"from": x, "to": y} for x, y in edge.reshape(-1, 2).tolist()])
    return out


def _judge(rows: DataFrame, window: int) -> DataFrame:
    """(m, seg, from, to), rows being sorted by (m, i, j): groups are put together until they fill an index."""
    out_schema = pa.schema([("m", pa.int64()), ("seg", pa.binary()), ("from", pa.int32()), ("to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                m, _, _, seg, owner, words = zip(*held, strict=True)
                found = judge_shard(list(words), np.array(owner), window)
                flat = [(m[i], seg[i], s["from"], s["to"]) for i, spans in enumerate(found) for s in spans]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last and size >= INDEX_WORDS:
                    yield from out()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]) // 8, row[:3]
        yield from out()

    return rows.mapInArrow(run, "m long, seg binary, from int, to int")


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words left, joined by one space) added.

    A word is removed if a window of ``window`` words that covers it also starts in a document of a smaller id, whatever is
    removed there. Repeats within a document, or between rows of one id, remove nothing; rows without an id neither lose
    words nor cost any. Ids are whole numbers. A null text has no words, an empty table gives no rows. Columns of ``docs`` named like the added ones are replaced.
    """
    added = ["n_words", "n_removed", "kept_text"]
    rest = [c for c in docs.columns if c not in added]
    kind, spark = dict(docs.dtypes)[doc_id], docs.sparkSession
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind}")
    own, key, gone_, body_ = free(docs, "__id", "__t", "__spans", "__body")
    scan = _scan(docs, text, doc_id)

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Hasher().__getitem__
        for batch in slices(batches):
            rows, out = [], []
            for row, body in enumerate(batch.column(2).to_pylist()):
                names = split(body)
                if len(names) >= window:
                    m = np.unique(anchors(np.array(list(map(get, names)), np.uint64), window, k)[0])
                    rows.append(np.full(len(m), row))
                    out.append(m)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows)))], ["m", "id"])

    listed = scan.mapInArrow(list_anchors, f"m long, id {kind}")
    shared = written(listed.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("m"), "anchors")
    bloom = spark.sparkContext.broadcast(_bloom(shared))
    segs = written(_segments(scan, bloom, kind, window, k), "segments")
    classes = written(segs.groupBy("m", "seg").agg(F.min(F.struct("id", "tkey", "at", "len")).alias("own"), F.max("id").alias("hi")), "classes")
    groups = classes.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("own.id").alias("lo"), F.max("hi").alias("hi"))
    many = groups.where("n > 1 AND lo < hi").select("m", "n")
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    owned = classes.join(many, "m").withColumns({"nb": nb, "blk": F.pmod(F.xxhash64("seg"), nb).cast("int")})
    by_doc = owned.groupBy(F.col("own.id").alias("i2"), F.col("own.tkey").alias("t2")).agg(F.collect_list(F.struct("m", "blk", "nb", "seg", F.col("own.at").alias("at"), F.col("own.len").alias("len"))).alias("segs"))
    by_doc = small(written(by_doc, "owners"))
    bodies = scan.join(by_doc, (F.col("id") == F.col("i2")) & (F.col("tkey") == F.col("t2"))).select("id", "body", "segs")
    cut = _cut(bodies, kind).dropDuplicates(["m", "seg"]) if _repeats(docs, doc_id) else _cut(bodies, kind)
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("m", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "seg", "id", "words")
    found = _judge(dealt.repartition("m", "i", "j").sortWithinPartitions("m", "i", "j"), window)
    found = written(found.select(F.col("m").alias("fm"), F.col("seg").alias("fseg"), "from", "to").distinct(), "found")
    # what repeats in each row's segments: all of it where a smaller document has the class, else what the index found
    owner = classes.select(F.col("m").alias("cm"), F.col("seg").alias("cseg"), F.col("own.id").alias("lo"), (F.col("own.id") < F.col("hi")).alias("wide"))
    rows = segs.join(owner.where("wide"), (F.col("m") == F.col("cm")) & (F.col("seg") == F.col("cseg"))).where("id > lo")
    whole = rows.select("id", "tkey", F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("to"))
    firsts = segs.join(owner.where("NOT wide").unionByName(owner.where("wide")), (F.col("m") == F.col("cm")) & (F.col("seg") == F.col("cseg"))).where("id = lo")
    part = firsts.join(found, (F.col("m") == F.col("fm")) & (F.col("seg") == F.col("fseg"))).select("id", "tkey", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    spans = whole.unionByName(part).groupBy(F.col("id").alias(own), F.col("tkey").alias(key)).agg(F.collect_set(F.struct("from", "to")).alias(gone_))
    spans = small(written(spans, "spans"))
    body = F.coalesce(F.col(text), F.lit(""))
    full = docs.select(*rest).join(spans, (F.col(doc_id) == F.col(own)) & (F.xxhash64(body) == F.col(key)), "left").select(*rest, body.alias(body_), gone_)
    width = len(rest)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for body, spans in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                names = split(body)
                if spans:
                    gone = np.zeros(len(names), bool)
                    for s in spans:
                        gone[s["from"] : s["to"]] = True
                    left = [x for x, g in zip(names, gone.tolist(), strict=True) if not g]
                else:
                    left = names
                out.append((len(names), len(names) - len(left), b" ".join(left).decode()))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*rest, *added])

    schema = ", ".join(f"`{c}` {t}" for c, t in full.select(*rest).dtypes) + (", " if rest else "") + "n_words long, n_removed long, kept_text string"
    return full.mapInArrow(remove, schema)


def _repeats(docs: DataFrame, doc_id: str) -> bool:
    """Whether an id stands on several rows."""
    return not docs.groupBy(doc_id).count().where(F.col(doc_id).isNotNull() & (F.col("count") > 1)).isEmpty()


ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (g) WHERE doc_id > lo),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN hit ON pos.doc_id = hit.doc_id AND pos.p = hit.p GROUP BY pos.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
