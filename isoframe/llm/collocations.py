"""Phrases that recur, by merged count-min sketches and an exact second pass.

1. Every task counts all n-grams of its texts, words included, in a sketch of fixed size: DEPTH rows of CELLS saturating
   counters. Sketches are cut into chunks, dealt by chunk and added. A merged counter is never less than the count of any n-gram
   that falls on it; only whether it reaches the threshold is kept, a bit for each counter, and broadcast (4 MB at most).
2. The second pass takes the n-grams whose counters, and those of all their parts, reach the threshold, folds them within blocks
   of text, and deals them to buckets by their hash, a row for each block and bucket; each bucket adds them up by their words.
   So no n-gram that is frequent is lost, and what is not is dropped by its exact count.
3. Every cut of a phrase looks its two parts up among the exact counts; the lowest score counts. Phrases within a longer one
   that is as frequent go. The first ones of each language are found in salted parts first, so that none is sorted whole.

The sketch bounds memory, not results: where a corpus has so many n-grams that most counters reach the threshold, the second
pass carries more of them, and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import Scratch, small, small_batches, written
from isoframe.llm.pieces import parts_of
from isoframe.llm.shingles import mix

LONGEST, MIN_COUNT, TOP, SUBSUMED = 5, 100, 2000, 100
#: Counters of a row of the sketch, and rows; a task holds two bytes for each.
CELLS, DEPTH = 1 << 24, 2
FULL = (1 << 15) - 1
#: Bytes of a chunk of counters, and of the text that is folded at once.
CHUNK, BLOCK = 1 << 18, 2 << 20
#: Buckets in which n-grams are added up, for each shuffle partition and in all at least; a task holds those of one.
BUCKETS, LEAST_BUCKETS = 4, 64
#: Parts of a language that are ranked apart, first.
SALTS = 64
#: Between pieces and between words; only A-Z are lower-cased.
_BREAKS, _BLANK = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes(10 if i in _BREAKS else 32 if i in _BLANK else i + 32 if 65 <= i <= 90 else i for i in range(256))
_SALT = mix(np.arange(1, 32, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


class Block:
    """The words of some text of one language: distinct ones, and at each place which, and how many follow in its piece."""

    def __init__(self, names: list[bytes], ids: np.ndarray, room: np.ndarray, new: np.ndarray):
        #: room: words from here to the end of the piece; new: of n-grams from here, the shortest that was not in the block before
        self.names, self.ids, self.room, self.new = names, ids, room, new


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(texts: list[str | None], longest: int = LONGEST, limit: int = BLOCK) -> Iterator[Block]:
    """The words of texts in blocks of about ``limit`` bytes; a piece that is longer is cut between words, with some repeated."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode().translate(_TABLE)
        held.append(data)
        size += len(data) + 1
        if size >= limit:
            yield from _cut(b"\n".join(held), longest, limit)
            held, size = [], 0
    if held:
        yield from _cut(b"\n".join(held), longest, limit)


def _cut(data: bytes, longest: int, limit: int) -> Iterator[Block]:
    at, carried = 0, []
    while at < len(data):
        end = len(data)
        if end - at > 2 * limit:
            found = [x for x in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if x >= 0]
            end = min(found, default=end)
        block, carried = _block(carried, data[at:end], longest)
        yield block
        at = end


def _block(carried: list[bytes], data: bytes, longest: int) -> tuple[Block, list[bytes]]:
    """The block of ``data``, which the words ``carried`` stand before; and the words that the next one is to repeat."""
    words = _Words({b"": 0, b"\n": 1})
    ids = np.fromiter(map(words.__getitem__, [*carried, *data.replace(b"\n", b" \n ").split(b" ")]), np.int64)
    ids = ids[ids != 0]
    last = np.flatnonzero(ids == 1)
    stop = np.r_[last, len(ids)]
    room = stop[np.searchsorted(stop, np.arange(len(ids)))] - np.arange(len(ids))
    # n-grams that lie within the repeated words were counted before
    new = np.maximum(len(carried) + 1 - np.arange(len(ids)), 1)
    names, keep = list(words), ids != 1
    tail = ids[(last[-1] + 1 if len(last) else 0) :][-(longest - 1) :]
    return Block(names, ids[keep], room[keep], new[keep]), [names[i] for i in tail.tolist()]


def hashes(block: Block, lang: str) -> np.ndarray:
    """A 64-bit hash of each distinct word in its language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in block.names], np.uint64)


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(h ^ _SALT[row]) & np.uint64(cells - 1)).astype(np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    for batch in parts_of(batches, "text", 2 * BLOCK):
        found: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(lang, []).append(text)
        yield from found.items()


def sketched(docs: DataFrame, longest: int, cells: int, depth: int) -> DataFrame:
    """(chunk, counters) of the sketch of each task; chunks that no n-gram falls on are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((depth, cells), np.uint16)
        for lang, texts in _by_language(batches):
            for block in blocks(texts, longest):
                word = hashes(block, lang)[block.ids]
                h, n_places = np.zeros(len(word), np.uint64), len(word)
                for n in range(1, min(longest, n_places) + 1):
                    h = mix(h[: n_places - n + 1] + word[n - 1 :] * _SALT[n + 8])
                    ok = h[(block.room[: len(h)] >= n) & (block.new[: len(h)] <= n)]
                    for row in range(depth):
                        at, own = _cells(ok, row, cells), sketch[row]
                        for lo in range(0, len(at), FULL):  # counters hold at most FULL before, so that none overflows
                            some = at[lo : lo + FULL]
                            np.add.at(own, some, 1)
                            own[some] = np.minimum(own[some], FULL)
        pack = zstandard.ZstdCompressor(level=1)
        flat = sketch.reshape(-1)
        for k in range(0, len(flat), CHUNK // 2):
            part = flat[k : k + CHUNK // 2]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([2 * k // CHUNK], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], ["chunk", "counters"])

    # about eight parts of the input share a sketch, where they are more than the cluster has room for
    parts = docs.rdd.getNumPartitions()
    few = max(4 * docs.sparkSession.sparkContext.defaultParallelism, parts // 8)
    return docs.select("lang", "text").coalesce(min(few, parts) or 1).mapInArrow(run, "chunk int, counters binary")


def merged(sketches: DataFrame, threshold: int) -> DataFrame:
    """(chunk, bits): which counters of a chunk, added up over all sketches, reach the threshold. One sketch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, total = zstandard.ZstdDecompressor(), None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= threshold).tobytes()], pa.binary())], ["chunk", "bits"])
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column("chunk")[i].as_py()
                own = np.frombuffer(unpack.decompress(batch.column("counters")[i].as_py()), np.uint16).astype(np.int64)
                if chunk == now:
                    total = total + own
                    continue
                if now is not None:
                    yield out()
                now, total = chunk, own
        if now is not None:
            yield out()

    return sketches.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary")


def survivors(docs: DataFrame, bits: DataFrame, longest: int, cells: int, depth: int, buckets: int) -> DataFrame:
    """(bucket, lang, phrases, counts): n-grams that may be frequent, folded by block, a line each; and the words, as an empty line."""
    table = np.zeros(depth * cells // 8, np.uint8)
    for chunk, part in ((r["chunk"], r["bits"]) for r in bits.toLocalIterator()):  # of fixed size, whatever the corpus
        table[chunk * CHUNK // 16 : chunk * CHUNK // 16 + len(part)] = np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reaches = np.frombuffer(shared.value, np.uint8).reshape(depth, -1)

        def frequent(h: np.ndarray) -> np.ndarray:
            ok = np.ones(len(h), bool)
            for row in range(depth):
                at = _cells(h, row, cells)
                ok &= (reaches[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            return ok

        for lang, texts in _by_language(batches):
            for block in blocks(texts, longest):
                names, counts, h = _folded(block, lang, longest, frequent)
                dealt = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(dealt, kind="stable")
                found, starts = np.unique(dealt[order], return_index=True)
                parts = list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True))
                lines = [b"\n".join([names[i] for i in order[lo:hi].tolist()]) for _, lo, hi in parts]
                numbers = [counts[order[lo:hi]].tobytes() for _, lo, hi in parts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([lang] * len(parts), pa.string()), pa.array(lines, pa.binary()), pa.array(numbers, pa.binary())], ["bucket", "lang", "phrases", "counts"])

    return docs.select("lang", "text").mapInArrow(run, "bucket long, lang string, phrases binary, counts binary")


def _folded(block: Block, lang: str, longest: int, frequent) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Names, counts and hashes of a block's n-grams that may be frequent, and first of its words, under no name."""
    own = hashes(block, lang)
    size = len(own)
    # a hash of one word is the first step of every longer one
    first = mix(own * _SALT[9])
    known = frequent(first)
    at = np.flatnonzero(known[block.ids])  # places at which a phrase that may be frequent begins
    h, which, names, each = first[block.ids[at]], block.ids[at], block.names, first
    alive = np.zeros(len(block.ids) + 1, bool)
    alive[at] = True
    all_names, all_counts, all_hashes = [b""], [np.array([(block.new <= 1).sum()], np.int64)], [np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64)]
    for n in range(1, longest + 1):
        if n > 1:
            fits = (block.room[at] >= n) & alive[np.minimum(at + 1, len(alive) - 1)]
            at, h, which = at[fits], h[fits], which[fits]
            word = block.ids[at + n - 1]
            h = mix(h + own[word] * _SALT[n + 8])
            ok = frequent(h)
            at, h, pairs = at[ok], h[ok], which[ok] * size + word[ok]
            seen, place, which = np.unique(pairs, return_index=True, return_inverse=True)
            each = h[place]
            names = [names[a] + b" " + block.names[b] for a, b in zip((seen // size).tolist(), (seen % size).tolist(), strict=True)]
            alive[:] = False
            alive[at] = True
        counts = np.bincount(which[block.new[at] <= n], minlength=len(names))
        used = np.flatnonzero(counts)
        all_names += [names[i] for i in used.tolist()]
        all_counts.append(counts[used].astype(np.int64))
        all_hashes.append(each[used])
    return all_names, np.concatenate(all_counts), np.concatenate(all_hashes)


def added_up(folded: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, n, f) of all n-grams that occur ``min_count`` times; phrase null: the words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            kept = [(p, f) for p, f in held.items() if f >= min_count or not p]
            for lo in range(0, len(kept), 20_000):
                some = kept[lo : lo + 20_000]
                phrase = pa.array([p.decode() if p else None for p, _ in some], pa.string())
                n = pa.array([p.count(b" ") + 1 if p else 0 for p, _ in some], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(some), pa.string()), phrase, n, pa.array([f for _, f in some], pa.int64())], ["lang", "phrase", "n", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("bucket")[i].as_py(), batch.column("lang")[i].as_py()
                if key != now:
                    yield from out()
                    now, held = key, {}
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int64).tolist()
                for p, f in zip(batch.column("phrases")[i].as_py().split(b"\n"), counts, strict=True):
                    held[p] = held.get(p, 0) + f
        yield from out()

    keys = ["bucket", "lang"]
    return folded.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, phrase string, n int, f long")


def counted(docs: DataFrame, longest: int, min_count: int, cells: int, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written: (lang, phrase, n, f) of all n-grams that occur ``min_count`` times, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    with small_batches(spark):
        bits = scratch.written(merged(sketched(docs, longest, cells, depth), min_count), "bits")
        exact = scratch.written(added_up(survivors(docs, bits, longest, cells, depth, buckets), min_count), "phrases")
    return exact.where("phrase IS NOT NULL"), scratch.written(exact.where("phrase IS NULL").select("lang", F.col("f").alias("n")), "words")


def _join(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score) of phrases of two words or more, by their lowest-scoring cut."""
    part = lambda name: counts.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_part"), F.col("f").alias(name))
    words = F.split("phrase", " ")
    cuts = counts.where("n > 1").select("lang", "phrase", F.col("n").alias("n_words"), F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("*", _join(F.col("w"), F.lit(1), F.col("k")).alias("first"), _join(F.col("w"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest")).drop("w")
    cuts = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_part")))
    cuts = cuts.join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_part")))
    cuts = cuts.join(small(totals), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # both products have at most 38 digits
    over = (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(38,0)") * big("n")
    cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", (big("l") * big("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "phrase", "n_words", "a", "n").agg(best.alias("b")).select("lang", "phrase", "n_words", "a", "b.l", "b.r", "n", "b.score")


def covered(counts: DataFrame, longest: int, percent: int) -> DataFrame:
    """(lang, phrase) of phrases within a longer one with ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    spans = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for n in range(2, longest) for at in range(1, longest - n + 2)])
    inside = F.filter(spans, lambda s: (s["n"] < F.col("n_long")) & (s["at"] + s["n"] - 1 <= F.col("n_long")))
    longer = counts.where("n > 2").select("lang", words.alias("w"), F.col("n").alias("n_long"), "f")
    longer = longer.select("lang", "w", "f", F.explode(inside).alias("s")).select("lang", _join(F.col("w"), F.col("s.at"), F.col("s.n")).alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    both = most.join(counts.select("lang", "phrase", F.col("f").alias("a")), ["lang", "phrase"])
    return both.where(F.lit(100).cast("decimal(19,0)") * F.col("longer") >= F.lit(percent).cast("decimal(19,0)") * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, percent: int = SUBSUMED, cells: int = CELLS, depth: int = DEPTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z) and split into pieces, and those into words; phrases lie within pieces. a: occurrences, overlaps
    included; l and r: those of the two parts at the lowest-scoring cut (ties: the first); n: words of the language; score:
    floor(1000 * a * n / (l * r)). A phrase inside a longer one with ``percent`` of its occurrences or more is left out. Order:
    score and a descending, then the phrase by its bytes, so that there are no ties. A null language is ``und``; a null text
    is empty; rows that repeat count each. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    if not 1 <= min_count <= FULL:
        raise ValueError(f"min_count must be from 1 to {FULL}")
    if cells & (cells - 1) or cells < CHUNK // 2:
        raise ValueError(f"cells must be a power of two, {CHUNK // 2} or more")
    scratch = Scratch()
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts, totals = counted(own, longest, min_count, cells, depth, scratch)
    kept = scored(counts, totals).join(covered(counts, longest, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", first("lang", "salt")).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", first("lang").cast("long")).where(F.col("rank") <= top)
    out = written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.forget()
    return out


ORACLE_SQL = """
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM places, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT g.lang, g.phrase, g.f AS a, c, string_split(g.phrase, ' ') AS w FROM grams g, (VALUES (1), (2), (3), (4)) s(c) WHERE g.k > 1 AND c < g.k),
each AS (SELECT c.lang, c.phrase, c.a, c.c, l.f AS l, r.f AS r, t.n, (1000 * c.a * t.n) // (l.f * r.f) AS score FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.c], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1 :], ' ')),
best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, string_split(phrase, ' ') AS w, k, f FROM grams WHERE k > 2),
inside AS (SELECT lang, array_to_string(w[p : p + m - 1], ' ') AS phrase, max(f) AS f FROM longer, (VALUES (2), (3), (4)) s(m), (VALUES (1), (2), (3), (4)) q(p) WHERE m < k AND p + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
SELECT lang, row_number() OVER w AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= 2000
"""
