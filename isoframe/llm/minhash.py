"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: elements are thrown into BINS bins in rounds of a hash each; in round i < BINS an element falls into a random bin,
in round BINS + j into bin j, with its hash as value; a bin keeps the least (round, value). The rounds end when no bin is
empty, at the latest after 2 * BINS, so every coordinate is filled, and a set of many elements takes one round or two.

Banding: coordinates are hashed in BANDS bands; documents that share a band are candidates. Texts of the same shingle set
count as one node first. Within a band's bucket each node is first compared with the bucket's least node, and only nodes
that stay in different components after that are compared with each other, in blocks of bounded size, by their sketches.
Nodes already known to be connected are not compared. Sketches only rule comparisons out; what they leave is verified on
the full shingle sets (each shingle a 64-bit number made of keyed digests of its words) within the block, and only links that connect components leave it, so that no list of pairs grows
with the square of a bucket. Each link is exact; a pair at similarity 0.75 is missed by all bands with probability 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import Scratch, free, slices, small, small_batches, written
from isoframe.llm.components import connected_components
from isoframe.llm.shingles import mix, shingle_sets

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BINS, BANDS = 128, 32
#: Of 128 coordinates, those that must agree for a pair to be verified: at 0.75 about 96 do, with a deviation of 5.
AGREE = 64
#: Nodes of a bucket that are compared at once.
BLOCK = 256
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(elements: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set of 64-bit hashes that is not empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    done, n = 0, len(elements)
    while done < 2 * BINS:
        rounds = np.arange(done, min(2 * BINS, done + max(1, 1024 // n)))
        values = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = np.where(rounds[:, None] < BINS, values & np.uint64(BINS - 1), (rounds[:, None] - BINS).astype(np.uint64)).astype(np.int64)
        keyed = (rounds[:, None].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
        np.minimum.at(out, bins.ravel(), keyed.ravel())
        done = int(rounds[-1]) + 1
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


SKETCHES = "id {0}, tkey long, n long, sig binary, bands array<bigint>, bytes binary"


def sketches(docs: DataFrame, text: str, doc_id: str, words: int = WORDS) -> DataFrame:
    """Per row: id, a key of the text, the set's size, its digest, band hashes and one byte of each coordinate."""
    kind = dict(docs.dtypes)[doc_id]
    salts = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            n, sig, bands, coords = [], [], [], []
            for elements in shingle_sets(texts, words):
                n.append(len(elements))
                sig.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest())
                if not len(elements):
                    bands.append(None)
                    coords.append(None)
                    continue
                s = sketch(elements)
                rows = (mix(s) * salts).reshape(BANDS, -1).sum(1, dtype=np.uint64)
                bands.append(mix(rows + np.arange(BANDS, dtype=np.uint64)).astype(np.int64))
                coords.append((mix(s) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(coords, pa.binary())],
                ["id", "tkey", "n", "sig", "bands", "bytes"],
            )

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("tkey"), body.alias("body")).mapInArrow(run, SKETCHES.format(kind))


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose set sizes and sketches allow a link."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bytes").alias(f"s{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                ok = pa.array((x == y).sum(1) >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    kind = dict(nodes.dtypes)["id"]
    return full.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (k, i, j), which come together: the members of blocks i and j of bucket k, some 2 * BLOCK at most."""
    held: pa.Table | None = None
    for batch in _then_none(slices(batches, 4 * BLOCK)):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        key = np.stack([held[c].to_numpy() for c in ("k", "i", "j")], 1)
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        if batch is not None:
            bounds.pop()  # the last group may go on in the next batch
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                yield held.slice(lo, hi - lo)
        held = held.slice(bounds[-1])


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _candidates(rows: pa.Table, x: int, percent: int) -> np.ndarray:
    """Which rows of a group are to be compared with row x: of another component, of a size that allows a link, each pair once."""
    ids, comp, n, part = (rows[c].to_numpy() for c in ("id", "comp", "n", "part"))
    ok = (comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
    if rows["i"][0].as_py() == rows["j"][0].as_py():
        return ok & (ids > ids[x])
    return ok & (part == 1) if part[x] == 0 else np.zeros(len(ids), bool)


def _live(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of a group whose sketch agrees with that of a candidate."""
    for rows in _groups(batches):
        s = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(-1, BINS)
        live = np.zeros(rows.num_rows, bool)
        for x in range(rows.num_rows):
            at = np.flatnonzero(_candidates(rows, x, percent))
            at = at[(s[at] == s[x]).sum(1) >= AGREE]
            if len(at):
                live[at] = live[x] = True
        if live.any():
            yield from rows.drop_columns("bytes").filter(pa.array(live)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links within groups: of all that hold, those that a spanning forest of the components needs."""
    for rows in _groups(batches):
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(names), np.int32)
        ids, comp = rows["id"].to_pylist(), rows["comp"].to_pylist()
        root = {c: c for c in comp}

        def find(c, root=root):
            while root[c] != c:
                c = root[c]
            return c

        left, right = [], []
        for x in range(len(ids)):
            ok = _candidates(rows, x, percent)
            if not ok.any():
                continue
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            for y in np.flatnonzero(ok & (100 * both >= percent * (sizes + sizes[x] - both))).tolist():
                a, b = find(comp[x]), find(comp[y])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(min(ids[x], ids[y]))
                    right.append(max(ids[x], ids[y]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(x, rows["id"].type) for x in (left, right)], ["a", "b"])


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, set): the full sets, as sorted 64-bit hashes."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x.tobytes() for x in shingle_sets([t.encode() for t in batch.column(1).to_pylist()], words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "set"])

    return texts.select("id", "body").mapInArrow(run, f"id {kind}, set binary")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs that are links by their full shingle sets."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("body").alias(f"t{x}"))
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ok = []
            bodies = [t.encode() for c in (2, 3) for t in batch.column(c).to_pylist()]
            sets = list(shingle_sets(bodies, words))
            for x, y in zip(sets[: batch.num_rows], sets[batch.num_rows :], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(run, f"a {kind}, b {kind}")


def components_of(docs: DataFrame, text: str, doc_id: str, percent: int, words: int) -> DataFrame:
    """(__id, __t, n, c), written, for each different id and key of a text: the size of its set and its component's least id."""
    with small_batches(docs.sparkSession):
        return _components_of(docs, text, doc_id, percent, words)


def _components_of(docs: DataFrame, text: str, doc_id: str, percent: int, words: int) -> DataFrame:
    scratch = Scratch()
    kind = dict(docs.dtypes)[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    sk = scratch.written(sketches(docs, text, doc_id, words), "sketches")
    # a node is a distinct set, named by its least id
    first = F.min_by(F.struct("tkey", "n", "bands", "bytes"), "id")
    nodes = sk.where("n > 0 AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id"), first.alias("f")).select("id", "sig", "f.*")
    nodes = scratch.written(nodes, "nodes")
    bands = nodes.select("id", F.explode("bands").alias("k"))
    buckets = scratch.written(bands.groupBy("k").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    shared = scratch.written(bands.join(buckets, "k"), "shared")  # k, id, a, m
    texts_of = lambda ids: _texts(docs, doc_id, body, nodes, ids, scratch)
    pairs = scratch.written(_alike(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), nodes, percent), "star_pairs")
    texts = texts_of(pairs)
    links = scratch.written(_verify(pairs, texts, percent, words), "star_links")
    comps = scratch.written(connected_components(links), "star_components")
    # nodes of a bucket that are still apart
    at = shared.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    at = scratch.written(at.select("k", "id", "comp"), "placed")
    # those of its largest component need no comparison with each other: they meet only the blocks of the rest
    sizes = at.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("k").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.max("c").alias("c"), F.sum("c").alias("m")).where("m > c")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("k", "largest", blocks(F.col("m") - F.col("c")).alias("n_rest"), blocks(F.col("c")).alias("n_largest"))
    within, dealt = F.col("comp") == F.col("largest"), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    apart = at.join(mixed, "k").withColumn("blk", F.when(within, F.col("n_rest") + dealt("n_largest")).otherwise(dealt("n_rest")))
    last = F.when(within, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_largest")) - 1
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    apart = apart.select("k", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("part"), "id", "comp")
    apart = apart.join(nodes.select("id", "n", "bytes"), "id").select("k", "i", "j", "part", "id", "comp", "n", "bytes")
    group = ["k", "i", "j"]
    place = f"k long, i int, j int, part int, id {kind}, comp {kind}, n long"
    live = apart.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda rows: _live(rows, percent), place)
    live = scratch.written(live, "live")
    if not live.isEmpty():
        sets = _sets(texts_of(live.select(F.col("id").alias("a"), F.col("id").alias("b"))), words)
        full = live.join(sets, "id").select("k", "i", "j", "part", "id", "comp", "n", "set")
        extra = full.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda rows: _links(rows, percent), f"a {kind}, b {kind}")
        extra = scratch.written(extra.distinct(), "more_links")
        comps = scratch.written(connected_components(links.unionByName(extra)), "components")
    named = nodes.select("sig", F.col("id").alias("node")).join(comps, "node", "left").select(F.col("sig").alias("s2"), F.coalesce("component", "node").alias("c"))
    per = sk.join(named, F.col("sig") == F.col("s2"), "left").select(F.col("id").alias("__id"), F.col("tkey").alias("__t"), "n", F.when(F.col("n") > 0, F.col("c")).alias("c"))
    per = per.where("__id IS NOT NULL").groupBy("__id", "__t").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    none = sk.where("id IS NULL").groupBy("tkey").agg(F.max("n").alias("n")).select(F.lit(None).cast(kind).alias("__id"), F.col("tkey").alias("__t"), "n", F.lit(None).cast(kind).alias("c"))
    found = written(per.unionByName(none), "found")
    scratch.forget()
    return found


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept added.

    A set: the distinct shingles of ``words`` words (A-Z lower-cased), all words as one shingle where there are fewer, empty
    without words or text. Documents of an empty set are linked with nothing. component_id: the least id that links reach,
    the document's own included; kept: it is that document. Rows of one id are one document of the graph, each with its own
    set size. A row without an id is linked with nothing: its component_id is null and it is kept. Columns of ``docs``
    named like the added ones are replaced. An empty table gives no rows.
    """
    added = ["n_shingles", "component_id", "kept"]
    rest = [c for c in docs.columns if c not in added]
    key, own, of, at, n, c = free(docs, "__key", "__own", "__of", "__at", "__n", "__c")
    found = components_of(docs, text, doc_id, percent, words).select(F.col("__id").alias(of), F.col("__t").alias(at), F.col("n").alias(n), F.col("c").alias(c))
    # the key is a column of its own, so that the join needs no text
    rows = docs.select(*rest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(key), F.col(doc_id).alias(own))
    return rows.join(found, (F.col(key) == F.col(at)) & F.col(own).eqNullSafe(F.col(of)), "left").select(
        *rest,
        F.col(n).alias("n_shingles"),
        F.coalesce(c, own).alias("component_id"),
        F.coalesce(c, own).eqNullSafe(F.col(own)).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps: only the ids of those that go are looked up, so texts stay where they are."""
    key, own, of, at = free(docs, "__key", "__own", "__of", "__at")
    gone = components_of(docs, text, doc_id, percent, words).where("c <> __id")
    gone = small(written(gone.select(F.col("__id").alias(of), F.col("__t").alias(at)), "gone"))
    rows = docs.select(*docs.columns, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(key), F.col(doc_id).alias(own))
    return rows.join(gone, (F.col(key) == F.col(at)) & F.col(own).eqNullSafe(F.col(of)), "left_anti").select(*docs.columns)


def _texts(docs: DataFrame, doc_id: str, body, nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, body) of the nodes that the pairs name."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = small(scratch.written(nodes.select("id", "tkey").join(ids, "id").select(F.col("id").alias("i2"), F.col("tkey").alias("t2")), "wanted"))
    rows = docs.select(F.col(doc_id).alias("id"), body.alias("body")).withColumn("tkey", F.xxhash64("body"))
    rows = rows.join(wanted, (F.col("id") == F.col("i2")) & (F.col("tkey") == F.col("t2")), "left_semi")
    return scratch.written(rows.dropDuplicates(["id", "tkey"]).select("id", "body"), "texts")
