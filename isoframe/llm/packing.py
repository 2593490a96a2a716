"""Best-fit packing of documents into training sequences under several capacities.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into full pieces after a shorter
first one. Pieces are dealt at random into groups of bounded size; in each, from the longest, a piece goes to the open
sequence with room for it in every dimension (tokens, documents, attention cost: the sum of squared lengths) whose
residual, weighted, has the least norm after it, or has the largest weighted dot-product with the piece.

A group leaves at most a few sequences partly filled, so the number of groups, one for GROUP pieces, costs next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import slices, small_batches, written
from isoframe.llm.tokens import encoder

TOKENS = 2048
GROUP = 20_000
#: The defaults never bind before the tokens do: a document has a token at least, and squares sum to at most the square.
DOCUMENTS = TOKENS
COST = TOKENS * TOKENS
#: Of tokens, documents, attention cost.
WEIGHTS = (1.0, 1e-3, 1e-3)

PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first one if it does not divide."""
    head = n % size or size
    at = 0
    while at < n:
        length = head if at == 0 else size
        yield at, length
        at += length


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32 bits) for every piece."""
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            rows, out, ids_out = [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                ids = encode(body or "") + end
                for i, (at, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append(row)
                    out.append((i, at, length, zlib.crc32(part)))
                    if with_ids:
                        ids_out.append(part)
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)]
                arrays = [batch.column(0).take(pa.array(rows)), *columns] + ([pa.array(ids_out, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *PIECES.names] + (["ids"] if with_ids else []))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity=(TOKENS, DOCUMENTS, COST), weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item; items are taken from the longest, ties by place."""
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1).astype(float)
    room, names, used, n_open, made = np.zeros((1024, 3)), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0, 0
    for i in order:
        v = need[i]
        where = -1
        if n_open:
            r = room[:n_open]
            fits = (r >= v).all(1)
            if fits.any():
                left = (r - v) / cap * w if rule == "norm" else None
                value = (left * left).sum(1) if rule == "norm" else -(r / cap * w) @ (v / cap)
                where = int(np.where(fits, value, np.inf).argmin())
        if where < 0:
            if n_open == len(names):
                room, names, used = np.vstack([room, np.zeros_like(room)]), np.r_[names, np.zeros_like(names)], np.r_[used, np.zeros_like(used)]
            where, n_open = n_open, n_open + 1
            room[where], names[where], used[where], made = cap, made, 0, made + 1
        bins[i], offsets[i] = names[where], used[where]
        room[where] -= v
        used[where] += lengths[i]
        if room[where, 0] < least or room[where, 1] < 1:
            n_open -= 1  # a full bin leaves; the last takes its place
            room[where], names[where], used[where] = room[n_open], names[n_open], used[n_open]
    return bins, offsets


def pack(cut_docs: DataFrame, capacity=(TOKENS, DOCUMENTS, COST), weights=WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset added."""
    with small_batches(cut_docs.sparkSession):
        cut_docs = written(cut_docs, "pieces")
    n = cut_docs.count()
    n_groups = max(1, -(-n // group))
    schema = ", ".join(f"`{c}` {t}" for c, t in cut_docs.dtypes) + ", sequence_id long, offset long"

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("__group").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n_groups))
    return cut_docs.withColumn("__group", dealt).groupBy("__group").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Cuts and packs every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat are packed each. An empty table gives no rows. Other columns
    of ``docs`` do not matter; join them back on the id.
    """
    return pack(pieces(docs, tokenizer, text, doc_id), **options)
