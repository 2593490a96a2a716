"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of 0 to ORDER bytes holds how often each byte followed. A byte's probability is
that of its longest known context: seen successors share n / (n + q) of the mass (n occurrences, q different successors),
the rest escapes to the next shorter context, where bytes already seen in the longer one are excluded; below the empty
context all bytes are equal. Statistics are frozen, so the code length of a seen byte in its context is tabled, and so is what
an escape from a context costs; a text's code length under a language is a sum of those, and the shortest names the language.

The trees are fitted on a bounded sample of labelled rows: about SAMPLE_ROWS per language, drawn by a hash of the id. All
contexts of the sample are kept, so no language's tree depends on another's; only the sample bounds the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import crc_of_id, forget, free, release, slices, small, small_batches, written

ORDER = 3
SAMPLE_ROWS = 3000
#: Bytes of text that are counted or scored at once.
CHUNK = 1 << 18


def held_out(doc_id) -> F.Column:
    return crc_of_id(doc_id) % 5 == 0


def _parts(texts: list[bytes], lead: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(text, bytes, lead bytes) of parts of the texts, about CHUNK bytes at once; a later part leads in with the end of the one before."""
    of, parts, leads, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            begin = max(0, at - lead)
            of.append(i)
            parts.append(text[begin : at + CHUNK])
            leads.append(at - begin)
            size += len(parts[-1])
            if size >= CHUNK:
                yield of, parts, leads
                of, parts, leads, size = [], [], [], 0
    if parts:
        yield of, parts, leads


def _codes(parts: list[bytes], size: int) -> np.ndarray:
    """The number that each ``size`` bytes of the parts, laid end to end, make, by the last of them."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    code = data.copy()
    for k in range(1, size):
        code[k:] += data[:-k] << (8 * k)
    return code


def _places(parts: list[bytes]) -> np.ndarray:
    lengths = np.array([len(p) for p in parts])
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of 1 to ORDER + 1 bytes by language, packed into a number."""
    release()
    for batch in slices(batches):
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            for _, parts, leads in _parts([t.encode() for t in texts], ORDER):
                place, lengths = _places(parts), [len(p) for p in parts]
                first = np.repeat(leads, lengths)
                for n in range(1, ORDER + 2):
                    code = _codes(parts, n)[(place >= n - 1) & (place >= first)]
                    codes, times = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(np.full(len(codes), n, np.int32)), pa.array(codes), pa.array(times.astype(np.int64))], ["lang", "size", "code", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Code-length tables from the rows that are not held out and have both a text and a language."""
    rows = docs.where(~held_out(doc_id)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = small(written(rows.groupBy("lang").count(), "languages"))
    draw = F.pmod("h", F.lit(1 << 20)) < F.lit(float((1 << 20) * sample_rows)) / F.col("count")
    sample = rows.join(sizes, "lang").where(draw).select("text", "lang")
    with small_batches(docs.sparkSession):
        grams = written(sample.mapInArrow(_count, "lang string, size int, code long, n long").groupBy("lang", "size", "code").agg(F.sum("n").alias("n")), "grams")
    got = grams.toArrow().to_pandas()  # what the sample holds
    forget(grams)
    return tables(got)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _cost(tree: dict, codes: np.ndarray, size: int) -> np.ndarray:
    """Nats of the last byte of each number after the ``size`` - 1 bytes before it; earlier ones do not count."""
    out, todo, now = np.zeros(len(codes)), np.arange(len(codes)), codes & ((1 << 8 * size) - 1)
    while size and len(todo):
        grams, costs, contexts, escapes = tree[size]
        at, seen = _find(grams, now)
        out[todo[seen]] += costs[at[seen]]
        todo, now = todo[~seen], now[~seen]
        at, known = _find(contexts, now >> 8)
        out[todo[known]] += escapes[at[known]]
        size -= 1
        now = now & ((1 << 8 * size) - 1)
    out[todo] += np.log(256)
    return out


def tables(grams: pd.DataFrame, order: int = ORDER) -> dict:
    """A tree for each language: by size of n-gram, the sorted n-grams and their nats, the sorted contexts and those of an escape."""
    trees = {}
    for lang, own in grams.groupby("lang"):
        tree: dict[int, tuple] = {}
        for size in range(1, order + 2):
            level = own[own["size"] == size].sort_values("code")
            code, n = level["code"].to_numpy(np.int64), level["n"].to_numpy(np.float64)
            if not len(code):
                break
            contexts, begin = np.unique(code >> 8, return_index=True)
            q = np.diff(np.append(begin, len(code)))
            total = np.add.reduceat(n, begin)
            # what the shorter context gives to bytes not seen here
            below = np.exp(-_cost(tree, code & ((1 << 8 * (size - 1)) - 1), size - 1)) if size > 1 else np.full(len(code), 1 / 256)
            left = np.where(q < 256, np.maximum(1 - np.add.reduceat(below, begin), 1e-12), 0)
            share = np.where(left > 0, total + q, total)
            with np.errstate(divide="ignore"):
                escapes = -np.log(q / share) + np.log(left)
            tree[size] = (code, -np.log(n / np.repeat(share, q)), contexts, escapes)
        trees[lang] = tree
    return {"langs": sorted(trees), "trees": trees, "order": order}


def code_lengths(model: dict, texts: list[bytes]) -> np.ndarray:
    """Nats of each text under each language."""
    langs, order = model["langs"], model["order"]
    out = np.zeros((len(texts), len(langs)))
    for of, parts, leads in _parts(texts, order):
        lengths = np.array([len(p) for p in parts])
        place, first = _places(parts), np.repeat(leads, lengths)
        text = np.repeat(of, lengths)
        for size in range(1, order + 2):
            here = (place == size - 1 if size <= order else place >= order) & (place >= first)
            if not here.any():
                continue
            of_code, codes = pd.factorize(_codes(parts, size)[here])
            at = text[here]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            for k, lang in enumerate(langs):
                out[at[begin], k] += np.add.reduceat(_cost(model["trees"][lang], codes, min(size, len(model["trees"][lang])))[of_code], begin)
    return out


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs = model["langs"]
    known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
    bits = code_lengths(model, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
    names, scores = [], []
    for k, row in zip(known, bits, strict=True):
        if not k:
            names.append("und")
            scores.append(0.0)
            continue
        best = int(np.argmin(row))
        names.append(langs[best])
        scores.append(float(1 / np.exp(np.maximum(row[best] - row, -700)).sum()))
    return names, scores


def identify(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, lang_pred and score (the share of the predicted language, all languages being equal before).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Whole texts are scored. Of
    languages with equal code lengths the first by name is taken. Rows are judged one by one; an empty table gives no rows.
    Columns of ``docs`` named like the added ones are replaced.
    """
    added = ["held_out", "lang_pred", "score"]
    rest = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for part in parts:
            names, scores = [], []
            for at in range(0, len(part), 256):
                found = predict(shared.value, part.slice(at, 256).to_pylist())
                names += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    (p,) = free(docs, "__p")
    judged = docs.select(*rest, held_out(doc_id).alias("held_out"), judge(F.col(text)).alias(p))
    return judged.select(*rest, "held_out", F.col(p)["lang_pred"].alias("lang_pred"), F.col(p)["score"].alias("score"))
