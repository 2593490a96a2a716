"""Language-model scoring by a weighted backoff automaton.

The model: all words of the training rows, and all n-grams to order 3 that occur MIN_COUNT times in them, whatever the size
of the input. A kept n-gram has its discounted probability; a context without the n-gram that follows falls back, weighted so
that every context is a probability distribution, to its next shorter suffix. Words have add-one shares.

The model grows with the input, so no process holds it. Texts are read as blocks of about BLOCK tokens; a block names its
distinct n-grams, dealt to buckets by ranges of a 64-bit hash, and each bucket answers every block with the counts of what it
asked for. Sizes go in turn, and an n-gram is asked for only if its two shorter ones were kept, as no other can be. Each kept
n-gram has one block that owns it, which tells the bucket of its context what it takes there; the sums are the context's
backoff. From all answers a block builds the states, arcs and failure arcs that its texts can reach, and walks them from left
to right with a state for each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import bucketed, crc_of_id, forget, free, slices, written

ORDER = 3
#: n-grams of two words or more are kept from this count on.
MIN_COUNT = 2
DISCOUNT = 0.5
#: Tokens of a block, and characters of text for which there is a bucket.
BLOCK, BUCKET_CHARS = 750_000, 6_000_000
#: Tokens of a text that are walked one after the other, beside those of others.
STRETCH = 1024
#: Buckets of a table that Spark allows; with more input each holds more blocks.
MOST_BUCKETS = 100_000
#: The end of a text; no word is empty.
END = b""


def held_out(doc_id) -> F.Column:
    return crc_of_id(doc_id) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> dict:
    """The model of the rows that are not held out. It is counted where it is asked, so this names its rows only."""
    return {"docs": docs, "text": text, "doc_id": doc_id, "order": order}


BLOCKS = "block long, ids array<{0}>, tkeys array<long>, held array<boolean>, sizes array<int>, symbols binary, vocabulary binary"
ASKED = "bucket int, block long, size int, grams binary, sent array<binary>"
ANSWERS = "block long, bucket int, size int, answer array<binary>, types long"


def _planes(x: np.ndarray) -> bytes:
    """Numbers packed by bytes of like significance: sorted hashes and places have few values in the high ones."""
    blob = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def _of_planes(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, len(blob) // width).T).view(kind).ravel()


def _blocks(side: int):
    """Texts as symbols of their block, whose vocabulary is word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = side << 60 | TaskContext.get().partitionId() << 28, 0
        ids, tkeys, held, sizes, symbols, vocabulary = [], [], [], [], [], defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        kind = pa.null()

        def out() -> pa.RecordBatch:
            hashes = b"".join([blake2b(w, digest_size=8).digest() for w in vocabulary])
            row = [[at], [ids], [tkeys], [held], [sizes], [_planes(np.concatenate(symbols))], [hashes]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["block", "ids", "tkeys", "held", "sizes", "symbols", "vocabulary"])

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for key, tkey, body, out_of in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = np.array([vocabulary[w] for w in tokens(body)], np.int32)
                ids.append(key)
                tkeys.append(tkey)
                held.append(out_of)
                sizes.append(len(found))
                symbols.append(found)
                n += len(found)
                if n >= BLOCK:
                    yield out()
                    at, n = at + 1, 0
                    for x in (ids, tkeys, held, sizes, symbols, vocabulary):
                        x.clear()
        if n:
            yield out()

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The distinct n-grams of a block by size, sorted by hash.

    ``at[n]``: for every token the place of the n-gram that ends there, -1 where there is none; ``last[n]``: for every n-gram
    a token where it ends. Of three words and more only n-grams are listed whose two shorter ones were kept, since no others
    can have been; ``signed`` gives the counts answered so far.
    """

    def __init__(self, row: dict, order: int, signed: dict[int, np.ndarray]):
        symbols, words = _of_planes(row["symbols"], np.int32), np.frombuffer(row["vocabulary"], np.uint64)
        sizes = np.array(row["sizes"], np.int64)
        self.name, self.starts = row["block"], np.cumsum(sizes) - sizes
        self.within = np.arange(len(symbols)) - np.repeat(self.starts, sizes)
        self.train = np.repeat(~np.array(row["held"], bool), sizes)
        self.grams, self.at, self.last = {}, {}, {}
        hashes = word = words[symbols]
        for n in range(1, order + 1):
            if n > 1:
                shifted = np.concatenate([hashes[:1], hashes[:-1]])
                hashes = _mixed(shifted * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n))
            ends = np.flatnonzero(self.within >= n - 1)
            if n > 2:
                kept = self.seen(n - 1, signed)
                ends = ends[kept[ends - 1] & kept[ends]]
            self.grams[n], place = np.unique(hashes[ends], return_inverse=True)
            self.at[n], self.last[n] = np.full(len(symbols), -1, np.int32), np.empty(len(self.grams[n]), np.int32)
            self.at[n][ends] = place
            self.last[n][place] = ends

    def seen(self, n: int, signed: dict[int, np.ndarray]) -> np.ndarray:
        """For every token, whether the n-gram that ends there was kept."""
        found = np.zeros(len(self.within), bool)
        ends = np.flatnonzero(self.at[n] >= 0)
        if n in signed:
            found[ends] = signed[n][self.at[n][ends]] != 0
        return found

    def context(self, n: int, grams: np.ndarray) -> np.ndarray:
        return self.at[n - 1][self.last[n][grams] - 1]

    def suffix(self, n: int, grams: np.ndarray) -> np.ndarray:
        return self.at[n - 1][self.last[n][grams]]

    def ask_counts(self, n: int, buckets: int) -> Iterator[tuple]:
        counts = np.bincount(self.at[n][self.train & (self.at[n] >= 0)], minlength=len(self.grams[n])).astype(np.int32)
        yield from _asked(self.name, n, self.grams[n], [counts], buckets)

    def ask_backoffs(self, n: int, signed: dict[int, np.ndarray], buckets: int) -> Iterator[tuple]:
        """Of each kept context of ``n`` words: how many kept n-grams that this block owns follow it, what their counts have
        above MIN_COUNT, and what the counts of their suffixes have above theirs."""
        if n + 1 not in signed:
            return
        own = np.flatnonzero(signed[n + 1] < 0)
        at, size = self.context(n + 1, own), len(self.grams[n])
        count = -signed[n + 1][own]
        sums = [np.ones(len(own)), count - MIN_COUNT, np.abs(signed[n][self.suffix(n + 1, own)]) - count]  # small numbers pack well
        places = np.flatnonzero(signed[n])
        yield from _asked(self.name, -n, self.grams[n][places], [np.bincount(at, x, size)[places].astype(np.int64) for x in sums], buckets)


def _asked(block: int, n: int, grams: np.ndarray, sent: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """The sorted n-grams and what is sent of each, cut by bucket; a negative size asks for backoffs."""
    cuts = np.searchsorted((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[bucket], cuts[bucket + 1])
        yield bucket, block, n, _planes(grams[part]), [_planes(x[part]) for x in sent]


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _ask_first(order: int, buckets: int):
    """Counts of words and of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], min(order, 2), {})
                for n in block.grams:
                    yield from _table(list(block.ask_counts(n, buckets)), ASKED).to_batches()

    return run


def _ask_next(n: int, order: int, buckets: int):
    """Counts of n-grams (up to ``order`` words), and backoffs of contexts whose followers are counted by now."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        signed = _joined(answers, 1)
        block = Block(blocks.to_pylist()[0], min(n, order), signed)
        rows = list(block.ask_counts(n, buckets)) if n <= order else []
        return _table(rows + list(block.ask_backoffs(n - 2, signed, buckets)), ASKED)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Adds up what all blocks sent of an n-gram and answers each of them, in the order in which it asked.

    A count is negative for the one block that owns the n-gram, and 0 where it is not kept.
    """
    bucket, rows = table["bucket"][0].as_py(), []
    for n in sorted(set(table["size"].to_pylist())):
        asked = table.filter(pa.compute.equal(table["size"], n))
        parts = [_of_planes(b, np.uint64) for b in asked["grams"].to_pylist()]
        grams = np.concatenate(parts)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        times = np.diff(np.append(starts, len(grams)))
        sent, answers, types = list(zip(*asked["sent"].to_pylist(), strict=True)), [], 0
        for planes in sent:
            sums = np.add.reduceat(np.concatenate([_of_planes(b, np.int32 if n > 0 else np.int64) for b in planes])[order].astype(np.int64), starts)
            if n > 0:
                sums = np.where(sums >= (1 if n == 1 else MIN_COUNT), sums, 0)
                types = int((sums > 0).sum()) if n == 1 else 0
            each = np.repeat(sums, times)
            if n > 0:
                each[starts] *= -1
            answer = np.empty_like(each)
            answer[order] = each
            answers.append(answer)
        at = 0
        for block, part in zip(asked["block"].to_pylist(), parts, strict=True):
            end = at + len(part)
            rows.append((block, bucket, n, [_planes(x[at:end]) for x in answers], types))
            at, types = end, 0
    return _table(rows, ANSWERS)


def _joined(answers: pa.Table, sign: int) -> dict:
    """The answers to a block by size of n-gram, in the order of its n-grams: counts, or the three sums of backoffs."""
    out: dict[int, list] = defaultdict(list)
    for row in sorted(answers.select(["size", "bucket", "answer"]).to_pylist(), key=lambda r: (r["size"], r["bucket"])):
        if row["size"] * sign > 0:
            out[abs(row["size"])].append([_of_planes(x, np.int64) for x in row["answer"]])
    found = {n: [np.concatenate(x) for x in zip(*parts, strict=True)] for n, parts in out.items()}
    return {n: x[0] if sign > 0 else x for n, x in found.items()}


WALKED = "id {0}, tkey long, n_tokens long, n_known long, base double, walk double"


class Automaton:
    """The part of the model that a block's texts can reach.

    States: 0, no context, and each kept context of up to ``order`` - 1 words that the block has. A kept n-gram is an arc from
    the state of its first words, with its log10 probability, to the longest kept context that it ends with. A state without an
    arc for the next word has its failure arc, which costs its backoff and leads to the context without its first word; from
    state 0 every word has an arc. Arcs are known by the place of their n-gram among those of their size.
    """

    def __init__(self, block: Block, counts: dict[int, np.ndarray], sums: dict[int, list[np.ndarray]], size: int, order: int):
        while order > 1 and any(n not in sums for n in range(1, order)):
            order -= 1
        self.block, self.order = block, order
        n_states = np.cumsum([1, *(len(counts[n]) for n in range(1, order))])
        of = lambda n, places: n_states[n - 1] + places if n else np.zeros(len(places), np.int64)
        self.length = np.concatenate([[0], *(np.full(len(counts[n]), n) for n in range(1, order))]).astype(np.int8)
        self.fail, self.weight = np.zeros(n_states[-1], np.int64), np.zeros(n_states[-1])
        # the last place stands for n-grams that there are not
        self.cost = {1: np.append(np.log10((counts[1] + 1) / size), 0.0)}
        self.arc = {1: np.append(np.ones(len(counts[1]), bool), False)}
        known = np.flatnonzero(counts[1]) if order > 1 else np.zeros(0, np.int64)
        self.to = {1: np.zeros(len(counts[1]) + 1, np.int64)}
        self.to[1][known] = of(1, known)
        for n in range(2, order + 1):
            context, kept = n - 1, np.flatnonzero(counts[n])
            self.arc[n], self.to[n], self.cost[n] = np.zeros(len(counts[n]) + 1, bool), np.zeros(len(counts[n]) + 1, np.int64), np.zeros(len(counts[n]) + 1)
            self.arc[n][kept] = True
            self.cost[n][kept] = np.log10((counts[n][kept] - DISCOUNT) / counts[context][block.context(n, kept)])
            self.to[n][kept] = of(n, kept) if n < order else of(context, block.suffix(n, kept))
            # what falling back from each kept context costs
            places = np.flatnonzero(counts[context])
            followers, above, more = sums[context]
            followed = above + MIN_COUNT * followers
            lower = followed + more
            suffix = None if context == 1 else block.suffix(context, places)
            shorter = float(size) if context == 1 else counts[context - 1][suffix]
            taken = (followed - DISCOUNT * followers) / counts[context][places]
            left = (lower + followers if context == 1 else lower - DISCOUNT * followers) / shorter
            self.weight[of(context, places)] = np.log10(np.maximum(1 - taken, 1e-12) / np.maximum(1 - left, 1e-12))
            if context > 1:
                self.fail[of(context, places)] = of(context - 1, suffix)

    def walk(self, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text.

        Texts are walked side by side, a token of each at a time, every one with its state. A long text is walked in stretches:
        a state depends on ``order`` - 1 tokens only, so a stretch first reads those before it, at no cost.
        """
        starts = self.block.starts
        count = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = starts[text] + nth * STRETCH
        end = np.minimum(begin + STRETCH, starts[text] + sizes[text])
        at = np.maximum(begin - (self.order - 1), starts[text])
        longest = np.argsort(at - end, kind="stable")
        begin, end, at, text = begin[longest], end[longest], at[longest], text[longest]
        state, total, out = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(sizes))
        left = at - end  # ascending
        for step in range(int(-left.min(initial=0))):
            n_live = int(np.searchsorted(left, -step, side="left"))  # the others have ended
            live = slice(0, n_live)
            now, i = state[live].copy(), at[live] + step
            cost, to, waits = np.zeros(n_live), np.zeros(n_live, np.int64), np.ones(n_live, bool)
            for n in range(self.order, 0, -1):
                here = waits & (self.length[now] == n - 1)
                place = self.block.at[n][i]
                takes = here & self.arc[n][place]
                cost += np.where(takes, self.cost[n][place], 0)
                to = np.where(takes, self.to[n][place], to)
                waits &= ~takes
                falls = here & ~takes
                cost += np.where(falls, self.weight[now], 0)
                now = np.where(falls, self.fail[now], now)
            state[live] = to
            total[live] += np.where(i >= begin[live], cost, 0)
        np.add.at(out, text, total)
        return out


def _walk(order: int, size: int):
    """Scores of a block's texts by its part of the automaton, once all counts and backoffs are known."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        counts = _joined(answers, 1)
        block = Block(row, order, counts)
        counts = {n: np.abs(c) for n, c in counts.items()}
        automaton = Automaton(block, counts, _joined(answers, -1), size, order)
        base = automaton.cost[1][block.at[1]]
        known = (counts[1] > 0)[block.at[1]].astype(np.int64)
        kind = blocks.schema.field("ids").type.value_type
        totals = [np.add.reduceat(x, block.starts) for x in (known, base)]
        totals.append(automaton.walk(np.array(row["sizes"], np.int64)))
        return pa.table([pa.array(row["ids"], kind), pa.array(row["tkeys"], pa.int64()), pa.array(row["sizes"], pa.int64()), *map(pa.array, totals)], ["id", "tkey", "n_tokens", "n_known", "base", "walk"])

    return run


def _whole(docs: DataFrame, model: dict, text: str, doc_id: str) -> tuple[DataFrame, int]:
    """Scores of all rows by the whole model, and its number of training tokens."""

    def blocks(side: int, rows: DataFrame, text: str, doc_id: str, held: F.Column) -> DataFrame:
        body = F.coalesce(F.col(text), F.lit(""))
        return rows.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("tkey"), body.alias("body"), held.alias("held")).mapInArrow(_blocks(side), BLOCKS.format(dict(rows.dtypes)[doc_id]))

    order, rows = model["order"], model["docs"]
    same = rows is docs and (text, doc_id) == (model["text"], model["doc_id"])
    chars = rows.agg(F.sum(F.length(model["text"]))).first()[0] or 0
    if same:
        # blocks stay where they are: only answers are shuffled to them
        n = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // (6 * BLOCK)), MOST_BUCKETS)
        made = bucketed(blocks(0, docs, text, doc_id, held_out(doc_id)), "block", n, "blocks")
        asking, tables = made, [made]
    else:
        made = written(blocks(0, docs, text, doc_id, F.lit(True)), "blocks")
        train = rows.where(~held_out(model["doc_id"]))
        trained = written(blocks(1, train, model["text"], model["doc_id"], F.lit(False)), "blocks")
        asking, tables = made.drop("ids").unionByName(trained.drop("ids")), [made, trained]
        chars += docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = chars // BUCKET_CHARS + 1
    slim = asking.select("block", "held", "sizes", "symbols", "vocabulary")

    def answered(asked: DataFrame) -> DataFrame:
        out = written(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS), "answers")
        tables.append(out)
        docs.sparkSession._jvm.System.gc()  # lets Spark drop the shuffle that this read
        return out

    # one size at a time, so that only its shuffle is on disk
    answers = answered(slim.mapInArrow(_ask_first(order, buckets), ASKED))
    types = answers.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    for n in range(3, order + 2):
        told = answers.where("size > 0").groupBy("block")
        answers = answers.unionByName(answered(slim.groupBy("block").cogroup(told).applyInArrow(_ask_next(n, order, buckets), ASKED)))
    lengths = F.arrays_zip("held", "sizes")
    total = asking.select(F.explode(lengths).alias("r")).where("NOT r.held").agg(F.coalesce(F.sum("r.sizes"), F.lit(0))).first()[0]
    told = (answers if same else answers.where(F.col("block") < 1 << 60)).groupBy("block")
    walked = written(made.groupBy("block").cogroup(told).applyInArrow(_walk(order, total + types + 1), WALKED.format(dict(docs.dtypes)[doc_id])), "walked")
    for table in tables:
        forget(table)
    docs.sparkSession._jvm.System.gc()
    return walked, int(total)


def score(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score added.

    Whole texts are scored; a null text is empty and has the end alone. base_score is the add-one unigram log10
    probability; score that of the automaton. An empty table gives no rows. Rows of equal id and text have equal scores. Columns of ``docs`` named like the
    added ones are replaced. Without training rows every token is new to both models.
    """
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c not in added]
    per, total = _whole(docs, model, text, doc_id)
    per = per.select(F.col("id").alias("__id"), F.col("tkey").alias("__t"), "n_tokens", "n_known", F.col("base").alias("base_score"), F.col("walk").alias("score"))
    key, own, of, at = free(docs, "__key", "__own", "__of", "__at")
    per = per.groupBy(F.col("__id").alias(of), F.col("__t").alias(at)).agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    # the key is a column of its own, so that the join needs no text
    rows = docs.select(*rest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(key), F.col(doc_id).alias(own), held_out(doc_id).alias("held_out"))
    on = (F.col(key) == F.col(at)) & F.col(own).eqNullSafe(F.col(of))
    return rows.join(per, on, "left").select(*rest, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
