"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are hashed in k-grams; of every run of w k-grams the least hash is its window's fingerprint, on both sides. A shared
span of k + w - 1 words is the same window on both sides and so has the same fingerprint, hence no window of that many words
is missed. Windows of documents whose fingerprint an item has are then compared by their words, fetched once for a document; each that an item holds is a
hit, and hits that overlap or follow each other are one extended span.

Documents are read once, whatever lengths items have. Windows of items are joined by their words, each only once, however
often it is repeated in items; so a repeated passage makes a row for each of its places in documents, not for pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.llm.common import Scratch, ascii_lower, free, small, written

#: Between words. Only A-Z are lower-cased, which changes no border, so it may be done later.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
K = 7


def words(text: Column) -> Column:
    """The words as they stand; equal ones may differ in the case of A-Z."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def word_hashes(ws: Column) -> Column:
    """Equal words have equal hashes: lower-casing by word sees the same context in both."""
    return F.transform(ws, lambda w: F.xxhash64(F.lower(w)))


def passage(ws: Column, at: Column, n: Column) -> Column:
    """The words from place ``at`` (1-based) as the rule compares them; a word has no space."""
    return ascii_lower(F.array_join(F.slice(ws, at, n), " "))


def windows(df: DataFrame, keep: list[str], hashes: str, lengths: list[int], k: int) -> DataFrame:
    """keep, at, len and fp for every window of one of the lengths.

    fp is the least k-gram hash of the window. Each step is a column of its own, so that it is computed once for a place.
    """
    least, most = lengths[0], lengths[-1]
    places = F.when(F.size(hashes) >= least, F.sequence(F.lit(1), F.size(hashes) - (least - 1)))
    out = df.select(*keep, hashes, F.explode(places).alias("at"))
    out = out.select(*keep, "at", *[F.try_element_at(hashes, F.col("at") + i).alias(f"w{i}") for i in range(most)])
    grams = {(i, min(k, n)) for n in lengths for i in range(n - min(k, n) + 1)}
    out = out.select(*keep, "at", f"w{most - 1}", *[f"w{n - 1}" for n in lengths[:-1]], *[F.xxhash64(*[f"w{j}" for j in range(i, i + kk)]).alias(f"g{i}_{kk}") for i, kk in sorted(grams)])

    def fp(n: int) -> Column:
        of = [F.col(f"g{i}_{min(k, n)}") for i in range(n - min(k, n) + 1)]
        return F.least(*of) if len(of) > 1 else of[0]

    if least == most:
        return out.select(*keep, "at", F.lit(least).alias("len"), fp(least).alias("fp"))
    # a longer window than the text has room for has no last word
    each = F.array(*[F.struct(F.lit(n).alias("len"), F.when(F.col(f"w{n - 1}").isNotNull(), fp(n)).alias("fp")) for n in lengths])
    return out.select(*keep, "at", F.explode(each).alias("f")).select(*keep, "at", "f.len", "f.fp").where("fp IS NOT NULL")


def hits(docs: DataFrame, benchmark: DataFrame, text: str, doc_id: str, item_text: str, item_id: str, window: int, k: int) -> DataFrame | None:
    """(id, key, n_hit, items), written, for every text that a window of an item occurs in; None if no item has a word."""
    scratch = Scratch()
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("iw")).where("size(iw) > 0")
    items = scratch.written(items.select("item", "iw", F.least(F.size("iw"), F.lit(window)).alias("len"), word_hashes(F.col("iw")).alias("ih")), "items")
    # window lengths in use: at most ``window`` different numbers
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())
    if not lengths:
        scratch.forget()
        return None
    own = reduce(DataFrame.unionByName, [windows(items.where(F.col("len") == n).drop("len"), ["item", "iw"], "ih", [n], k) for n in lengths])
    own = scratch.written(own.select("item", "len", "fp", passage(F.col("iw"), F.col("at"), F.col("len")).alias("passage")).distinct(), "item_windows")
    prints = small(scratch.written(own.select(F.col("fp").alias("f2")).distinct(), "prints"))
    passages = small(scratch.written(own.select(F.col("len").alias("l2"), F.col("passage").alias("p2")).distinct(), "passages"))
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), key.alias("key"), word_hashes(words(F.col(text))).alias("dh"))
    # what meets is joined by place only; the words of documents in which anything does are fetched once for each
    met = windows(rows, ["id", "key"], "dh", lengths, k).join(prints, F.col("fp") == F.col("f2")).select("id", "key", "at", "len")
    met = scratch.written(met.groupBy("id", "key").agg(F.collect_set(F.struct("at", "len")).alias("spots")), "spots")
    spots = small(met).select(F.col("id").alias("i2"), F.col("key").alias("k2"), "spots")
    texts = docs.select(F.col(doc_id).alias("id"), key.alias("key"), body.alias("body")).join(spots, (F.col("key") == F.col("k2")) & F.col("id").eqNullSafe(F.col("i2")))
    texts = texts.select("id", "key", "spots", words(F.col("body")).alias("dw"))
    each = F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["len"].alias("len"), passage(F.col("dw"), s["at"], s["len"]).alias("passage")))
    found = texts.select("id", "key", F.explode(each).alias("s")).select("id", "key", "s.*")
    found = found.join(passages, (F.col("passage") == F.col("p2")) & (F.col("len") == F.col("l2")), "left_semi")
    found = scratch.written(found.distinct(), "hits")
    places = found.select("id", "key", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("at"))
    n_hit = places.distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    of = own.select("item", F.col("len").alias("l2"), F.col("passage").alias("p2"))
    named = found.select("id", "key", "len", "passage").distinct().join(of, (F.col("passage") == F.col("p2")) & (F.col("len") == F.col("l2")))
    named = named.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = [F.col("key") == F.col("k2"), F.col("id").eqNullSafe(F.col("i2"))]
    spans = written(n_hit.join(named.select(F.col("id").alias("i2"), F.col("key").alias("k2"), "items"), same).select("id", "key", "n_hit", "items"), "spans")
    scratch.forget()
    return spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and contaminated added.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; an item without words has none. A
    word of a document is hit if it lies in an occurrence of a window. contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    items: sorted ids, as strings, of the items that occur; an item without an id occurs under none. A null text has no words.
    Rows that repeat are each judged. Rows that share an id but not the text are judged apart. Columns of ``docs`` named like
    the added ones are replaced. Empty documents give no rows; an empty benchmark hits nothing.
    """
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    rest = [c for c in docs.columns if c not in added]
    key, own, of, at = free(docs, "__key", "__own", "__of", "__at")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*rest, F.xxhash64(body).alias(key), F.col(doc_id).alias(own), F.size(words(F.col(text))).cast("long").alias("n_words"))
    spans = hits(docs, benchmark, text, doc_id, item_text, item_id, window, k)
    none, no_items = F.lit(0).cast("long"), F.array().cast("array<string>")
    if spans is None:
        return base.withColumns({"n_hit": none, "n_items": none, "items": no_items, "contaminated": F.lit(False)}).select(*rest, *added)
    spans = small(spans).select(F.col("id").alias(of), F.col("key").alias(at), "n_hit", "items")
    out = base.join(spans, (F.col(key) == F.col(at)) & F.col(own).eqNullSafe(F.col(of)), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", none), "items": F.coalesce("items", no_items)})
    out = out.withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(*rest, *added)


ORACLE_SQL = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.n, d.i, b.item_id FROM dwin d JOIN iwin b ON d.n = b.n AND d.g = b.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(len(n.items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
