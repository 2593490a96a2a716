"""Merkle manifest of a dataset by higher-order SQL functions on fixed-size blocks of leaves.

1. Every row becomes a leaf: the digest of its fields, each with its length before it, so that no two rows read alike.
2. Leaves are numbered within their tree (one for each value of a column): rows are dealt by range, and each range gets the
   number of leaves before it, so that no tree is sorted in one task.
3. 2**BITS leaves that follow each other are one array. ``aggregate`` over ``sequence`` collapses it level by level, each level
   by ``transform`` over ``slice`` s of two. The roots of blocks are the leaves of a smaller tree, treated alike, until every tree
   has one node. The last block of a larger tree is collapsed by as many levels as the others, so that the tree is the one that
   pairs nodes level by level.
4. Back down, a leaf's path is its siblings within its block, then the path of its block; the roots of the trees, in order
   of their names, are the leaves of one last tree, whose path follows.

A task holds a block at a time. Leaves are shuffled twice, by range and by block, without the fields themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import Scratch, small, written

#: A block has 2**BITS leaves.
BITS = 10
NONE = "-"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NONE))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def folded(own: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its path give. A step of a path: L or R and the sibling on that side, or nothing if there is none."""
    sibling = lambda x: F.substring(x, 2, 64)
    step = lambda acc, x: digest(F.when(x == "", acc).when(F.startswith(x, F.lit("L")), F.concat(sibling(x), acc)).otherwise(F.concat(acc, sibling(x))))
    return F.aggregate(path, F.col(own) if isinstance(own, str) else own, step)


def proof(path: Column | str) -> Column:
    """The siblings of a path, one after the other."""
    return F.array_join(F.transform(path, lambda x: F.substring(x, 2, 64)), "")


def numbered(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` (a column ``tree``) with ``at``, a row's place from 0 in its tree by ``order``, and ``n``, the tree's rows.

    Rows that are alike in ``order`` are taken in the order of the written table.
    """
    rows = scratch.written(df.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "uid"]
    # within a range the ids that rows get follow each other
    dealt = scratch.written(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("uid").withColumn("place", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    parts = dealt.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("tree").alias("t2"), F.col("part").alias("p2"), (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    parts = small(scratch.written(parts, "ranges"))
    out = dealt.join(parts, (F.col("tree") == F.col("t2")) & (F.col("part") == F.col("p2")))
    return out.withColumn("at", F.col("place") + F.col("shift")).drop("place", "part", "t2", "p2", "shift")


def collapsed(level: Column) -> Column:
    """The next level: the digest of every two nodes that follow each other; the last may be alone."""
    return F.transform(F.sequence(F.lit(1), F.size(level), F.lit(2)), lambda i: digest(F.array_join(F.slice(level, i, 2), "")))


def levels(leaves: Column, depth: Column) -> Column:
    """All levels of a block, the leaves first."""
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), lambda acc, _: F.concat(acc, F.array(collapsed(F.element_at(acc, -1)))))


def step(level: Column, at: Column) -> Column:
    """The step of a path from place ``at`` (from 0) of a level."""
    sibling = F.get(level, at.bitwiseXOR(F.lit(1)))
    return F.when(at % 2 == 1, F.concat(F.lit("L"), sibling)).otherwise(F.coalesce(F.concat(F.lit("R"), sibling), F.lit("")))


def climbed(nodes: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """nodes (tree, at, n, h and others) with ``path`` to the root of their tree, and ``root``."""
    size = 1 << bits
    rest = [c for c in nodes.columns if c not in ("tree", "at", "n")]
    block = F.shiftright("at", bits)
    rows = F.array_sort(F.collect_list(F.struct("at", *rest)))
    blocks = scratch.written(nodes.groupBy("tree", block.alias("block")).agg(rows.alias("rows"), F.first("n").alias("n")), "blocks")
    depth = F.when(F.col("n") > size, bits).otherwise(F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    every = levels(F.col("rows.h"), depth)
    roots = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.element_at(F.element_at(every, -1), 1).alias("h"))
    roots = scratch.written(roots, "block_roots")
    if roots.where("n > 1").isEmpty():
        above = roots.select("tree", "at", F.array().cast("array<string>").alias("path"), F.col("h").alias("root"))
    else:
        above = climbed(roots, scratch, bits)
    above = above.select(F.col("tree").alias("t2"), F.col("at").alias("b2"), F.col("path").alias("upper"), "root")
    above = small(scratch.written(above, "block_paths"))
    # the levels of a block are bound once for all of its rows
    own = lambda found, i: F.transform(F.slice(found, 1, F.size(found) - 1), lambda level, up: step(level, F.call_function("shiftright", i, up)))
    each = F.transform(F.array(every), lambda found: F.transform("rows", lambda x, i: F.struct(*[x[c].alias(c) for c in ("at", *rest)], own(found, i).alias("own"))))
    joined = blocks.join(above, (F.col("tree") == F.col("t2")) & (F.col("block") == F.col("b2")))
    found = joined.select("tree", "n", "upper", "root", F.inline(F.get(each, F.lit(0))))
    return found.select("tree", "at", "n", *rest, F.concat("own", "upper").alias("path"), "root")


def manifest(df: DataFrame, fields: list[str], by: str, order: str, carry: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """(``order``, leaf, subroot, root, path, and ``carry``) for every row of ``df``.

    A leaf is the digest of the ``fields``. Leaves of one value of ``by`` ascend by ``order`` (then by leaf, so that rows that tie
    give one root in whatever order they were stored); every two that follow each other become their digest, until the
    subroot remains. Subroots, by ``by``, likewise give the root. Nulls of ``by`` are a tree of their own, the first; null
    ``order`` comes first. Rows that repeat are leaves of their own. An empty table gives no rows, and has no root.
    """
    carry = carry or {}
    scratch = Scratch()
    named = {f"c{i}": c for i, c in enumerate(carry.values())}
    # a null name sorts first and is not the empty one
    tree = F.coalesce(F.concat(F.lit(":"), F.col(by).cast("string")), F.lit(""))
    rows = df.select(tree.alias("tree"), F.col(order).alias("id"), leaf([F.col(c) for c in fields]).alias("h"), *[c.alias(k) for k, c in named.items()])
    paths = climbed(numbered(rows, ["id", "h"], scratch), scratch, bits).select("tree", "id", "h", *named, "path", F.col("root").alias("subroot"))
    paths = written(paths, "paths")
    tops = paths.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("h")).distinct()
    tops = climbed(numbered(tops, ["name"], scratch), scratch, bits).select("name", F.col("path").alias("upper"), "root")
    tops = small(written(tops, "trees"))
    scratch.forget()
    out = paths.join(tops, F.col("tree") == F.col("name"))
    return out.select(F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), *[F.col(k).alias(c) for k, c in zip(named, carry, strict=True)])


_ENCODED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ENCODED.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT doc_id, encode(doc_id::VARCHAR) AS b FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
bits AS (SELECT doc_id, b, 0 AS i, 4294967295::BIGINT AS c FROM crc
  UNION ALL SELECT doc_id, b, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
  FROM (SELECT doc_id, b, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE c END AS y FROM bits WHERE i < 8 * octet_length(b))),
tampered AS (SELECT doc_id FROM bits WHERE i = 8 * octet_length(b) AND xor(c, 4294967295) % 7 = 0),
leaves AS (SELECT doc_id, coalesce(':' || lang, '') AS tree, {_LEAF.format(n="n_chars")} AS h, {_LEAF.format(n="(n_chars + 1)")} AS h2 FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, p, n, h FROM base
  UNION ALL SELECT tree, level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY tree, level, p // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, p, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY level, p // 2, n),
lower_steps AS (SELECT b.doc_id, b.tree, b.p AS pos, o.level, (b.p >> o.level) % 2 AS odd, s.h FROM base b JOIN nodes o ON o.tree = b.tree AND o.n > 1 AND o.p = b.p >> o.level LEFT JOIN nodes s ON s.tree = o.tree AND s.level = o.level AND s.p = xor(o.p, 1)),
top_steps AS (SELECT u.tree, o.level, o.p % 2 AS odd, s.h FROM subroots u JOIN tops o ON o.n > 1 AND o.p = u.p >> o.level LEFT JOIN tops s ON s.level = o.level AND s.p = xor(o.p, 1)),
steps AS (SELECT doc_id, tree, pos, level, odd, h FROM lower_steps UNION ALL SELECT b.doc_id, b.tree, b.p, 1000 + t.level, t.odd, t.h FROM base b JOIN top_steps t USING (tree)),
paths AS (SELECT tree, pos, list(struct_pack(odd := odd, h := h) ORDER BY level) AS steps FROM steps GROUP BY tree, pos),
fold AS (SELECT b.tree, b.p, coalesce(q.steps, []) AS steps, 1 AS k, CASE WHEN t.doc_id IS NULL OR b.h2 IS NULL THEN b.h ELSE b.h2 END AS acc FROM base b LEFT JOIN paths q ON q.tree = b.tree AND q.pos = b.p LEFT JOIN tampered t ON t.doc_id = b.doc_id
  UNION ALL SELECT tree, p, steps, k + 1, sha256(CASE WHEN steps[k].odd = 1 THEN steps[k].h || acc ELSE acc || coalesce(steps[k].h, '') END) FROM fold WHERE k <= len(steps))
SELECT b.doc_id, b.h AS leaf, u.subroot, r.h AS root, sha256(coalesce(array_to_string(list_transform(f.steps, lambda x: coalesce(x.h, '')), ''), '')) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM base b JOIN subroots u USING (tree) JOIN fold f ON f.tree = b.tree AND f.p = b.p AND f.k = len(f.steps) + 1, (SELECT h FROM tops WHERE n = 1) r
"""
