"""The Merkle manifest against a level-by-level brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from isoframe.llm import merkle, queries
from tests.duck import same, views

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree_of(leaves):
    """(root, siblings with their sides for each leaf)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            if (a ^ 1) < len(level):
                paths[i].append(("L" if a & 1 else "R", level[a ^ 1]))
            at[i] = a // 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded_root, verified of every row."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {x: tree_of([leaf(r) for r in trees[x]]) for x in names}
    root, tops = tree_of([low[x][0] for x in names])
    out = []
    for x, top in zip(names, tops, strict=True):
        for r, own in zip(trees[x], low[x][1], strict=True):
            path, shown = own + top, dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                shown["n_chars"] += 1
            acc, left = leaf(shown), list(path)
            # a level without a sibling is hashed alone: walk the sizes
            for at, size in walk(trees[x], r, names, x):
                if (at ^ 1) >= size:
                    acc = h(acc)
                else:
                    side, sibling = left.pop(0)
                    acc = h(sibling + acc if side == "L" else acc + sibling)
            out.append((r["doc_id"], leaf(r), low[x][0], root, h("".join(s for _, s in path)), acc, acc == root))
    return sorted(out, key=str)


def walk(rows, row, names, name):
    for at, size in ((next(i for i, r in enumerate(rows) if r is row), len(rows)), (names.index(name), len(names))):
        while size > 1:
            yield at, size
            at, size = at // 2, (size + 1) // 2


def make(n, langs, seed=5):
    rng = random.Random(seed)
    return [{"doc_id": i * 3, "text": rng.choice(["", "é x", "a:b", None, "w " * rng.randrange(9)]), "lang": rng.choice(langs), "source": rng.choice(["s", None]), "n_chars": rng.choice([None, 0, 7, 2**63 - 1])} for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)


def result(spark, rows, tmp_path):
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_merkle(spark, str(tmp_path))
    return df, sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (37, ["en", "de", None, "", "é"]), (150, ["en"])])
def test_query(spark, tmp_path, n, langs):
    rows = make(n, langs)
    df, got = result(spark, rows, tmp_path)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) == any(not r[-1] for r in brute(rows))
    small = [r for r in rows if r["n_chars"] != 2**63 - 1]
    if len(small) == len(rows):
        same(df, views(str(tmp_path)), queries.oracle_sql()["op12_merkle"])


def test_against_sql(spark, tmp_path):
    rows = [r | {"n_chars": i if i % 5 else None} for i, r in enumerate(make(61, ["en", "de", None]))]
    df, _ = result(spark, rows, tmp_path)
    same(df, views(str(tmp_path)), queries.oracle_sql()["op12_merkle"])


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_blocks_of_any_size_give_the_same_tree(spark, bits):
    rows = make(77, ["en", "en", "en", "de", None])
    docs = frame(spark, rows).repartition(5)
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", bits=bits).withColumn("again", merkle.folded("leaf", "path"))
    got = sorted([(r.doc_id, r.leaf, r.subroot, r.root, h("".join(x[1:] for x in r.path))) for r in got.collect() if r.again == r.root], key=str)
    assert got == [r[:5] for r in brute(rows)]


def test_ties_nulls_repeats_and_clashing_names(spark):
    rows = make(20, ["en", None])
    rows += [dict(rows[3]) for _ in range(9)] + [dict(rows[4], doc_id=None), dict(rows[5], doc_id=None), dict(rows[6], text="z" * 2_000_000)]
    want = brute(rows)
    for parts in (1, 6):
        docs = frame(spark, rows).repartition(parts)
        for c in ("tree", "at", "n", "h", "path", "root", "leaf", "uid", "block"):
            docs = docs.withColumn(c, F.lit("own"))
        got = merkle.manifest(docs, FIELDS, "lang", "doc_id", bits=2)
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root) for r in got.collect()], key=str) == [r[:4] for r in want]


def test_empty(spark):
    assert merkle.manifest(frame(spark, []), FIELDS, "lang", "doc_id").count() == 0
