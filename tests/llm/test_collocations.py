"""Collocations against a count of everything, whatever the size of the sketch."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isoframe.llm import collocations as co
from isoframe.llm import queries
from tests.duck import same, views

SMALL = co.CHUNK // 2
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, top=2000, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    gone = {(lang, p[i:j]) for (lang, p), c in f.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * c >= percent * f[lang, p[i:j]]}
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], *rest))
    return sorted(ranked)


def make(n=300, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "The", "the", "a", "\x00", "ﬁ", "日本"]
    phrases = ["new york city", "the the the", "a a a a a a", "one  two\tthree four five six"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "!?"]) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, " . , "), ("fr", "x"), ("fr", None)] + [("es", "uno dos tres")] * 9


ROWS = make()


def run(spark, rows, parts=5, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    got = co.collocations(docs, **({"cells": SMALL} | more))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("more", [{"least": 9}, {"least": 5, "percent": 60, "top": 7}, {"least": 1, "longest": 3}, {"least": 3, "top": 70}])
def test_brute_force(spark, more):
    own = {"min_count" if k == "least" else k: v for k, v in more.items()}
    assert run(spark, ROWS, **own) == brute(ROWS, **more)


def test_a_full_sketch_loses_and_adds_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "_cells", lambda h, row, cells: (h & co.np.uint64(3)).astype(co.np.int64))
    assert run(spark, ROWS[:150], 2, min_count=9) == brute(ROWS[:150], least=9)


def test_blocks_cut_within_pieces(monkeypatch):
    for limit in (1, 5, 64):
        for data in ("a b c d e f g a b c d e f g " * 9, "x" * 400, "a. b c. d e f g h i j k l m n o p q r s t u v w x y z " * 5, "", "a\n\nb  c " * 50):
            seen = Counter()
            for block in co.blocks([data, None, data], 5, limit):
                for i, (w, room, new) in enumerate(zip(block.ids.tolist(), block.room.tolist(), block.new.tolist(), strict=True)):
                    assert block.names[w].strip()
                    for n in range(new, min(room, 5) + 1):
                        seen[tuple(block.names[x].decode() for x in block.ids[i : i + n])] += 1
            want = Counter()
            for _ in range(2):
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", data):
                    w = piece.split()
                    want.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
            assert seen == want


def test_long_texts_saturation_and_clashing_names(spark):
    rows = [("en", "a b " * 100_000), ("en", "z" * 3_000_000), ("en", "a b c, " * 40_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for c in ("phrase", "n", "f", "score", "rank", "salt", "doc_id"):
        docs = docs.withColumn(c, F.lit("own"))
    assert sorted(tuple(r) for r in co.collocations(docs, cells=SMALL).collect()) == brute(rows)


def test_empty_and_wrong_parameters(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", "")]) == []
    with pytest.raises(ValueError):
        co.collocations(spark.createDataFrame(ROWS, "lang string, text string"), min_count=co.FULL + 1)


def test_query(spark, tmp_path):
    rows = [(i, lang, t) for i, (lang, t) in enumerate(ROWS * 3)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_collocations(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == brute([r[1:] for r in rows])
    same(df, views(str(tmp_path)), queries.oracle_sql()["op11_collocations"])
