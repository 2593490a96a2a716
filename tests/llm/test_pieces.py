"""Piece encoding and decoding against the sentencepiece library, spans and character maps included."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from isoframe.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\t\n\r\x0b", "\x00\x01", "▁", "▁a ▁ b", "a▁", "<s>", "</s><unk><0x41>", "é", "é", "日本語のテキスト", "🙂👩‍👩‍👧", "�", "﻿x", "ﬁ Ａ①", "     x        y" + " " * 40 + "z",
    "x" * 3000, "ab" * 2000, " " * 1000, "\n" * 300, "Zz  z", "don't  stop", "\U0010ffff\U00010000", "a\u0000b", "１２３", "....!!!!", "0123456789" * 50,
]


def fuzz(n=400, seed=11):
    rng = random.Random(seed)
    kinds = ["abcdefghij ", " ▁ a", "éßñ日本🙂 x", "\t\n a.,", "thers and of in  on", "".join(map(chr, range(0, 400)))]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 60))) for _ in range(n)]


def numbers(x):
    return np.frombuffer(x, "<u4").tolist()


def spans(lib, text):
    """The library's spans, in bytes."""
    return [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]


def held(own, lib, text):
    ids, starts, ends = map(numbers, own.encode(text))
    want = lib.encode(text, add_bos=True, add_eos=True)
    assert ids == want, repr(text)
    assert list(zip(starts, ends, strict=True))[1:-1] == spans(lib, text), repr(text)
    assert own.decode(np.array(want, "<u4").tobytes()) == lib.decode(want), repr(text)


def test_library():
    own, lib = pieces.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ODD + fuzz():
        held(own, lib, text)


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(pieces, "PART", 7)
    own, lib = pieces.Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ODD + fuzz(100, 3):
        held(own, lib, text)


def test_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(pieces, "PART", 500)
    monkeypatch.setattr(pieces, "CACHE", 300)
    own, lib = pieces.Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    every = "".join(map(chr, [*range(0x2581), *range(0x2582, 0xD800)]))
    texts = [*ODD, every, "", *fuzz(300, 5), "", "the rest " * 400, "x" * 39, "x" * 40, "a" + " " * 38, "thethe" * 6]
    for _ in range(2):
        for text, (ids, starts, ends) in zip(texts, own.encode_all(texts), strict=True):
            assert numbers(ids) == lib.encode(text, add_bos=True, add_eos=True), repr(text[:99])
            assert list(zip(numbers(starts), numbers(ends), strict=True))[1:-1] == spans(lib, text), repr(text[:99])


def test_rare_words_are_merged_side_by_side():
    rng = random.Random(7)
    words = ["".join(rng.choices(["the", "ion", "er", "schen", "ä", "qu", "é", "on", "re"], k=rng.randrange(2, 8))) for _ in range(60_000)]
    text, own = " ".join(words), pieces.Codec(open(MODEL, "rb").read())
    began = time.process_time()
    want = [own.ids[p] for w in words for p in own.merged(pieces.SPACE + w)]
    each = time.process_time() - began
    assert numbers(own.encode(text)[0])[1:-1] == want
    assert time.process_time() - began - each < 0.7 * each


def test_decode_of_any_ids():
    own, lib = pieces.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    for _ in range(600):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(0, 3), 259, 29871]) for _ in range(rng.randrange(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids
    assert own.decode(b"") == ""


def char_map(rules):
    """A compiled map of byte keys and replacements, built naively."""
    texts, at = b"", {}
    for v in rules.values():
        at[v] = len(texts)
        texts += v + b"\0"
    units, used = [0] * 8192, {0}

    def build(place, keys, depth):
        labels = sorted({k[depth] if depth < len(k) else 0 for k in keys})
        base = next(b for b in range(256, 8192 - 256) if all((b ^ x) not in used for x in labels))
        units[place] |= (place ^ base) << 10
        for x in labels:
            used.add(base ^ x)
        for x in labels:
            below = [k for k in keys if (k[depth] if depth < len(k) else 0) == x]
            if x == 0:
                units[place] |= 256
                units[base] = at[rules[below[0]]] | 1 << 31
            else:
                units[base ^ x] |= x
                build(base ^ x, below, depth + 1)

    build(0, list(rules), 0)
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


RULES = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "é".encode(): "é".encode(), b"\t": b" ", " ".encode(): b" ", b"\x01": b"", "①".encode(): b"1", "①②".encode(): b"12", "…".encode(): b"...", "½".encode(): b" 1/2 "}


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("rules", [{}, RULES])
def test_models_with_other_rules(squeeze, prefix, rules):
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    if rules:
        proto.normalizer_spec.name = "own"
        proto.normalizer_spec.precompiled_charsmap = char_map(rules)
    data = proto.SerializeToString()
    own, lib = pieces.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(9)
    more = ["".join(rng.choices(["ﬁ", "Ａ", "é", "e", "\t", " ", "\x01", "①", "②", "…", " ", "a", "½", "the "], k=rng.randrange(1, 15))) for _ in range(150)]
    for text in [t for t in ODD if len(t) < 500] + more + fuzz(60, 8):
        held(own, lib, text)


def test_query(spark, tmp_path):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, *ODD, *fuzz(80, 2), "word " * 300_000, "é" * 400_000, "", "a", "a"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_pieces(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest, hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id string, text string")
    for c in ("ids", "starts", "ends", "decoded"):
        docs = docs.withColumn(c, F.lit("own"))
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    assert sorted(r.decoded for r in out.collect()) == ["", "a b"]
    both = pieces.round_trip(docs, MODEL)
    assert both.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, out.drop("text").collect()))
    assert pieces.decode(pieces.encode(docs.where("false"), MODEL), MODEL).count() == 0
