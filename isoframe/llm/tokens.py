"""Byte-level BPE ids of a public tokenizer file, with a bounded cache of words.

Ids are those that the ``tokenizers`` library gives. Plain texts take a faster way to the same ids, word by word; texts that
hold an added token of the vocabulary, or very long runs of white space, go through the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from isoframe.llm.common import kept

#: Splits text before merging; fixed by the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
#: Texts in which a run of white space crosses a space cannot be cut at spaces.
_CROSSING = re.compile(r"  |[^\S ] (?=\s|\Z)")
#: Runs of white space that the fast library's pattern cannot take (it backtracks on a stack).
_LONG_RUN = re.compile(r"\s{5000}")


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder(dict):
    """word -> ids, little-endian unsigned 32 bits, of the word with a space before it."""

    def __init__(self, path: str):
        super().__init__()
        model = json.load(open(path, encoding="utf-8"))
        special = {x["content"] for x in model["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        self._path, self._whole = path, None
        to_byte = byte_of_char()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        """By the ``tokenizers`` library itself, which also finds the vocabulary's added tokens in a text."""
        if self._whole is None:
            self._whole = Tokenizer.from_file(self._path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def slow(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.slow(" " + word)
        if len(self) < CACHE and len(word) < 40:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self._special.search(text) or len(text) >= 5000 and _LONG_RUN.search(text):
            return self.whole(text)
        if _CROSSING.search(text):
            return self.slow(text)
        first, *rest = text.split(" ")
        return self.slow(first) + b"".join(map(self.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """One for each Python process, until another operator's tasks run in it."""
    return kept(("encoder", path), lambda: Encoder(path))
