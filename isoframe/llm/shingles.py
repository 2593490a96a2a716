"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from isoframe.llm.common import kept

#: Texts are hashed in blocks of about this many bytes.
BLOCK = 1 << 20
#: Words whose digests are kept, each of at most LONG bytes.
CACHE, LONG = 200_000, 64
_KEY = b"word shingles"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """word -> 64 bits of its keyed digest, so that no words with equal numbers can be built from the words themselves."""

    def __missing__(self, word: bytes) -> int:
        number = int.from_bytes(blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = number
        return number


def words_of(text: bytes) -> list[bytes]:
    """Its runs of bytes that are not white space, A-Z lower-cased."""
    return text.lower().split()


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k words each, or all of them where there are fewer, or none."""
    salts = mix(np.arange(1, k + 2, dtype=np.uint64) * _STEP) | np.uint64(1)
    digest = kept("word digests", Digests).__getitem__
    at = 0
    while at < len(texts):
        end, size, found, cuts = at, 0, [], [0]
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end]) + 1
            found += words_of(texts[end])
            cuts.append(len(found))
            end += 1
        words = np.fromiter(map(digest, found), np.uint64, len(found))
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k if len(grams) else 0):
            grams += words[i : i + len(grams)] * salts[i]
        grams = mix(grams)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = hi - lo
            if n >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif n:
                yield mix(np.array([(words[lo:hi] * salts[:n]).sum(dtype=np.uint64)], np.uint64) + salts[k : k + 1] * np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
        at = end
