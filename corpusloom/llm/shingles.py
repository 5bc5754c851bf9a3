"""Word shingles of whole texts as 64-bit values, the same for operators on near copies and on passages.

Words are hashed as bytes, in numpy: sums of powers over a prefix sum, modulo 2^64, so that no word becomes a Python
object and no memo is held. The same prefix sums, over words, give the value of any block of words in constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import only

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (splitmix64)."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(more - 1, b))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0x2545F4914F6CDD1D), Powers(0x9E3779B97F4A7C15)
#: One random value a byte; A-Z have those of a-z.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes hashed in one go.
_CHUNK = 1 << 18


class Blocks:
    """Values of blocks of words: the same words give the same value wherever they stand."""

    def __init__(self, words: np.ndarray):
        up, self.down = _WORDS.upto(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.down[starts]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def flat_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and how many each text has. A word is a run of bytes other than
    space and U+0009 to U+000D; A-Z count as a-z."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = ~_BLANK[raw]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + _CHUNK, "right")))
        low, high = int(starts[i]), int(stops[j - 1])
        up, down = _BYTES.upto(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[raw[low:high]] * up, out=sums[1:])
        a, b = starts[i:j] - low, stops[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out, np.diff(np.searchsorted(starts, ends))


class Shingler:
    """Lower-cases A-Z, takes runs of bytes other than space and U+0009 to U+000D, hashes every `size` in a row."""

    def __init__(self, size: int):
        self.size = size

    def word_hashes(self, texts: pa.StringArray) -> list[np.ndarray]:
        only("words")
        flat, sizes = flat_words(texts)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def positional(self, words: np.ndarray) -> np.ndarray:
        """The shingle that starts at each word; fewer words than a shingle count as one sequence; none without words."""
        n = min(self.size, len(words))
        if not n:
            return words
        h = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            h = mix(h * _M1 + words[i : len(words) - n + 1 + i])
        return h

    def sets(self, texts: pa.StringArray) -> list[np.ndarray]:
        return [np.unique(self.positional(w)) for w in self.word_hashes(texts)]
