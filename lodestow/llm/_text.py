"""Byte-level text primitives for Arrow tasks: one numpy pass over a block of texts instead of a loop over words.

Words are runs of bytes outside a separator set. As all separators are ASCII, cutting UTF-8 bytes
is the same as cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)

#: White space of the contracts: U+0020 and U+0009 to U+000D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits.
PUNCT = np.ones(256, dtype=bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False

#: A block holds whole texts of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_block(data: np.ndarray, lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~space[data]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    size = ends - starts
    first = np.cumsum(size) - size
    letters = (_LOWER if lower else _SAME)[data[word[1:-1].view(bool)]]
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
    total = np.add.reduceat(_BYTE[letters] * powers[place], first)
    return mix(total ^ (size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))), starts


def word_blocks(texts: Sequence[str | None], lower: bool = True, space: np.ndarray = WHITE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, hashes, bounds): the words of row lo + i are hashes[bounds[i]:bounds[i + 1]]. A null is an empty text."""
    lo, part, held = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and held + len(raw) > BLOCK_BYTES:
            yield (lo, i, *_block(part, lower, space))
            lo, part, held = i, [], 0
        part.append(raw)
        held += len(raw) + 1
    if part:
        yield (lo, len(texts), *_block(part, lower, space))


def _block(part: list[bytes], lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = b" ".join(part)
    lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
    hashes, starts = _hash_block(np.frombuffer(joined, np.uint8), lower, space)
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n words in a row; empty if there are fewer than n."""
    if len(words) < n:
        return words[:0]
    out = mix(words[: len(words) - n + 1] + _U(n))
    for k in range(1, n):
        out = mix(out * _U(0xA0761D6478BD642F) + words[k : len(words) - n + 1 + k])
    return out


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words the whole sequence as one; empty without words."""
    if not len(words):
        return words
    return np.unique(ngrams(words, min(n, len(words))) if len(words) >= n else ngrams(words, len(words)))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
