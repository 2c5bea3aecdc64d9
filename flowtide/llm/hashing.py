"""Word and shingle hashes of many texts at once, as array arithmetic over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word is taken whole.
CHUNK = 1 << 20

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)  # A-Z fold to a-z, nothing else does
    return mix(codes, 1)


_BYTES = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the radix and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(int(_RADIX), n), _powers(_inverse(int(_RADIX)), n)
        return self.up, self.down


_POWERS = _Powers()


def _words_of(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one run of bytes, in order."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    if not len(edges):
        return np.empty(0, np.uint64)
    first, last = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first], 2) ^ mix((last - first).astype(np.uint64), 3)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text given as bytes; A-Z count as a-z.

    Works through the text in chunks that end between words, so memory does not grow with the text beyond one hash a word.
    """
    if len(data) <= CHUNK:
        return _words_of(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            more = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = end + int(more[0]) if len(more) else min(len(data), end + CHUNK)
        parts.append(_words_of(data[at:end]))
        at = end
    return np.concatenate(parts)


def text_bytes(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text, without a copy; None for null."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    valid, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        yield raw[at[i] : at[i + 1]] if known[i] else None


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = mix(words[:n], 4)
    for k in range(1, width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n], 5)
    return np.unique(mix(out, 6 + width))
