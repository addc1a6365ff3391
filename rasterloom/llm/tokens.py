"""Hashed words of texts for the numpy operators: plain functions over byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Letters, digits and bytes of other scripts stay (A-Z as a-z); all else becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Hashes(dict):
    """Word to 64-bit hash; forgets all when it has grown to ``most`` words."""

    def __init__(self, most: int = 1 << 19):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def slices(col: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column (null: empty) in runs of about ``size`` bytes, each with its first row."""
    part: list[bytes] = []
    first = total = 0
    for i, t in enumerate(col.cast(pa.binary()).to_pylist()):
        part.append(t or b"")
        total += len(part[-1])
        if total >= size:
            yield first, part
            part, first, total = [], i + 1, 0
    if part:
        yield first, part


def runs(col: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The runs of ``slices``, as parts of the column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = before = 0
    while first < len(col):
        last = min(int(np.searchsorted(ends, before + size)) + 1, len(col))
        yield first, col.slice(first, last - first)
        first, before = last, ends[last - 1]


def numbered(texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts (null: none), A-Z lower-cased, and one ``end``, which holds a space, after each text.

    Where each text begins (and the last one's end), the number of each word, and the hashes of the different words by number."""
    # Arrow's functions for ASCII take bytes as they are; they only want them to be called a string.
    given = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
    found = pc.ascii_split_whitespace(pc.ascii_lower(given))
    every, ends = found.values, found.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(every), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])[ends]
    begin = before - before[0] + np.arange(len(ends))
    coded = every.filter(full).dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
    at = np.full(begin[-1], len(h), np.int64)
    word = np.ones(len(at), bool)
    word[begin[1:] - 1] = False
    at[word] = coded.indices.to_numpy()
    return begin, at, np.append(h, np.uint64(xxhash.xxh64_intdigest(end)))


def hashed(texts: list[list[bytes]], memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (and the last one's end)."""
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    look = memo.__getitem__
    ids = np.empty(int(begin[-1]), np.uint64)
    for t, at in zip(texts, begin.tolist()):
        ids[at : at + len(t)] = list(map(look, t))
    return ids, begin


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; a text's own values only, so equal texts have equal sums to the last bit."""
    out, some = np.zeros(len(begin) - 1), np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(values, begin[:-1][some], dtype=np.float64)
    return out
