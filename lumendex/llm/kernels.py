"""Vectorised word, shingle and MinHash kernels over Arrow string buffers.

Every function here works on whole batches of texts in numpy, without a Python
loop per word.  A word is a run of bytes outside space and 0x09-0x0D, with A-Z
lower-cased; its 64-bit hash depends on its bytes alone, so it is the same in
every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..runtime import caches

U = np.uint64
np.seterr(over="ignore")  # hashes wrap
#: Bytes of text that one numpy pass handles (a longer single text is one pass of its own).
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 3
_STEP = U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    value = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))[low]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


_VALUE, SPACE = _tables()
_POWERS: dict[str, np.ndarray] = {}
caches.append(_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, at least one row long."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes from start to end."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def hashes(column: pa.Array) -> np.ndarray:
    """The hash of each string as one word; strings that differ in the case of A-Z alone share it."""
    data, offs = buffers(column)
    parts = [_hashes(data[offs[a] : offs[b]], offs[a:b] - offs[a], offs[a + 1 : b + 1] - offs[a]) for a, b in chunks(offs)]
    return np.concatenate([np.zeros(0, dtype=U), *parts])


class Words:
    """The words of consecutive texts: `hash`, `start`, `end` (bytes) and `doc` (row) of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.docs = n = len(offsets) - 1
        gap = SPACE[data]
        inside = ~gap
        first = inside.copy()
        if len(data):
            first[1:] &= gap[:-1]
            cut = offsets[:-1][offsets[:-1] < len(data)]
            first[cut] = inside[cut]
            last = inside.copy()
            last[:-1] &= gap[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            last[ends] = inside[ends]
        else:
            last = first
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = _hashes(data, self.start, self.end)
        self.count = np.bincount(self.doc, minlength=n).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text and the n+1 offsets of the texts.

    A text of fewer than k words has its whole word sequence as its one shingle;
    a text without words has none.
    """
    n, h = words.docs, words.hash
    rolled = np.zeros(len(h), dtype=U)
    power = U(1)
    left = words.first[1:][words.doc] - np.arange(len(h))  # words from here to the end of the text
    for j in range(k):
        take = np.flatnonzero(left > j)
        rolled[take] += h[take + j] * power
        power *= _STEP
    short = words.count < k
    whole = np.zeros(len(h), dtype=bool)
    heads = words.first[:-1][short & (words.count > 0)]
    whole[heads] = True
    keep = (left >= k) | whole
    rolled = mix(rolled + np.where(whole, words.count[words.doc].astype(U), U(k)))
    hashes, docs = rolled[keep], words.doc[keep]
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(n + 1))


def one_permutation(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash rows (texts x bins) with optimal densification; `bins` is a power of two.

    The top bits of a shingle hash are its bin, and the least hash in a bin is the
    bin's value.  An empty bin takes the value of the first non-empty bin in a
    pseudo-random probe sequence of its own, the same for all texts, so that each
    bin still agrees between two texts with their Jaccard similarity.
    """
    n, bits = len(offsets) - 1, U(bins.bit_length() - 1)
    out, full = np.zeros((n, bins), dtype=U), np.zeros((n, bins), dtype=bool)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    at = (hashes >> (U(64) - bits)).astype(np.int64)
    cell = doc * bins + at
    if len(cell):
        head = np.ones(len(cell), dtype=bool)
        head[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[head]] = hashes[head]
        full.reshape(-1)[cell[head]] = True
    some = np.flatnonzero(full.any(axis=1))
    rows, cols = np.nonzero(~full[some])
    rows = some[rows]
    attempt = 0
    while len(rows):
        attempt += 1
        if attempt <= 4 * bins:
            source = (mix(cols.astype(U) * U(0x100000001B3) + U(attempt) * _STEP) % U(bins)).astype(np.int64)
        else:  # certain to end: walk round the ring
            source = (cols + attempt) % bins
        hit = full[rows, source]
        out[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` neighbouring bins (texts x bands)."""
    n, bins = signatures.shape
    keyed = np.zeros((n, bins // rows), dtype=U)
    power = U(1)
    for j in range(rows):
        power *= _STEP
        keyed += mix(signatures[:, j::rows]) * power
    return mix(keyed + np.arange(bins // rows, dtype=U) * U(0x9E3779B97F4A7C15))
