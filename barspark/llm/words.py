"""Words of Arrow string columns as 64-bit hashes, computed over whole byte buffers instead of word by word.

A word is a longest run without the white space characters 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is
a polynomial over its bytes modulo 2^64, taken from running sums, and then mixed with the word's length. Equal
words have equal hashes everywhere, as nothing here depends on the process or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK_BYTES + 1:  # one very long text: not worth keeping
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _tables:
        _tables.update(up=_powers(_BASE, CHUNK_BYTES + 1), down=_powers(_INVERSE, CHUNK_BYTES + 1))
    return _tables["up"][:n], _tables["down"][:n]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows within them), of at most `most` bytes unless one row alone is longer. Nulls are empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words, and the first word of each row (one more entry than rows)."""
    inside = ~SPACES[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[LOWER[raw]] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, first word of each row) of each chunk."""
    for first, last, raw, offsets in chunks(texts):
        starts, ends, rows = word_bounds(raw, offsets)
        yield first, last, word_hashes(raw, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, ascending within a row, and the first one of each row.

    A row with fewer words than `width` has its whole sequence as its one shingle; a row without words has none.
    """
    counts = np.diff(rows)
    sizes = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(firsts[-1], np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64))
    n = len(words) - width + 1
    if n > 0:
        sums = words[:n] * factors[0]
        for k in range(1, width):
            sums += words[k : n + k] * factors[k]
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[:n] == row[width - 1 :]
        out[np.repeat(counts >= width, sizes)] = mix(sums[whole])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[rows[r] : rows[r + 1]]
        out[firsts[r]] = mix(mix((part * factors[: len(part)]).sum(keepdims=True)) + np.uint64(len(part)))[0]
    for r in np.flatnonzero(sizes > 1):
        out[firsts[r] : firsts[r + 1]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[firsts[:-1][sizes > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[firsts]
