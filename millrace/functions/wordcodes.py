"""Vectorised word and shingle hashes of Arrow text batches.

A word is a run of a-z and 0-9 after lower-casing; every other byte separates. Hashes are
computed for a whole chunk of texts at once with NumPy, never word by word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(48, 58)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = 1 << 20):
    """(first row, slice) with about `limit` bytes each; one longer text is one chunk."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


#: Bytes hashed at once; a longer text is cut between words.
BLOCK = 1 << 22


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, past-the-last byte) of the words of a byte array; `breaks` are places where a word may not go on."""
    inside = _WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[breaks] = inside[breaks]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    end[before] = inside[before]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts]), starts, stops


def _blocks(data: np.ndarray):
    at = 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data) and _WORD[data[stop]] and _WORD[data[stop - 1]]:
            stop += 1
        yield at, data[at:stop]
        at = stop


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, and first and past-the-last byte (in the lower-cased text) of each word; nulls have none."""
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none.astype(np.uint64), none, none, none
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return none.astype(np.uint64), none, none, none
    data = np.frombuffer(low.buffers()[2], np.uint8)[first:last]
    at = offsets - first
    if len(data) <= BLOCK:
        hashes, starts, stops = _hash_words(data, np.unique(at[at < len(data)]))
    else:
        found = []
        for base, block in _blocks(data):
            inner = at[(at >= base) & (at < base + len(block))] - base
            h, a, b = _hash_words(block, np.unique(inner))
            found.append((h, a + base, b + base))
        hashes, starts, stops = (np.concatenate(x) for x in zip(*found))
    rows = np.searchsorted(at, starts, "right") - 1
    return hashes, rows, starts - at[rows], stops - at[rows]


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (index into `hashes`) of each run of k words within a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0], rows[:0], np.zeros(0, np.int64)
    whole = np.zeros(n, np.uint64)
    for i in range(k):
        whole = whole * _STEP + hashes[i : i + n]
    fits = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(whole[fits]), rows[fits], fits


def distinct_by_row(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of each row, ordered by row and code."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    if len(codes):
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        codes, rows = codes[keep], rows[keep]
    return codes, rows
