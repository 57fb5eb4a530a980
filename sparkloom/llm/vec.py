"""Words, word hashes and shingle sets of whole Arrow text columns, computed with numpy on the UTF-8
bytes of many rows at once. Every chunk holds about a megabyte of text (or one longer row), so memory
does not depend on the batch size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.store import mix

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z

#: Bytes of words that white space ends: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        step = np.uint64(int(out[done - 1]) * int(base) & (2**64 - 1))
        out[done : done + take] = out[:take] * step
        done += take
    return out


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK + (CHUNK >> 2):
        return _powers(n, _BASE), _powers(n, _INVERSE)
    if not _tables:
        size = CHUNK + (CHUNK >> 2)
        _tables["up"], _tables["down"] = _powers(size, _BASE), _powers(size, _INVERSE)
    return _tables["up"], _tables["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each row."""
    inside = table[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z read as a-z."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words of a row, and the number of them in each row. A row of fewer
    words, but not none, gives one: that of all its words."""
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    place = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    full = counts >= k
    n = int(sizes[full].sum())
    if n:
        rows = np.repeat(np.arange(len(counts))[full], sizes[full])
        within = np.arange(n) - np.repeat(np.cumsum(sizes[full]) - sizes[full], sizes[full])
        first = begin[rows] + within
        out[place[rows] + within] = _run_hash(hashes, first, k)
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            out[place[short]] = _run_hash(hashes, begin[short], m)
    return out, sizes


def _run_hash(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(first), k, dtype=np.uint64)
    for j in range(k):
        total = total * _BASE + hashes[first + j]
    return mix(total)


def long_runs(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, from prefix sums: the work doesn't depend on k."""
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[first + k] - sums[first]) * down[first] + np.uint64(k))


def distinct_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their number."""
    out, sizes, at = [], np.zeros(len(counts), dtype=np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n:
            part = np.sort(values[at : at + n])
            if n > 1:
                keep = np.empty(n, dtype=bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            out.append(part)
            sizes[i] = len(part)
            at += n
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum (modulo 2**64) of the values of each row."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def shingle_sets(column: pa.Array, k: int, table: np.ndarray = SPACED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, distinct shingle hashes row after row (sorted within each), and set sizes."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, counts = words(part, offsets[lo : hi + 1] - offsets[lo], table)
        values, sizes = shingles(word_hashes(part, starts, ends), counts, k)
        yield lo, hi, *distinct_rows(values, sizes)
