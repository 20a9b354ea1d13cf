"""Vectorised text helpers used by the operators here, and the library's scratch tables and files."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.sources.scratch import cut, delete, drop, open_file, scratch_path, shared_root, small_batches, write_file

__all__ = ["cut", "delete", "drop", "free_name", "hash_words", "hashed_texts", "mix", "open_file", "scratch_path", "shared_root", "slices", "small_batches", "string_buffers", "word_count", "word_spans", "write_file"]



def _give_memory_back() -> None:
    """Let the C library hand freed arrays of a MB and more back to the system at once. By default its limit grows to 32
    MB with the arrays that it sees, and Python workers, which live from stage to stage, keep what each has freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:  # as in glibc; -3 and -1 name its limits for mapping and trimming
        mallopt(-3, 1 << 20)
        mallopt(-1, 1 << 20)


_give_memory_back()

#: Words everywhere in this subpackage: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(columns: list[str], name: str) -> str:
    """The name, or one like it that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- text in Arrow batches -----------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Words are hashed in runs of about so many bytes, which also fit the processor's caches.
_RUN = 1 << 16
_POWER, _INVERSE = (np.cumprod(np.append(np.uint64(1), np.full(2 * _RUN, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _BASE_INV))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Index ranges of consecutive texts with at most limit bytes together, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text (length texts + 1)."""
    solid = ~_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased first if asked: a polynomial in random byte values modulo 2^64,
    from one running sum over the bytes."""
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = int(np.searchsorted(ends, begin + 2 * _RUN, "right"))
        if j <= i:  # one very long word, run by run
            h, size = 0, int(ends[i] - begin)
            for k in range(0, size, _RUN):
                part = raw[begin + k : begin + min(k + _RUN, size)]
                h += int((table[part] * _POWER[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k, 2**64)
            out[i] = h % 2**64
            i += 1
            continue
        j = min(j, max(i + 1, int(np.searchsorted(starts, begin + _RUN))))
        part = raw[begin : ends[j - 1]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _POWER[: len(part)], out=run[1:])
        a, b = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (run[b] - run[a]) * _INVERSE[a]
        i = j
    return mix(out)


def hashed_texts(column, limit: int = 1_000_000, lower: bool = True):
    """Yield (first text, last text + 1, word hashes, words before each text of the range) over slices of a column."""
    raw, offsets = string_buffers(column)
    for i, j in slices(offsets, limit):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, before = word_spans(part, own)
        yield i, j, hash_words(part, starts, ends, lower), before
