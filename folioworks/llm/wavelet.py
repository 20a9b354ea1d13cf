"""A wavelet matrix of token ids in one compressed file.

Level by level from the highest bit, the ids' bits form a plane and the ids are dealt stably, zeros first, to the next
level. Planes are stored in blocks of 2^15 bits, each compressed by itself, with the number of ones before each block,
so rank needs one block, and select a binary search over the counts and one block. The file holds, in this order: a
magic number, the length of the header, the header (JSON: sizes, levels, zeros of each level, lengths of the
compressed parts), the document directory (ids and ends), the counts, and the blocks.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"FWWM0001"
BLOCK = 1 << 15


def dump(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, levels: int) -> bytes:
    """The file of some documents' ids one after another; doc_ids (integers or None) and lengths say whose they are."""
    pack = zstandard.ZstdCompressor(level=1)
    n, one = len(ids), ids.dtype.type(1)
    zeros, counts, blocks = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (ids & (one << ids.dtype.type(level))) != 0
        packed = np.packbits(bit)
        starts = range(0, n, BLOCK)
        counts.append(np.cumsum([0, *(np.count_nonzero(bit[s : s + BLOCK]) for s in starts)]).astype(np.uint32))
        blocks += [pack.compress(packed[s // 8 : (s + BLOCK) // 8].tobytes()) for s in starts]
        low, high = ids.compress(~bit), ids.compress(bit)
        zeros.append(len(low))
        ids = np.concatenate((low, high))
    directory = pack.compress(json.dumps(doc_ids).encode() + b"\n" + np.cumsum(lengths).astype("<i8").tobytes())
    rank = pack.compress(np.concatenate(counts).astype("<u4").tobytes()) if counts else b""
    head = json.dumps({"n": n, "levels": levels, "zeros": zeros, "docs": len(doc_ids), "parts": [len(directory), len(rank)], "blocks": [len(b) for b in blocks]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, directory, rank, *blocks])


class WaveletFile:
    """Access, counting and occurrence look-up in a file made by dump, given as its bytes or as an open file with
    read_at(bytes, offset) and size(): beyond the header, the directory and the counts, only the blocks asked for are
    read and decompressed."""

    def __init__(self, data):
        self._read = (lambda a, b: data[a:b]) if isinstance(data, bytes) else (lambda a, b: data.read_at(b - a, a))
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", self._read(8, 12))
        head = json.loads(self._read(12, 12 + size))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        self._unpack, at = zstandard.ZstdDecompressor(), 12 + size
        directory, at = self._unpack.decompress(self._read(at, at + head["parts"][0])), at + head["parts"][0]
        line = directory.index(b"\n")
        self.doc_ids = json.loads(directory[:line])
        self.ends = np.frombuffer(directory, "<i8", offset=line + 1)
        rank = self._unpack.decompress(self._read(at, at + head["parts"][1])) if head["parts"][1] else b""
        at += head["parts"][1]
        self._counts = np.frombuffer(rank, "<u4").astype(np.int64).reshape(self.levels, -1) if rank else np.zeros((self.levels, 1), np.int64)
        self._per_level = self._counts.shape[1] - 1
        edges = np.append(0, np.cumsum(head["blocks"])).astype(np.int64) + at
        if (len(data) if isinstance(data, bytes) else data.size()) != edges[-1]:
            raise ValueError("the file is cut off or too long")
        self._edges = edges
        self._bits = lru_cache(256)(self._read_bits)

    def _read_bits(self, level: int, block: int) -> np.ndarray:
        k = level * self._per_level + block
        raw = self._unpack.decompress(self._read(int(self._edges[k]), int(self._edges[k + 1])))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK, self.n - block * BLOCK)).view(bool)

    def plane(self, level: int) -> np.ndarray:
        parts = [self._read_bits(level, b) for b in range(self._per_level)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level (0 is the highest bit)."""
        block, rest = divmod(i, BLOCK)
        return int(self._counts[level, block]) + (int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else 0)

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) bits of a kind on a level."""
        held = self._counts[level]
        held = held if bit else np.minimum(np.arange(len(held)) * BLOCK, self.n) - held
        block = np.searchsorted(held, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            places = np.flatnonzero(self._bits(level, int(b)) == bool(bit))
            out[at] = b * BLOCK + places[k[at] - held[b]]
        return out

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            block, rest = divmod(i, BLOCK)
            bit = bool(self._bits(level, block)[rest])
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among positions lo to hi."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending."""
        if token < 0 or token >> self.levels:
            return np.zeros(0, np.int64)
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """All ids: the levels undone from the lowest bit."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit, out = self.plane(level), np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            out[np.flatnonzero(bit)] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = out
        return now
