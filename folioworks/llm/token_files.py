"""Token ids of a corpus in wavelet-matrix files, one for each shard of consecutive documents.

Documents are range-partitioned by id and sorted; each task encodes its own and writes a file for every shard_tokens
ids (a document is never split: one of more ids is a shard of its own). The manifest, a table in the shared folder,
names the files in order with their sizes; where a document starts in the whole corpus follows from running sums over
partitions and over the shards of a partition.

Encoding: a tokenizer whose pre-tokenizer cuts before single spaces encodes a text as the concatenation of what it
makes of the pieces between them, so each distinct piece is encoded once in a Python worker and remembered, up to MOST
pieces: the frequent ones come first and stay, what comes later is encoded once for each group of texts. Pieces of up to
16 bytes are keys of two integers in an open-addressed table that is probed for all pieces of a group at once; they are
compared whole, so no two pieces can be taken for one another. New pieces are encoded many at a time, joined with spaces
again, and their ids cut where a token begins with the space. All this is done only for texts where the cuts are
certain: no white space but single spaces and single newlines between other characters, no special token's text; every
other text goes to the tokenizer whole. The tokenizer is only loaded, from a path that is a parameter.

Defined cases: null text is the empty text, with the end id alone; documents are in ascending order of doc_id, null
first, repeated ids by their text's hash; an empty table gives no files and an empty result; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm import wavelet
from folioworks.llm.shared import cut, mix, open_file, scratch_path, small_batches, string_buffers, write_file

#: Remembered pieces: at most so many (some 50 MB in a worker).
MOST = 1 << 20
#: Stands before the first piece of a text; a control character, which no text that is cut in pieces has.
START = b"\x1c"
_CONTROL = bytes([0, 9, 11, 12, 13, 28, 29, 30, 31])
#: White space beyond ASCII: U+0085, U+00A0, U+1680, U+205F, U+3000, and what U+2000 to U+203F holds of it.
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_MORE_SPACE = re.compile(b"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
_WIDE = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Pieces:
    """Remembered pieces of up to 16 bytes without NUL, padded to two integers, with their ids in one buffer."""

    def __init__(self, kind: np.dtype):
        self.size, self.used = 0, 0
        self.key = [np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)]
        self.first, self.count = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.flat = np.zeros(1 << 16, kind)
        self._slots = np.full(1 << 16, -1, np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bits = len(self._slots).bit_length() - 1
        return (mix(low ^ mix(high + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 where one is not remembered."""
        at = self._home(low, high)
        got = self._slots[at]
        left = np.flatnonzero((got >= 0) & ((self.key[0][got] != low) | (self.key[1][got] != high)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self._slots) - 1)
            now = self._slots[at[left]]
            got[left] = now
            left = left[(now >= 0) & ((self.key[0][now] != low[left]) | (self.key[1][now] != high[left]))]
        return got

    def put(self, ids: np.ndarray) -> int:
        """Place ids at the end of the buffer, for now; returns where."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        return self.used

    def add(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, counts: np.ndarray, length: int) -> None:
        """Remember distinct new pieces whose ids lie among the last length ids that were put, which now stay."""
        to = self.size + len(low)
        while to > len(self.first):
            self.key = [np.concatenate([k, np.zeros_like(k)]) for k in self.key]
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.used += length
        for column, own in zip((*self.key, self.first, self.count), (low, high, first, counts), strict=True):
            column[self.size : to] = own
        numbers = np.arange(self.size, to, dtype=np.int32)
        if 4 * to > len(self._slots):  # a quarter full at most, so probing is short
            self._slots = np.full(4 * len(self._slots), -1, np.int32)
            numbers, low, high = np.arange(to, dtype=np.int32), self.key[0][:to], self.key[1][:to]
        at, left = self._home(low, high), np.arange(len(numbers))
        while len(left):
            free = left[self._slots[at[left]] < 0]
            self._slots[at[free]] = numbers[free]
            left = left[self._slots[at[left]] != numbers[left]]
            at[left] = (at[left] + 1) & (len(self._slots) - 1)
        self.size = to


class Encoder:
    """Encodes UTF-8 texts to arrays of ids with a tokenizer of the tokenizers library."""

    def __init__(self, path: str, most: int = MOST, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = plain  # special tokens' strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.levels = max(1, int(size - 1).bit_length())
        self.kind = np.dtype("H") if self.levels <= 16 else np.dtype("I")
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        pre = json.loads(self.tokenizer.to_str())
        step = pre.get("pre_tokenizer") or {}
        self.by_piece = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not pre.get("normalizer")
        first = [(self.tokenizer.id_to_token(i) or "?")[:1] for i in range(size)]
        self._after = {b" ": np.array([c == "\u0120" for c in first]), b"\n": np.array([c == "\u010a" for c in first])}  # byte-level names of the two
        self.pieces = Pieces(self.kind)

    def cuts(self, text: bytes) -> bool:
        """Whether the text is encoded as the concatenation of its pieces."""
        return bool(self.by_piece) and self._plain(text)

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: bytes) -> bool:
        if b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or len(text.translate(None, _CONTROL)) != len(text):
            return False
        if not text.isascii() and (any(c in text for c in _WIDE_SPACE) or b"\xe2\x80" in text and _MORE_SPACE.search(text)):
            return False
        return not any(s in text for s in self.special)

    def _alone(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        texts = [p[1:].decode("utf-8") if p[:1] == START else p.decode("utf-8") if p[:1] == b"\n" else " " + p.decode("utf-8") for p in pieces]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [i for own in ids for i in own], list(map(len, ids))

    def _joined(self, pieces: list[bytes], mark: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each follow the mark, or begin with it if it is the newline, from one long text."""
        text = b"".join(pieces) if mark == b"\n" else b" " + b" ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, self.kind)
        starts = np.flatnonzero(self._after[mark][ids])
        if len(starts) != len(pieces) or starts[0]:
            return self._alone(pieces)
        return ids, np.diff(starts, append=len(ids))

    def learn(self, fresh: list[bytes]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Numbers for the distinct pieces, their ids one after another, and how many each has. A piece stands for itself
        after a space, or, where it begins with a newline or the mark of a text's beginning, for what follows that mark."""
        kinds: dict[bytes, list[bytes]] = {b" ": [], b"\n": [], b"": []}
        for p in dict.fromkeys(fresh):
            kinds[b"" if p in (b"", b"\n") or p[:1] == START else b"\n" if p[:1] == b"\n" else b" "].append(p)
        got = [self._joined(own[k : k + 1000], mark) if mark else self._alone(own) for mark, own in kinds.items() for k in range(0, len(own), 1000 if mark else len(own) or 1)]
        ids, counts = (np.concatenate([np.asarray(x[i], kind) for x in got]) for i, kind in ((0, self.kind), (1, np.int64)))
        return {p: k for k, p in enumerate(p for own in kinds.values() for p in own)}, ids, counts

    def encode_batch(self, texts: list[bytes], limit: int = 1_000_000) -> Iterator[bytes]:
        """The ids of each text as bytes of self.kind; texts are worked off in groups of about limit bytes."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= limit:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        """Look up the pieces of all texts that can be cut, learn those not known, and lay their ids out in the order of
        the texts by one gather."""
        cuts = [self.by_piece and self._plain(t) for t in texts]
        parts = [START + t.replace(b"\n", b" \n") + b" " for t, ok in zip(texts, cuts, strict=True) if ok]
        joined = b"".join(parts)
        raw = np.frombuffer(joined + bytes(_WIDE), np.uint8)
        ends = np.flatnonzero(raw[: len(joined)] == 32)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        width = ends - starts
        window = np.lib.stride_tricks.sliding_window_view(raw, 8)
        low = window[starts].view(np.uint64)[:, 0] & _MASK[np.minimum(width, 8)]
        high = window[starts + 8].view(np.uint64)[:, 0] & _MASK[np.clip(width - 8, 0, 8)]
        number = self.pieces.find(low, high)
        number[width > _WIDE] = -1
        first, count = (x[number].astype(np.int64) for x in (self.pieces.first, self.pieces.count))
        at = np.flatnonzero(number < 0)
        if len(at):
            fresh = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            place, flat, counts = self.learn(fresh)
            own = np.fromiter(map(place.__getitem__, fresh), np.int64, len(fresh))
            begin = self.pieces.put(flat) + np.cumsum(counts) - counts
            count[at], first[at] = counts[own], begin[own]
            if self.pieces.size < self.most:
                once = at[np.unique(own, return_index=True)[1]]
                short = np.flatnonzero(width[once] <= _WIDE)
                self.pieces.add(low[once[short]], high[once[short]], begin[short], counts[short], len(flat))
        before = np.append(0, np.cumsum(count))
        out = self.pieces.flat[np.arange(before[-1]) + np.repeat(first - before[:-1], count)].tobytes() if len(count) else b""
        edges = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        places = (before[np.searchsorted(starts, edges)] * self.kind.itemsize).tolist()
        k = 0
        for text, ok in zip(texts, cuts, strict=True):
            if ok:
                yield out[places[k] : places[k + 1]]
                k += 1
            else:
                yield self._whole(text.decode("utf-8"))

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_batch([text]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer in a Python worker, with what it remembers from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST = "part int, seq int, uri string, docs long, tokens long, bytes long"


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text, ...) as token files in the shared folder -> the manifest, already written. partitions
    defaults to the number of input partitions."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "tokens")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"), F.monotonically_increasing_id())  # rows of one id, and copies of one row, spread over ranges
    x = x.repartitionByRange(partitions or max(1, x.rdd.getNumPartitions()), *order).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, enc = TaskContext.get(), encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        seq, held, ids, sizes = 0, 0, [], []
        parts: list[bytes] = []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal seq, held, ids, sizes, parts
            data = wavelet.dump(np.frombuffer(b"".join(parts), enc.kind), ids, np.array(sizes, np.int64), enc.levels)
            uri, size = write_file(folder, f"{context.partitionId():06d}-{seq:06d}-{context.taskAttemptId()}.wm", [data])
            rows.append((context.partitionId(), seq, uri, len(ids), held, size))
            seq, held, ids, sizes, parts = seq + 1, 0, [], [], []

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            raw = raw.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for doc_id, encoded in zip(batch.column(0).to_pylist(), enc.encode_batch(texts), strict=True):
                own = encoded + end
                n = len(own) // enc.kind.itemsize
                if held and held + n > shard_tokens:
                    flush()
                parts.append(own)
                ids.append(doc_id)
                sizes.append(n)
                held += n
        if ids:
            flush()
        if rows:
            names = ["part", "seq", "uri", "docs", "tokens", "bytes"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return cut(x.mapInArrow(write, MANIFEST), "manifest")


def open_token_file(uri: str) -> wavelet.WaveletFile:
    """A file of the manifest for single look-ups: only the parts asked for are read."""
    return wavelet.WaveletFile(open_file(uri, seekable=True))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with start: the ids in all files before each."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_all"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x = manifest.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part")
    return x.withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_token_files(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """manifest -> doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int) of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(uri) as stream:
                    file = wavelet.WaveletFile(stream.read())
                tokens = file.ids().astype("<u4")
                data, edges = tokens.tobytes(), np.append(0, file.ends)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                arrays = [pa.array(file.doc_ids, pa.int64()), pa.array(edges[:-1] + start), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    x = with_starts(manifest).select("uri", "start")
    return x.repartition(max(1, -(-manifest.count() // 4)), "uri").mapInArrow(read, schema)
