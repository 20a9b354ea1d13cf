"""Alignment of what two tokenizers make of the same texts, counted over a corpus.

A, of the tokenizers library and byte-level, encodes a space and the text; B, of the sentencepiece library, puts that space
there itself. Both lists of tokens cover the same bytes. Where a token of A and one of B end together, a group ends; an
A-B pair of tokens whose bytes overlap is a link; the count of a pair of ids is the number of links of the corpus between
the two.

Texts are shuffled whole, so that each distinct one meets its copies in one row with its multiplicity (counted before the
shuffle), and is tokenized and aligned once. The tasks work them off in chunks. What a chunk needs later, its texts'
measures and which pairs they hold, goes to a file in the shared folder; its pairs, each once with the links it has there
times the texts' multiplicities, are rows. Counts of pairs are a sum over these rows, and come back to the chunk by a join
with them, so what is shuffled is chunks x distinct pairs of a chunk, not links. Measures then meet doc_ids by the
texts' SHA-256; the side of the documents is narrow, and Spark splits it where a text has very many copies.

Neither tokenizer joins what lies on two sides of a single space, and both begin anew at a single newline, so a text
without other white space is a row of units, words with the space or newline before them; units are aligned once and
remembered, up to MOST of them in a Python worker. Any other text is one unit by itself. The tokenizers are only
loaded, from paths that are parameters.

Defined cases: null and empty texts have no tokens, nor has a text whose tokens' bytes, joined, are not the space and the
text (such as one with U+2581, which B takes for a space): all measures 0, groups_sha256 ''. Rows are returned one for
one, repeated and null ids included; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, drop, open_file, scratch_path, slices, small_batches, string_buffers, write_file
from folioworks.llm.token_files import Encoder

#: Units that a Python worker remembers (some 150 MB), and links of theirs.
MOST, MOST_LINKS = 1 << 19, 1 << 22
#: Bytes of distinct texts in a chunk.
CHUNK_BYTES = 1 << 25
#: Units that are learnt at a time; bytes of texts that are cut at a time.
_LESSON, _GROUP = 1 << 14, 1 << 20
#: Units of a chunk that are worked on at a time.
_SOME = 1 << 17

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in the entries of a byte-level vocabulary: printable ones for themselves, the
    others, in their order, for 256 and on."""
    own = {b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xad" and (b < 127 or b > 160)}
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - own))}


class Aligner:
    """Aligns units of two tokenizers and remembers them: for each, its numbers of tokens and groups, its links as pairs
    a << 32 | b in one buffer, and its groups as text, each followed by a semicolon."""

    def __init__(self, path_a: str, path_b: str, most: int = MOST, most_links: int = MOST_LINKS):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(path_a, plain=True), SentencePieceProcessor(model_file=path_b)
        self.most, self.most_links = most, most_links
        names, size = _byte_names(), self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        entries = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(names[c] for c in e) if all(c in names for c in e) else e.encode() for e in entries]
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.dummy = self.b.piece_to_id("▁")
        self.spelling = [b"%d%c" % (i, s) for s in b",|" for i in range(size)] + [b"%d%c" % (i, s) for s in b",;" for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size = self.used = 0
        self.number = np.zeros((1 << 12, 4), np.int32)  # tokens of A, of B, groups, links
        self.first = np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 14, np.uint64)
        self.groups: list[bytes] = []

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and counts of each unit, ids of B and counts of each unit."""
        place, flat, counts = self.a.learn(units)
        order = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
        begin = (np.cumsum(counts) - counts)[order]
        n_a = counts[order]
        ids_a = flat[_ranges(begin, n_a)].astype(np.int64)
        ids = self.b.encode([u.decode("utf-8") for u in units], num_threads=1)
        ids = [own[1:] if u[:1] == b"\n" and own[0] == self.dummy else own if u else [self.dummy] for u, own in zip(units, ids, strict=True)]
        return ids_a, n_a, np.array([i for own in ids for i in own], np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(self, units: list[bytes]) -> None:
        """Remember units, each what follows a space or begins with a newline."""
        for k in range(0, len(units), _LESSON):
            some = units[k : k + _LESSON]
            self._put([u if u[:1] == b"\n" else b" " + u for u in some], *self._encoded(some))
        self.place.update(zip(units, range(self.size - len(units), self.size), strict=True))

    def whole(self, text: bytes) -> int:
        """Align a whole text (with its space before it), which is kept until the next forget, but not found again."""
        t = text.decode("utf-8")
        ids_a, ids_b = self.a.tokenizer.encode(t, add_special_tokens=False).ids, self.b.encode(t[1:], num_threads=1)
        self._put([text], *(x for ids in (ids_a, ids_b) for x in (np.array(ids, np.int64), np.array([len(ids)]))))
        return self.size - 1

    def _put(self, spelled: list[bytes], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
        bytes_a, bytes_b = [self.bytes_a[i] for i in ids_a.tolist()], [self.bytes_b[i] for i in ids_b.tolist()]
        good, a, b = np.ones(len(spelled), bool), 0, 0
        for k, (s, to_a, to_b) in enumerate(zip(spelled, ends_a, ends_b, strict=True)):
            good[k] = b"".join(bytes_a[a:to_a]) == s == b"".join(bytes_b[b:to_b])
            a, b = to_a, to_b
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, -1), np.where(good, n_b, -1)  # -1 marks a unit that both do not spell
        ends_a, ends_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        ends = np.union1d(ends_a, ends_b)  # a link for each stretch between two neighbouring ends
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs = ids_a[at_a].astype(np.uint64) << np.uint64(32) | ids_b[at_b].astype(np.uint64)
        shared = np.intersect1d(ends_a, ends_b)
        until = np.cumsum(np.where(good, [len(s) for s in spelled], 0))
        n_links, n_groups = (np.diff(np.searchsorted(x, until, "right"), prepend=0) for x in (ends, shared))
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        groups = self._spelled_groups(ids_a, group_a, shared[group_a] == ends_a, ids_b, group_b, shared[group_b] == ends_b)
        tokens = np.cumsum(np.maximum(n_a, 0) + np.maximum(n_b, 0)).tolist()
        to = self.size + len(spelled)
        while to > len(self.first):
            self.number, self.first = np.concatenate([self.number, np.zeros_like(self.number)]), np.concatenate([self.first, np.zeros_like(self.first)])
        while self.used + len(pairs) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.number[self.size : to] = np.column_stack([n_a, n_b, n_groups, n_links])
        self.first[self.size : to] = self.used + np.cumsum(n_links) - n_links
        self.links[self.used : self.used + len(pairs)] = pairs
        self.groups += [b"".join(groups[x:y]) for x, y in zip([0, *tokens[:-1]], tokens, strict=True)]
        self.size, self.used = to, self.used + len(pairs)

    def _spelled_groups(self, ids_a, group_a, last_a, ids_b, group_b, last_b) -> list[bytes]:
        """All tokens as decimal numbers with what follows each, in the order of groups, A before B in each."""
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[at_a] = ids_a + last_a * len(self.bytes_a)
        code[at_b] = 2 * len(self.bytes_a) + ids_b + last_b * len(self.bytes_b)
        return [self.spelling[c] for c in code.tolist()]

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the units of all texts one after another, the number of each text's)."""
        numbers: list[np.ndarray] = []
        for k, to in slices(np.append(0, np.cumsum([len(t) for t in texts])), _GROUP):
            spelled = [b" " + t for t in texts[k:to]]
            rows = [t[1:].replace(b"\n", b" \n").split(b" ") if self.a.cuts(t) else None for t in spelled]
            self.learn([u for u in {u for row in rows if row for u in row} if u not in self.place])
            find = self.place.__getitem__
            numbers += [np.fromiter(map(find, row), np.int32, len(row)) if row else np.array([self.whole(t)], np.int32) for row, t in zip(rows, spelled, strict=True)]
        return (np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), np.fromiter(map(len, numbers), np.int64, len(numbers))


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (counts[0] of them), then from begin[1] on, and so on."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(begin - before, counts)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of tokenizers in a Python worker, with what it remembers from task to task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_TEXTS = pa.schema([("key", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("units", pa.list_(pa.int32()))])
_UNITS = pa.schema([("pairs", pa.list_(pa.int32()))])
PAIRS = "chunk long, uri string, k int, a int, b int, n long"


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of values, counts[i] of them each."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _sums_at(values: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of values[at], counts[i] of them each, of which some are taken out at a time."""
    ends, sums = np.append(0, np.cumsum(counts)), np.zeros(len(counts), np.int64)
    for i, j in slices(ends, _SOME):
        sums[i:j] = _sums(values[at[ends[i] : ends[j]]], counts[i:j])
    return sums


def _chunk(own: Aligner, texts: list[bytes], keys: list[str], copies: np.ndarray) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """The chunk's texts and units as tables, its pairs (ascending), and their links times the texts' multiplicities."""
    if own.size > own.most or own.used > own.most_links:
        own.forget()
    numbers, counts = own.units(texts)
    number = own.number[: own.size]
    spelled = _sums_at((number[:, 0] < 0).astype(np.int64), numbers, counts) == 0
    if not spelled.all():
        numbers, counts = numbers[np.repeat(spelled, counts)], np.where(spelled, counts, 0)
    measures = [_sums_at(number[:, m].astype(np.int64), numbers, counts) for m in range(4)]
    digests, weight, ends = [], np.zeros(own.size), np.append(0, np.cumsum(counts))
    for i, j in slices(ends, _SOME):  # a chunk's units as Python's numbers, or as 64 bits, would take many times its texts
        weight += np.bincount(numbers[ends[i] : ends[j]], np.repeat(copies[i:j], counts[i:j]), own.size)
        for a, b in zip(ends[i:j].tolist(), ends[i + 1 : j + 1].tolist(), strict=True):
            digests.append(hashlib.sha256(b"".join([own.groups[u] for u in numbers[a:b].tolist()])[:-1]).hexdigest() if a < b else "")
    used = np.flatnonzero(weight)
    weight, place = weight[used], np.zeros(own.size, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    local = np.empty(len(numbers), np.int32)
    for k in range(0, len(numbers), _SOME):
        local[k : k + _SOME] = place[numbers[k : k + _SOME]]
    del numbers
    n_links = own.number[used, 3].astype(np.int64)
    ends = np.append(0, np.cumsum(n_links))
    links = lambda i, j: own.links[_ranges(own.first[used[i:j]], n_links[i:j])]
    some = list(slices(ends, _SOME))
    pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(links(i, j)) for i, j in some)]))
    of_link, of_pair = np.empty(ends[-1], np.int32), np.zeros(len(pairs))
    for i, j in some:
        of_link[ends[i] : ends[j]] = at = np.searchsorted(pairs, links(i, j))
        of_pair += np.bincount(at, np.repeat(weight[i:j], n_links[i:j]), len(pairs))
    lists = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))
    table = pa.Table.from_arrays([pa.array(keys, pa.string()), *(pa.array(m) for m in measures), pa.array(digests, pa.string()), lists(local, counts)], schema=_TEXTS)
    return table, pa.Table.from_arrays([lists(of_link, n_links)], schema=_UNITS), pairs, of_pair.astype(np.int64)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def aligned_texts(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (text) -> the pairs of each chunk of distinct texts, a table in the shared folder: chunk, k (the pair's number
    in the chunk), a, b, n; the row of k = 0 names the chunk's file."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "alignment")
    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select("text", F.sha2("text", 256).alias("key"), "copies")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, own = TaskContext.get(), aligner(tokenizer_a, tokenizer_b)
        texts, keys, copies, held, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            table, units, pairs, weight = _chunk(own, texts, keys, np.array(copies, np.float64))
            uri, _ = write_file(folder, f"{context.partitionId():06d}-{seq:06d}-{context.taskAttemptId()}.arrow", [_packed(table), _packed(units)])
            n = len(pairs)
            columns = [np.full(n, context.partitionId() << 32 | seq), pa.array([uri] * min(n, 1) + [None] * (n - 1), pa.string()), np.arange(n, dtype=np.int32)]
            columns += [(pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), weight]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "uri", "k", "a", "b", "n"])

        for batch in batches:
            raw, offsets = string_buffers(batch.column(0))
            raw = raw.tobytes()
            for a, b, key, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(raw[a:b])
                keys.append(key)
                copies.append(n)
                held += b - a
                if held >= chunk_bytes:
                    yield flush()
                    texts, keys, copies, held, seq = [], [], [], 0, seq + 1
        if texts:
            yield flush()

    return cut(distinct.mapInArrow(work, PAIRS), "pairs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pairs of the chunks -> a, b, count, best (whether no other a has more links with this b)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (the measures of each document, the counts of pairs)."""
    pairs = aligned_texts(docs, tokenizer_a, tokenizer_b, chunk_bytes)
    counts = cut(pair_counts(pairs), "pair-counts")

    def measured(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        uri = part["uri"].dropna().iloc[0]
        with open_file(uri) as stream:
            texts, units = pa.ipc.open_stream(stream).read_all(), pa.ipc.open_stream(stream).read_all()
        flat = units.column("pairs").combine_chunks()
        sizes, at = np.diff(flat.offsets.to_numpy()), flat.values.to_numpy()
        words = texts.column("units").combine_chunks()
        lengths, of_text = np.diff(words.offsets.to_numpy()), words.values.to_numpy()
        out = texts.drop_columns(["units"]).to_pandas()
        for name, value in (("n_best", part["best"].to_numpy().astype(np.int64)), ("count_sum", part["count"].to_numpy())):
            out[name] = _sums_at(_sums_at(value, at, sizes), of_text, lengths)
        return out[["key", *MEASURES, "groups_sha256"]]

    back = pairs.join(counts, ["a", "b"]).select("chunk", "uri", "k", "count", "best")
    schema = "key string, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"
    of_texts = cut(back.groupBy("chunk").applyInPandas(measured, schema), "measures")
    drop(pairs)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("key")).join(of_texts, "key", "left")
    none = [F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in MEASURES]
    return x.select("doc_id", *none, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), counts
