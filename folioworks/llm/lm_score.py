"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling in parallel, and scores of whole texts.

Tokens are lower-cased words and one end for each text. Each word before (or the beginning of a text) is a context with
a restaurant of its own; all of them share one parent, the root, whose base is uniform over the vocabulary and one
unknown word. Contexts are told apart by 64-bit hashes of their words, so there are as many as the corpus has.

How it runs:
1. Each task turns its documents into chunks: distinct (word, context) pairs with their training counts, dealt to
   buckets by the word's hash, and for each document the list of pairs it holds. Texts are read once.
2. All tables of a word lie in one bucket, in the contexts' restaurants and in the root, so a table opened or left empty
   below is a customer come or gone above within the bucket. Only the number of customers and tables of each context is
   global: a distributed table, to which each bucket sends its contexts' numbers and from which it gets the sums back.
   A bucket reads its chunks' rows one after another and adds them up as it goes.
3. Gibbs (restaurants.py): in a sweep each dish's whole seating is drawn anew given all others, from its conditional
   distribution: all its customers rise and sit down again, at a new table with weight (theta + d T) P(parent), at an old one
   of s customers with weight s - d. Dishes are drawn side by side, one random half of them given the other; the tables are the
   root's customers, whose seatings are drawn next, and P(parent) stands still in between. T of other buckets is taken to move in
   proportion to the own bucket's. After burn_in sweeps every sweep is a sample; its tables are written to a file for each
   bucket, and its totals are exchanged.
4. For every pair of every chunk the bucket answers with the predictive probability, averaged over the samples; a
   document's score is the sum of log10 over its tokens. Chunks and answers meet by chunk number.

Chunks' rows are shuffled to their buckets once; a bucket keeps its dishes, and the pairs that each chunk asks for as numbers
among them, in a file in the shared folder, which the later jobs read.

Frequent words are counts, pre-aggregated in each chunk; a bucket's memory follows its distinct pairs.

Defined cases: null text is the empty text, one end token; a null id is learnt from and never held out; repeated rows count and are scored each
by itself; an empty table gives an empty result; without any training rows counts are 0 and the model is its base;
further columns are ignored; a text of any length is part of one chunk.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.restaurants import draw_tables
from folioworks.llm.shared import cut, delete, drop, hash_words, mix, open_file, scratch_path, slices, small_batches, string_buffers, word_spans, write_file

CHUNK_BYTES = 8_000_000
#: Pairs of a bucket that are added up at a time.
TOGETHER = 1_000_000
END = np.uint64(0x5DEECE66D1234567)


# ---- compact integers ----------------------------------------------------------------------------------------


def packed(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers as byte planes, compressed."""
    a = np.ascontiguousarray(a, kind)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def packed_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit hashes."""
    return packed(np.diff(a, prepend=np.uint64(0)), "<u8")


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


# ---- chunks --------------------------------------------------------------------------------------------------

CHUNK = (
    "chunk long, bucket int, words binary, held binary, pairs binary, names binary, contexts binary, counts binary, "
    "ids array<long>, lengths array<int>, entries array<int>, deltas binary, times binary, held_out array<boolean>"
)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the word's hash, so a chunk's buckets are ranges of its sorted words."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(contexts * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))


def _chunk(words: np.ndarray, contexts: np.ndarray, doc: np.ndarray, learn: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted distinct words and pairs of a chunk with training counts, and the pairs of each document."""
    _, at, inverse = np.unique(pair_keys(words, contexts), return_index=True, return_inverse=True)
    order = np.lexsort((contexts[at], words[at]))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    pair = rank[inverse]
    pair_words, pair_contexts = words[at][order], contexts[at][order]
    counts = np.bincount(pair[learn[doc]], minlength=len(at))
    first = np.flatnonzero(np.append(True, pair_words[1:] != pair_words[:-1]))
    entry, times = np.unique((doc.astype(np.int64) << 32) | pair, return_counts=True)
    entry_doc, entry_pair = entry >> 32, entry & 0xFFFFFFFF
    deltas = np.diff(entry_pair, prepend=0)
    starts = np.flatnonzero(np.append(True, entry_doc[1:] != entry_doc[:-1]))
    deltas[starts] = entry_pair[starts]
    return {
        "words": pair_words[first], "held": np.diff(np.append(first, len(pair_words))), "contexts": pair_contexts, "pairs_before": first,
        "counts": counts, "entries": np.bincount(entry_doc, minlength=len(learn)), "deltas": deltas, "times": times,
    }


def chunks(docs: DataFrame, held_out: Column, buckets: int) -> DataFrame:
    """docs (doc_id, text) -> CHUNK rows: for each chunk one row for each bucket (bucket >= 0), and one with its
    documents (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        words: list[np.ndarray] = []
        contexts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list = []
        out: list[bool] = []
        size = 0
        schema = pa.schema(
            [("chunk", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("words", "held", "pairs", "names", "contexts", "counts")]]
            + [("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("entries", pa.list_(pa.int32())), ("deltas", pa.binary()), ("times", pa.binary()), ("held_out", pa.list_(pa.bool_()))]
        )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            n = np.concatenate(lengths)
            c = _chunk(np.concatenate(words), np.concatenate(contexts), np.repeat(np.arange(len(n)), n), ~np.array(out))
            number = (part << 24) | seq
            edges = np.searchsorted(_bucket(c["words"], buckets), np.arange(buckets + 1))
            pair_edges = np.append(c["pairs_before"], len(c["contexts"]))[edges]
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                w, p = slice(edges[b], edges[b + 1]), slice(pair_edges[b], pair_edges[b + 1])
                names, place = np.unique(c["contexts"][p], return_inverse=True)
                rows.append((number, b, packed_sorted(c["words"][w]), packed(c["held"][w]), None, packed_sorted(names), packed(place), packed(c["counts"][p]), None, None, None, None, None, None))
            rows.append((number, -1, None, None, packed(c["held"]), None, None, None, list(ids), n.tolist(), c["entries"].tolist(), packed(c["deltas"]), packed(c["times"]), list(out)))
            for row in (rows[i : i + 64] for i in range(0, len(rows), 64)):
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*row, strict=True), schema, strict=True)], schema=schema)
            seq, size = seq + 1, 0
            for held in (words, contexts, lengths, ids, out):
                held.clear()

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            batch_ids, batch_out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in slices(offsets, 1_000_000):
                text, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, before = word_spans(text, own)
                h = hash_words(text, starts, ends)
                n = np.diff(before) + 1
                first = np.append(0, np.cumsum(n))[:-1]
                place = np.arange(len(h)) + np.repeat(np.arange(j - i), n - 1)
                w, c = np.full(int(n.sum()), END), np.full(int(n.sum()), END)
                w[place] = c[place + 1] = h
                c[first] = END
                words.append(w)
                contexts.append(c)
                lengths.append(n)
                ids += batch_ids[i:j]
                out += [bool(x) for x in batch_out[i:j]]
                size += len(text) + 8 * (j - i)
                if size >= CHUNK_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(run, CHUNK)


# ---- restaurants ---------------------------------------------------------------------------------------------


class Bucket:
    """The dishes of one bucket: distinct pairs with training counts, in the order of their words and contexts; key holds both as
    numbers among words and names. words are those of training, names all contexts that are asked for, seen in training or not."""

    def __init__(self, messages: Callable[[], Iterable[dict]] | Iterable[dict]):
        again = messages if callable(messages) else (lambda held=list(messages): held)
        words: list[np.ndarray] = []
        names: list[np.ndarray] = []
        for m in again():
            own, held, counts = unpacked_sorted(m["words"]), unpacked(m["held"]).astype(np.int64), unpacked(m["counts"])
            words.append(own[np.add.reduceat(counts > 0, np.cumsum(held) - held) > 0] if len(own) else own)
            names.append(unpacked_sorted(m["names"]))
            for held_ in (words, names):
                if len(held_) > 1 and sum(map(len, held_)) > TOGETHER:
                    held_[:] = [np.unique(np.concatenate(held_))]
        self.words, self.names = (np.unique(np.concatenate([np.zeros(0, np.uint64), *x])) for x in (words, names))
        self.key, self.customers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for m in again():
            word, at, counts = self.request(m)
            seen = np.flatnonzero(counts)
            new.append((word[seen] << 32 | at[seen], counts[seen]))
            if sum(len(x) for x, _ in new) > TOGETHER:
                self._add(new)
        self._add(new)
        self._split()

    def _split(self) -> None:
        self.word, self.at = (self.key >> 32).astype(np.int32), (self.key & 0xFFFFFFFF).astype(np.int32)
        self.count = np.bincount(self.word, self.customers, minlength=len(self.words)).astype(np.int64)

    def _add(self, new: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, counts = (np.concatenate([x, *(n[i] for n in new)]) for i, x in enumerate((self.key, self.customers)))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.key, self.customers = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
        new.clear()

    def request(self, message: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, -1 for one not seen in training, contexts, counts) of the pairs of one chunk's row for this bucket."""
        words = np.repeat(_find(self.words, unpacked_sorted(message["words"])), unpacked(message["held"]).astype(np.int64))
        names = np.searchsorted(self.names, unpacked_sorted(message["names"]))
        return words, names[unpacked(message["contexts"]).astype(np.int64)], unpacked(message["counts"]).astype(np.int64)

    def packed(self, messages: Iterable[dict]) -> list[bytes]:
        """The dishes and the pairs that each chunk asks for, as the numbers that they have here."""
        blobs, chunks = [], []
        for m in messages:
            word, at, _ = self.request(m)
            pair = np.where(word >= 0, _find(self.key, word << 32 | at), -1)
            seen, distinct = pair >= 0, _find(self.words, unpacked_sorted(m["words"]))
            known = np.where(distinct >= 0, self.count[distinct], 0) if len(self.words) else np.zeros(len(distinct), np.int64)
            chunks.append(m["chunk"])
            blobs += [packed(known, "<u8"), packed(np.array([len(word)])), packed(np.packbits(seen), "<u1"), packed(np.diff(pair[seen], prepend=0)), packed(word[~seen] + 1), packed(at[~seen])]
        core = [packed(np.array([len(self.words)])), packed(np.diff(self.word, prepend=0)), packed(self.at), packed(self.customers, "<u8"), packed_sorted(self.names), packed(np.array(chunks, np.int64), "<u8")]
        return core + blobs

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Bucket:
        out = cls.__new__(cls)
        out.words, out.names = np.arange(int(unpacked(blobs[0])[0])), unpacked_sorted(blobs[4])
        out.key = np.cumsum(unpacked(blobs[1]).astype(np.int64)) << 32 | unpacked(blobs[2]).astype(np.int64)
        out.customers = unpacked(blobs[3], "<u8").astype(np.int64)
        out._split()
        return out

    def asked(self, blobs: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(chunk, its words' training counts as they were packed, words, contexts and pairs, -1 for those not seen)."""
        for k, chunk in enumerate(unpacked(blobs[5], "<u8").astype(np.int64).tolist()):
            known, size, seen, ids, word, at = blobs[6 + 6 * k : 12 + 6 * k]
            n = int(unpacked(size)[0])
            mask = np.unpackbits(unpacked(seen, "<u1"), count=n).astype(bool)
            pair, words, contexts = np.full(n, -1), np.empty(n, np.int64), np.empty(n, np.int64)
            own = np.cumsum(unpacked(ids).astype(np.int64))
            pair[mask], words[mask], contexts[mask] = own, self.word[own], self.at[own]
            words[~mask], contexts[~mask] = unpacked(word).astype(np.int64) - 1, unpacked(at).astype(np.int64)
            yield chunk, known, words, contexts, pair

    def first_totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of each context, with one table for each dish; and sums: customers and tables of the root,
        distinct words, tokens, dishes of one and of two customers below and above."""
        pairs = np.bincount(self.word, minlength=len(self.words))
        few = [(x == k).sum() for x in (self.customers, pairs) for k in (1, 2)]
        sums = np.array([len(self.key), len(self.words), len(self.words), self.customers.sum(), *few], np.int64)
        return self.context_sums(self.customers), self.context_sums(np.ones(len(self.key), np.int64)), sums

    def context_sums(self, of_pairs: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, of_pairs, minlength=len(self.names)).astype(np.int64)

    def samples(self, rng: np.random.Generator, t2: np.ndarray, sums: np.ndarray, model: dict) -> Iterator[dict[str, np.ndarray]]:
        """Run the sweeps, from the tables of all buckets in each context (one for each dish) and the sums of all
        buckets; yields tables of each pair, and customers and tables of each word at the root, of every sample."""
        (d1, d0), (theta1, theta0) = model["d"], model["theta"]
        n_words = len(self.words)
        begun = np.maximum(self.context_sums(np.ones(len(self.key), np.int64)), 1)
        own, share = begun.copy(), t2 / begun
        tables = np.ones(len(self.key), np.int64)
        above = np.bincount(self.word, minlength=n_words).astype(np.int64)
        pairs, root = max(above.sum(), 1), np.minimum(above, 1)
        new_word = lambda: (theta0 + d0 * sums[1] * root.sum() / max(n_words, 1)) / (sums[2] + 1)
        parent = lambda: (above - d0 * root + new_word()) / (theta0 + sums[0] * above.sum() / pairs)
        many = np.flatnonzero(self.customers > 1)  # only dishes of two customers or more can change
        for i in range(model["burn_in"] + model["samples"]):
            p = parent()
            second = rng.random(len(many)) < 0.5
            for half in (many[second], many[~second]):  # one half of the dishes given the other
                word, context = self.word[half], self.at[half]
                fresh = (theta1 + d1 * np.maximum(own[context] * share[context] - tables[half], 0)) * p[word]
                now = draw_tables(rng, self.customers[half], fresh, d1 * p[word], d1)
                np.add.at(own, context, now - tables[half])
                tables[half] = now
            above = np.bincount(self.word, tables, minlength=n_words).astype(np.int64)
            root = draw_tables(rng, above, np.full(n_words, new_word()), np.full(n_words, d0 / (sums[2] + 1)), d0)
            if i >= model["burn_in"]:
                yield {"tables": tables, "root_customers": above, "root_tables": root}


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


# ---- jobs ----------------------------------------------------------------------------------------------------

#: Rows of two kinds: sums of a bucket in a sample, and what it has of a shard of contexts.
TOTALS = "bucket int, sample int, sums array<long>, shard int, names binary, data binary"
_TOTALS = pa.schema([("bucket", pa.int32()), ("sample", pa.int32()), ("sums", pa.list_(pa.int64())), ("shard", pa.int32()), ("names", pa.binary()), ("data", pa.binary())])


#: What a chunk has of its documents, and what of it a bucket keeps.
OWNER = "chunk long, pairs binary, ids array<long>, lengths array<int>, entries array<int>, deltas binary, times binary, held_out array<boolean>"
_OWNER = pa.schema([("chunk", pa.int64()), ("pairs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("entries", pa.list_(pa.int32())), ("deltas", pa.binary()), ("times", pa.binary()), ("held_out", pa.list_(pa.bool_()))])
_BOTH = pa.schema([*_TOTALS, *_OWNER])


def _beside(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of one of the two kinds of rows with the other's columns, null."""
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in _BOTH], schema=_BOTH)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _TOTALS, strict=True)], schema=_TOTALS)


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sums of each sample over all buckets: some numbers for each, added up before they are sent."""
    each = rows.where("sums is not null").select("sample", F.posexplode("sums").alias("pos", "n")).groupBy("sample", "pos").agg(F.sum("n").alias("n"))
    found: dict[int, dict[int, int]] = {}
    for r in each.collect():
        found.setdefault(r["sample"], {})[r["pos"]] = r["n"]
    return {k: np.array([v[i] for i in sorted(v)], np.int64) for k, v in found.items()}


def _shares(number: int, names: np.ndarray, shards: int, numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Numbers of a bucket's contexts (one or more for each context), for each shard those of its contexts."""
    order, edges = _by_shard(names, shards)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[k] : edges[k + 1]]
        yield _row(number, None, None, k, packed_sorted(names[at]), packed(np.concatenate([x[at] for x in numbers])))


def _by_shard(names: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of names by shard, ascending in each, and where each shard's begin."""
    shard = (mix(names) % np.uint64(shards)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))


def _exchanged(rows: DataFrame, name: str) -> str:
    """Sum what the buckets have of each context over all buckets, and write the sums of its contexts for each bucket:
    returns the folder with a file for each bucket."""
    folder = scratch_path(rows.sparkSession, name)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked_sorted(x) for x in part["names"]]
        every, at = np.unique(np.concatenate(own), return_inverse=True)
        edges = np.cumsum([0, *map(len, own)])
        values = [unpacked(x).reshape(-1, len(o)) for x, o in zip(part["data"], own, strict=True)]
        total = np.zeros((len(values[0]), len(every)), np.int64)
        for total_row, value in zip(total, np.concatenate(values, axis=1), strict=True):
            np.add.at(total_row, at, value)
        told = [packed(total[:, at[a:b]].reshape(-1), "<i8") for a, b in zip(edges, edges[1:], strict=False)]
        return part[["bucket", "shard"]].assign(data=told)

    def put(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        number = int(part["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [number], "bytes": [_put_file(folder, number, part["data"].tolist())]})

    told = rows.where("shard is not null").select("bucket", "shard", "names", "data").groupBy("shard").applyInPandas(add, "bucket int, shard int, data binary")
    manifest = cut(told.groupBy("bucket").applyInPandas(put, "bucket int, bytes long"), f"{name}-manifest")
    drop(manifest)
    return folder


def _put_file(folder: str, number: int, blobs: list[bytes]) -> int:
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["data"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return write_file(folder, f"{number}.arrow", [sink.getvalue()])[1]


def _get_file(folder: str, number: int) -> list[bytes]:
    with open_file(f"{folder}/{number}.arrow") as source:
        return pa.ipc.open_stream(source).read_all().column("data").to_pylist()


def _told(folder: str, number: int, names: np.ndarray, shards: int, of: int) -> list[np.ndarray]:
    """The sums over all buckets, `of` numbers for each of the bucket's contexts."""
    order, edges = _by_shard(names, shards)
    out = np.zeros((of, len(names)), np.int64)
    for k, x in zip(np.flatnonzero(np.diff(edges)).tolist(), _get_file(folder, number), strict=True):
        out[:, order[edges[k] : edges[k + 1]]] = unpacked(x, "<i8").reshape(of, -1)
    return list(out)


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


class Predictive:
    """P(word | context), averaged over the samples."""

    def __init__(self, bucket: Bucket, c2: np.ndarray, t2: list[np.ndarray], samples: list[dict], sums: list[np.ndarray], model: dict):
        (d1, d0), (theta1, theta0) = model["d"], model["theta"]
        n = len(samples)
        self.bucket, self.rest = bucket, []
        # the last place of each, which -1 finds, is that of a pair or word not seen
        self.own = np.append(sum(bucket.customers - d1 * held["tables"] for held in samples) / n, 0.0)
        self.each = 1 / (theta1 + c2)
        for tables, held, total in zip(t2, samples, sums, strict=True):
            base = (theta0 + d0 * total[1]) / (total[2] + 1)
            above = np.append(held["root_customers"] - d0 * held["root_tables"], 0.0) + base
            self.rest.append(((theta1 + d1 * tables) / ((theta0 + total[0]) * n), above))

    def of(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        p = self.own[pair]
        for weight, above in self.rest:
            p += weight[context] * above[word]
        return p * self.each[context]

    def named(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        word, context = _find(self.bucket.words, words), np.searchsorted(self.bucket.names, contexts)
        return self.of(word, context, np.where(word >= 0, _find(self.bucket.key, word << 32 | context), -1))


def score(docs: DataFrame, held_out: Column, *, burn_in: int = 4, samples: int = 3, strength: float = 1.0, docs_per_bucket: int = 2048, seed: int = 23) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model and
    the counts are learnt from the rows where held_out does not hold."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(min(max(8, -(-docs.count() // docs_per_bucket)), 1 << 16))
    shards = min(max(8, buckets // 4), 1024)
    # a bucket's rows meet; rows with a chunk's documents pass by them, each by itself
    made = chunks(docs, held_out, buckets)
    by_bucket = made.groupBy(F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket").cast("long")).alias("key"))
    held_rows = scratch_path(spark, "bucket-rows")

    def first_totals(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept = key[0].as_py(), list(batches)  # compressed rows, read twice
        if number < 0:
            for batch in kept:
                yield _beside(batch.select(_OWNER.names))
            return
        bucket = Bucket(lambda: _messages(kept))
        _put_file(held_rows, number, bucket.packed(_messages(kept)))
        c2, t2, sums = bucket.first_totals()
        for row in (_row(number, 0, sums.tolist(), None, None, None), *_shares(number, bucket.names, shards, [c2, t2])):
            yield _beside(row)

    totals = cut(by_bucket.applyInArrow(first_totals, f"{TOTALS}, {OWNER}"), "totals")
    owners = totals.where("chunk is not null").select(*_OWNER.names)
    numbers = cut(totals.where("sample = 0").select("bucket"), "buckets").repartitionByRange(buckets, "bucket")

    def each_bucket(work: Callable[[int], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    yield from work(number)

        return numbers.mapInArrow(run, kinds)

    start, first = _summed(totals).get(0, np.zeros(8, np.int64)), _exchanged(totals, "starts")
    one1, two1, one0, two0 = start[4:].astype(float)
    discounts = [float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5 for a, b in ((one1, two1), (one0, two0))]
    model = {"d": discounts, "theta": [strength] * 2, "burn_in": burn_in, "samples": samples, "seed": seed}
    states = scratch_path(spark, "seats")

    def sampled_totals(number: int) -> Iterator[pa.RecordBatch]:
        bucket = Bucket.unpacked(_get_file(held_rows, number))
        _, t2 = _told(first, number, bucket.names, shards, 2)
        tables, blobs = [], []
        rng = np.random.Generator(np.random.PCG64([model["seed"], number]))
        for s, held in enumerate(bucket.samples(rng, t2, start, model)):
            tables.append(bucket.context_sums(held["tables"]))
            blobs += [packed(held[k]) for k in ("tables", "root_customers", "root_tables")]
            yield _row(number, s, [int(held["root_customers"].sum()), int(held["root_tables"].sum()), len(bucket.words)], None, None, None)
        _put_file(states, number, blobs)
        yield from _shares(number, bucket.names, shards, tables)

    rows = cut(each_bucket(sampled_totals, TOTALS), "totals")
    sampled, then = _summed(rows), _exchanged(rows, "samples")
    drop(rows)
    sums = [sampled.get(s, np.zeros(3, np.int64)) for s in range(samples)]

    def answers(number: int) -> Iterator[pa.RecordBatch]:
        rows = _get_file(held_rows, number)
        bucket = Bucket.unpacked(rows)
        c2, _ = _told(first, number, bucket.names, shards, 2)
        t2 = _told(then, number, bucket.names, shards, samples)
        blobs = [unpacked(x).astype(np.int64) for x in _get_file(states, number)]
        held = [dict(zip(("tables", "root_customers", "root_tables"), blobs[3 * s : 3 * s + 3], strict=True)) for s in range(samples)]
        p = Predictive(bucket, c2, t2, held, sums, model)
        for chunk, known, *pairs in bucket.asked(rows):
            logs = packed(np.log10(p.of(*pairs)).astype("<f4").view("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([number], pa.int32()), pa.array([known], pa.binary()), pa.array([logs], pa.binary())], names=["chunk", "bucket", "known", "logs"])

    answered = cut(each_bucket(answers, "chunk long, bucket int, known binary, logs binary"), "answers")
    for folder in (held_rows, states, first, then):
        delete(spark, folder)
    train_tokens, vocabulary = int(start[3]), int(start[2])

    def finish(of: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("bucket")
        known = np.concatenate([unpacked(x, "<u8") for x in got["known"]]).astype(np.int64)
        logs = np.concatenate([unpacked(x).view("<f4") for x in got["logs"]]).astype(float)
        parts = []
        for row in of.itertuples():
            counts = np.repeat(known, unpacked(row.pairs).astype(np.int64))
            entries, deltas, times = np.asarray(row.entries, np.int64), unpacked(row.deltas).astype(np.int64), unpacked(row.times).astype(np.int64)
            doc = np.repeat(np.arange(len(entries)), entries)
            run = np.cumsum(deltas)
            before = np.append(0, np.cumsum(entries))[:-1]
            pair = run - np.repeat(np.append(0, run)[before], entries)
            n = len(entries)
            base = np.log10((counts + 1) / (train_tokens + vocabulary + 1))
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(list(row.ids), "Int64"), "held_out": list(row.held_out), "n_tokens": np.asarray(row.lengths, np.int64),
                        "n_known": np.bincount(doc, times * (counts[pair] > 0), minlength=n).astype(np.int64), "train_tokens": train_tokens,
                        "base_score": np.bincount(doc, times * base[pair], minlength=n), "score": np.bincount(doc, times * logs[pair], minlength=n),
                    }
                )
            )
        return pd.concat(parts)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return owners.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(finish, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, texts, tokens, and perplexity of the model and of the base over all tokens of scored texts."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
