"""Packing of tokenized documents into windows of one length by best-fit decreasing.

A document is its token ids and an end id. Overlong ones are first cut into full windows and a rest. Pieces are dealt to
shards by a number of each one's own, so a very long document, copies or rows of one id spread; each shard is packed
longest piece first, each into the open window with the least room that still takes it. A segment tree over the possible
rooms, each node the number of open windows below it, finds that room in as many steps as the window's length has bits.
A window is padded to the full length unless its contents are a power of two (column padded).

Defined cases: a null text is the empty text, with the end id alone; rows are packed one for one, repeated and null ids
included; an empty table gives an empty result; ties go by id, then place in the document; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, small_batches, string_buffers
from folioworks.llm.token_files import encoder

PIECE = "row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long"
PLACED = "row long, sequence_id long, offset long, sequence_tokens long"


class Rooms:
    """Open windows by room: a segment tree with the number of windows below each node; windows of one room are a stack."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        self.stacks.setdefault(room, []).append(number)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give (room, number) of the open window with the least room of size or more."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.stacks[room].pop()


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each piece and the windows' contents; sizes descend."""
    rooms, held, out = Rooms(window), [], np.empty(len(sizes), np.int64)
    for i, n in enumerate(map(int, sizes)):
        room, number = rooms.take(n) or (window, len(held))
        if number == len(held):
            held.append(0)
        held[number] += n
        if room > n:
            rooms.add(room - n, number)
        out[i] = number
    return out, np.array(held, np.int64)


def cut_windows(docs: DataFrame, tokenizer: str, *, end_id: int = 1, window: int = 2048, ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> row (a number of the document's own), doc_id, start, length, doc_tokens, ids_crc32 and, if
    asked for, ids (array of int) of its full windows and its rest."""
    small_batches(docs.sparkSession)
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(2))
            raw = raw.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            which, starts, lengths, sizes, crc, data = [], [], [], [], [], []
            for k, encoded in enumerate(enc.encode_batch(texts)):
                own = np.frombuffer(encoded, enc.kind).astype("<u4").tobytes() + end
                for at in range(0, len(own), 4 * window):
                    piece = own[at : at + 4 * window]
                    which.append(k)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sizes.append(len(own) // 4)
                    crc.append(zlib.crc32(piece))
                    if ids:
                        data.append(np.frombuffer(piece, "<u4").astype(np.int32))
            rows = pa.array(which, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int64()) for c in (starts, lengths, sizes, crc))]
            columns += [pa.array(data, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"][: len(columns)])

    return x.mapInArrow(work, PIECE + (", ids array<int>" if ids else ""))


def pack_windows(pieces: DataFrame, *, window: int = 2048, shard_pieces: int = 1 << 16, seed: int = 29) -> DataFrame:
    """pieces of cut_windows -> with sequence_id, offset there, sequence_tokens and padded, the window's length after
    padding. Only numbers and lengths of rests are shuffled to be packed; a full window is a sequence as it is."""
    pieces = cut(pieces, "pieces")
    rests = pieces.where(F.col("length") < window)
    shards = max(1, -(-rests.count() // shard_pieces))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        at, held = best_fit_decreasing(part["length"].to_numpy(), window)
        part = part.assign(sequence_id=2 * (at * shards + part["shard"].iloc[0]), sequence_tokens=held[at])
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part[["row", "sequence_id", "offset", "sequence_tokens"]]

    dealt = rests.select("row", "doc_id", "length", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(shards)).alias("shard"))
    placed = dealt.groupBy("shard").applyInPandas(one, PLACED)
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long"), "sequence_tokens": F.lit(window).cast("long")})
    x = rests.join(placed, "row").unionByName(full)
    n = F.col("sequence_tokens")
    return x.withColumn("padded", F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(window))).drop("row")


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """packed pieces with ids -> sequence_id, sequence_tokens, ids of the whole sequence with its padding."""
    x = packed.groupBy("sequence_id", "sequence_tokens", "padded").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    padding = F.array_repeat(F.lit(pad_id), (F.col("padded") - F.col("sequence_tokens")).cast("int"))
    return x.select("sequence_id", "sequence_tokens", F.concat(F.flatten("own.ids"), padding).alias("ids"))
