"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted, each with a cost. Documents longer than the greatest are first cut into
pieces of that length and a rest. Pieces are dealt to shards by a hash of a number that each is given as it is written
(so a very long document, a group of copies or of rows with one id spreads), and each shard is packed by itself, longest
piece first:

- best fit: the piece goes to the open bin, of whatever length, that it leaves least room in;
- if none has room, the length opened is the one with the least cost for each token it is expected to hold, out of
  those that hold the piece: the piece itself and whatever is still to come, up to the bin's length;
- in the end each bin is downsized to the least permitted length that holds its contents.

The size is the number of words, or any column of the caller's, such as the number of ids in token files.

Defined cases: null or blank text has no tokens and lies in no bin (bin and the columns after it are null); repeated
rows are packed each by itself, and so are those of a null id; an empty table gives an empty result; ties go by id, then place in the document.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, word_count

#: Permitted lengths and costs: a fixed part for each sequence, a linear part, and attention growing with the square.
LENGTHS = {n: 32 + n + n * n / 32768 for n in (512, 1024, 2048, 4096, 8192)}

_PLACES = ("doc_id", "piece", "start", "n_tokens", "shard", "bin", "bin_start", "bin_tokens", "bin_length")
RESULT = "doc_id long, piece long, start long, n_tokens long, shard long, bin long, bin_start long, bin_tokens long, bin_length long"


def best_fit(sizes: np.ndarray, lengths: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack sizes (in the order given, which should descend): bin of each, its start there, bins' contents, lengths."""
    caps = sorted(lengths)
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some open bin has exactly r tokens of room
    used: list[int] = []
    room: list[int] = []
    bins, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left = int(sizes.sum())
    for i, n in enumerate(map(int, sizes)):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            stack = open_bins[r]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << r)
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: (lengths[c] / min(c, left), c))
            b, r = len(used), cap
            used.append(0)
            room.append(cap)
        bins[i], starts[i] = b, used[b]
        used[b] += n
        left -= n
        if r > n:
            open_bins.setdefault(r - n, []).append(b)
            rooms |= 1 << (r - n)
    held = np.array(used, np.int64)
    return bins, starts, held, np.array(caps, np.int64)[np.searchsorted(caps, held)] if len(held) else held


def pack(
    docs: DataFrame,
    *,
    size: Column | None = None,
    carry: Mapping[str, Column] | None = None,
    lengths: Mapping[int, float] = LENGTHS,
    shard_pieces: int = 4096,
    seed: int = 29,
) -> DataFrame:
    """docs (doc_id, text or size) -> one row for each piece: its range in the document and its place in a bin, and the
    columns to carry (whole numbers), which tell rows of one id apart."""
    carry = dict(carry or {})
    carried = list(carry)  # the function that is sent to the tasks must not hold columns
    longest = max(lengths)
    n = word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / longest)).cast("long")
    pieces = (
        docs.select("doc_id", n.cast("long").alias("n"), *[c.cast("long").alias(k) for k, c in carry.items()])
        .select("doc_id", "n", *carry, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
        .select(*carry, F.monotonically_increasing_id().alias("_number"), "doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    )
    pieces = cut(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "_number"), F.lit(shards)))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece", "_number"], ascending=[False, True, True, True], kind="stable")
        bins, starts, held, size_of = best_fit(part["n_tokens"].to_numpy(), lengths)
        return part.assign(bin=bins, bin_start=starts, bin_tokens=held[bins], bin_length=size_of[bins])[
            [*_PLACES, *carried]
        ].astype({"doc_id": "Int64"} | dict.fromkeys(carried, "Int64"))

    packed = dealt.groupBy("shard").applyInPandas(one, ", ".join([RESULT, *(f"{c} long" for c in carry)]))
    blank = pieces.where("n_tokens <= 0").select(
        "doc_id", "piece", "start", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "bin_start", "bin_tokens", "bin_length")], *carry
    )
    return packed.unionByName(blank)
