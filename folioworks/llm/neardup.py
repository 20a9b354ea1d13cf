"""Similarity join of documents on word shingles by prefixes under several global token orders.

A document's set is its distinct shingles of k words (A-Z lower-cased). Two documents link when
100 * intersection >= percent * union. If so, then under any one order of all shingles each has a shingle of the other
among its first n - ceil(percent n / 100) + 1 ones (its prefix), so candidates must share prefix shingles under every
one of three orders, and only what passes all three filters is verified on the whole sets.

The orders put shingles with rare words first (by the document frequency of the rarest word, counted over all
documents in a table of fixed size, TABLE_BITS) and differ in how they order the many ties. A shingle with a word that
no other document has can't be shared at all: it fills the prefix but needs no posting. Passages that very many
documents share come last in every order.

Work stays linear in the groups of copies:
1. equal sets collapse to one document, the smallest id (a pre-aggregated minimum);
2. round one links documents to one of their posting list and size class, a star for each list: to the one whose
   shingles are shared most, as the text that near copies go back to; candidates are filtered, verified, and joined
   to components;
3. round two takes the pairs of a posting list that round one left in different components: all of them where the
   list is short; where it is long, those with a side outside the list's largest component. No list is cut.
Both rounds also drop pairs whose parity maps (64 * PARITY bits for each set) differ in more bits than the sets may
differ in shingles; this bound, too, loses no link.
Every link of the whole similarity graph is either verified or inside a component already, so components are exact.

Sets for verification are read from the texts again, for documents in candidate pairs only; bit tables of fixed size
(PICK_BITS) pick these, the tokens that more than one document has, and the one document of equal sets, before any
shuffle. What such a table lets through beside is dropped by the exact joins after it. Shingles and words are 64-bit
hashes.

Defined cases: null, blank and empty texts have the empty set and link with nothing; a text with fewer than k words is
one shingle; equal sets link (if not empty); rows that repeat an id are one document that links as any of its texts
does; a null id takes no part and has a null component; an empty table gives an empty result; further columns are
ignored by join and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.components import components
from folioworks.llm.shared import cut, delete, drop, free_name, hashed_texts, mix, open_file, scratch_path, small_batches, write_file

TABLE_BITS = 24
PICK_BITS = 26
#: Multipliers that turn a shingle's hash into its place among ties, one for each order.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LONG_LIST = 64


#: Tables that a Python worker has read and may need again, the last ones used.
_HELD: dict[str, np.ndarray] = {}
_MOST_HELD = 3


class _Table:
    """A table of bytes of a fixed size in files of the shared folder, one for each slice that has any. Tasks read it there;
    the driver only holds the files' names."""

    def __init__(self, folder: str, size: int, files: list[tuple[int, str]]):
        self.folder, self.size, self.files = folder, size, files

    @property
    def value(self) -> np.ndarray:
        table = _HELD.pop(self.folder, None)
        if table is None:
            while len(_HELD) >= _MOST_HELD:
                del _HELD[next(iter(_HELD))]
            table = np.zeros(SLICES * self.size, np.uint8)
            for s, uri in self.files:
                with open_file(uri) as stream:
                    table[s * self.size : (s + 1) * self.size] = np.frombuffer(stream.read(), np.uint8)
        _HELD[self.folder] = table
        return table


#: Slices of a table.
SLICES = 64


def _by_slice(rows: DataFrame, bits: int, fold, as_bits: bool = False) -> _Table:
    """rows (bucket below 2^bits, n), one for each bucket at most -> fold(n) of every bucket as bytes, 0 where there
    is none, or as single bits."""
    folder = scratch_path(rows.sparkSession, "table")
    width = (1 << bits) // SLICES

    def one(part: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(width, np.uint8)
        dense[part["bucket"].to_numpy() % width] = fold(part["n"].to_numpy())
        s = int(part["bucket"].iloc[0]) // width
        uri, _ = write_file(folder, f"{s:02d}", [(np.packbits(dense) if as_bits else dense).tobytes()])
        return pd.DataFrame({"slice": [s], "uri": [uri]})

    files = rows.groupBy(F.floor(F.col("bucket") / width)).applyInPandas(one, "slice long, uri string").collect()
    return _Table(folder, width // 8 if as_bits else width, [(r["slice"], r["uri"]) for r in files])


def word_levels(docs: DataFrame) -> _Table:
    """For each bucket of words, the bit length of its document frequency over all documents (255 at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << TABLE_BITS, np.uint16), 0

        def told() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(seen)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(part.astype(np.int32)), "n": pa.array(seen[part].astype(np.int64))})
            seen[:] = 0

        for batch in batches:
            if rows + batch.num_rows > 0xFFFF:  # no count can have run over
                yield from told()
                rows = 0
            rows += batch.num_rows
            for _, _, words, before in hashed_texts(batch.column(0)):
                bucket = (words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
                own = np.unique((doc << TABLE_BITS) | bucket) & ((1 << TABLE_BITS) - 1)
                np.add.at(seen, own, 1)
        yield from told()

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return _by_slice(rows, TABLE_BITS, lambda n: np.minimum(np.floor(np.log2(n)) + 1, 255).astype(np.uint8))


def shingle_sets(words: np.ndarray, before: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a slice: its distinct shingles, sorted, and for each the place of its first word."""
    n = len(words) - k + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for i in range(k):
            grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        elif b - a < k:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[i : i + 1])
            yield h ^ np.uint64(b - a), np.array([a])
        else:
            own = grams[a : b - k + 1]
            order = np.argsort(own)
            own = own[order]
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            yield own[first], order[first] + a


#: 64-bit words of a set's parity map: each shingle flips one bit, so two maps differ in no more bits than the sets in
#: shingles, and pairs whose maps differ too much cannot link.
PARITY = 8
PREFIXES = "doc_id long, n long, sig1 long, sig2 long, a array<long>, b array<int>, c array<int>, " + ", ".join(f"p{i} long" for i in range(PARITY))


def parity(own: np.ndarray) -> np.ndarray:
    at = (own >> np.uint64(20)) % np.uint64(64 * PARITY)
    bits = (np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def prefixes(docs: DataFrame, levels: _Table, k: int, percent: int) -> DataFrame:
    """doc_id, size and two hashes of the set, and the postings of its prefix under each order (first: 64-bit tokens in
    that order; others: 32 bits of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in batches:
            out = {name: [] for name in ("n", "sig1", "sig2")}
            maps: list[np.ndarray] = []
            tokens: list[list[np.ndarray]] = [[], [], []]
            for _, _, words, before in hashed_texts(batch.column(1)):
                level = table[(words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                rarest = level.copy()
                for i in range(1, k):
                    held = max(0, len(rarest) - i)
                    rarest[:held] = np.minimum(rarest[:held], level[i:])
                for (own, at), end in zip(shingle_sets(words, before, k), before[1:].tolist(), strict=True):
                    n = len(own)
                    out["n"].append(n)
                    maps.append(parity(own))
                    out["sig1"].append(int(np.bitwise_xor.reduce(mix(own)).astype(np.int64)) if n else 0)
                    out["sig2"].append(int(mix(own + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) if n else 0)
                    size = n - (percent * n + 99) // 100 + 1 if n else 0
                    rare = rarest[at] if n and at[0] + k <= end or n > 1 else (level[at[0] : end].min(keepdims=True) if n else rarest[:0])
                    for i, factor in enumerate(ORDERS):
                        if not size:
                            tokens[i].append(own.astype(np.int64))
                            continue
                        key = (rare.astype(np.uint64) << np.uint64(56)) | ((own * np.uint64(factor)) >> np.uint64(8))
                        head = np.argpartition(key, size - 1)[:size] if size < n else np.arange(n)
                        head = head[rare[head] > 1]  # a word of one document alone: nobody shares the shingle
                        if i == 0:
                            head = head[np.argsort(key[head])]
                        tokens[i].append(own[head].astype(np.int64))
            arrays = [batch.column(0), *(pa.array(np.array(out[c], np.int64)) for c in out)]
            for i, lists in enumerate(tokens):
                offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat if i == 0 else flat.astype(np.int32))))
            table_of_maps = np.array(maps, np.int64).reshape(-1, PARITY)
            arrays += [pa.array(np.ascontiguousarray(table_of_maps[:, i])) for i in range(PARITY)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "sig1", "sig2", "a", "b", "c", *(f"p{i}" for i in range(PARITY))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREFIXES)


def _may_link(percent: int, right: str) -> Column:
    """A pair of rows (n, p0.., and the same names with the suffix right) whose sizes and parity maps allow a link."""
    sizes = f"100 * least(n, n{right}) >= {percent} * greatest(n, n{right})"
    differing = " + ".join(f"bit_count(p{i} ^ p{i}{right})" for i in range(PARITY))
    most = f"(n + n{right}) - 2 * ceil({percent} * (n + n{right}) / {100 + percent}.0D - 1e-9)"
    return F.expr(f"{sizes} AND {differing} <= {most}")


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << PICK_BITS)).cast("int")


def _marks(keys: DataFrame) -> _Table:
    """A bit table of fixed size with the buckets of some keys (one column), for all tasks."""
    rows = keys.select(_bucket(keys.columns[0]).alias("bucket")).distinct().withColumn("n", F.lit(1))
    return _by_slice(rows, PICK_BITS, lambda n: n.astype(np.uint8), as_bits=True)


def _marked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _only(rows: DataFrame, key: str, marks: _Table, marked: bool = True, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """The rows whose key's bucket is marked: all of those with a key that was marked, and few others (or, with marked
    False, all other rows). It is for joins with few keys, whose wide side then is not shuffled whole. What the function
    then makes of their batches, by its schema, it makes in the same worker: two functions in turn would keep two workers
    for each task, which live on with all that they have loaded."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.select(range(len(names))).filter(pa.array(_marked(marks.value, at) == marked))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(batch for batch in run(batches) if batch.num_rows)

    return rows.withColumn(free_name(names, "_bucket"), _bucket(F.col(key).cast("long"))).mapInArrow(made if then else run, schema or rows.schema)


def _postings(heads: DataFrame, docs: _Table, tokens: _Table) -> DataFrame:
    """doc_id, n, pos, token of the prefixes (first order) of marked documents: their marked tokens, in the order of the
    prefix. (Spark's hash of a token is worked out here, where the prefixes are taken apart.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(_marked(docs.value, batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64))))
            lists = own.column(2)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            token = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.flatnonzero(_marked(tokens.value, pc.list_flatten(own.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)))
            ids, n = (own.column(i).to_numpy(zero_copy_only=False)[row[keep]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(pos[keep].astype(np.int32)), pa.array(token[keep])], names=["doc_id", "n", "pos", "token"])

    buckets = F.transform("a", lambda t: F.pmod(F.xxhash64(t), F.lit(1 << PICK_BITS)).cast("int"))
    return heads.where("doc_id is not null").select("doc_id", "n", "a", buckets.alias("_buckets"), _bucket("doc_id").alias("_bucket")).mapInArrow(run, "doc_id long, n long, pos int, token long")


def _packed(own: np.ndarray) -> bytes:
    """A sorted set as differences, in planes of bytes, of which the upper ones compress."""
    planes = np.diff(own, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def verified(pairs: DataFrame, docs: DataFrame, marks: _Table, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the pairs (x, y) whose whole sets are similar enough, the written table of sets that they are found by)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0).to_pylist(), [], 0
            i = 0
            for _, _, words, before in hashed_texts(batch.column(1)):
                for own, _ in shingle_sets(words, before, k):
                    held.append((ids[i], _packed(own)))
                    i, size = i + 1, size + own.nbytes
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["id", "s"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["id", "s"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = cut(_only(texts, "doc_id", marks, then=sets, schema="id long, s binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                u, v = _unpacked(a.as_py()), _unpacked(b.as_py())
                if not len(u) or not len(v) or 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # sets are as many as there are groups of copies, so these joins have one plan at every size
    left, right = (whole.select(F.col("id").alias(side), F.col("s").alias("s" + side)).hint("merge") for side in "xy")
    near = pairs.join(left, "x").join(right, "y")
    return near.select("x", "y", "sx", "sy").mapInArrow(check, "x long, y long").distinct(), whole


def _checked(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among pairs (x, y), written: those that share prefix tokens under the second and the third order too go on
    to verification. Prefixes and texts are taken of documents in pairs only."""
    pairs = cut(pairs, "pairs")
    marks = _marks(pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))))
    some = cut(_only(heads.where("n > 0 and doc_id is not null").select("doc_id", "b", "c"), "doc_id", marks), "pair-prefixes")
    left, right = (some.select(F.col("doc_id").alias(side), *[F.col(c).alias(c + side) for c in "bc"]) for side in "xy")
    both = pairs.join(left, "x").join(right, "y").where(F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy"))
    candidates = cut(both.select("x", "y").distinct(), "candidates")
    found, whole = verified(candidates, docs, marks, k, percent)
    links = cut(found, "links")
    drop(pairs, some, candidates, whole)
    delete(docs.sparkSession, marks.folder)
    return links


def similar_components(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, one row for each row."""
    small_batches(docs.sparkSession)
    levels = word_levels(docs)
    heads = cut(prefixes(docs, levels, k, percent), "prefixes")
    solid = heads.where("n > 0 and doc_id is not null")
    classes = cut(solid.groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep")), "classes")
    members = solid.select("doc_id", "n", "sig1", "sig2").join(classes, ["n", "sig1", "sig2"]).select("doc_id", "rep")
    reps = _marks(classes.select("rep"))  # a few others that come along do no harm: their links are links

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) if percent < 100 else F.col("n")).alias("band")
    tokens = _only(solid.select("doc_id", "a"), "doc_id", reps).select(F.explode("a").alias("token"))
    lists = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    shared_tokens = _marks(lists.select("token"))
    posting = _postings(solid, reps, shared_tokens).join(lists, "token").withColumn("band", band)
    # how far a document's shingles are shared: highest for the text that a group of near copies goes back to
    posting = cut(posting, "listed")
    shared = F.sum(F.log2(F.col("m").cast("double"))) / F.col("n")
    central = posting.groupBy("doc_id", "n").agg(F.round(shared, 6).alias("central"))

    first = F.struct("central", F.negative("doc_id"), F.negative("n"))
    ranked = posting.select("doc_id", "n", "token", "band").join(central, ["doc_id", "n"])
    stars = cut(ranked.groupBy("token", "band").agg(F.max_by("doc_id", first).alias("lead")), "stars")
    one = posting.join(stars, ["token", "band"]).where("doc_id <> lead")
    one = one.select(F.col("lead").alias("x"), F.col("doc_id").alias("y")).distinct()
    maps = solid.select("doc_id", "n", *[f"p{i}" for i in range(PARITY)])
    near = maps.select(F.col("doc_id").alias("x"), *[F.col(c).alias(f"{c}_y") for c in maps.columns[1:]])
    one = one.join(near, "x").join(maps.withColumnRenamed("doc_id", "y"), "y").where(_may_link(percent, "_y")).select("x", "y").distinct()
    links = _checked(one, heads, docs, k, percent)

    found = cut(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components1")
    tagged = posting.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component", "band")
    sides = tagged.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("held"))
    open_lists = sides.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("held", "comp")).alias("most")).where("comps > 1")
    tagged = cut(tagged.join(open_lists.select("token", "most"), "token").join(maps, ["doc_id", "n"]), "open")
    other = tagged.select("token", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "pos", "comp", "most", *(f"p{i}" for i in range(PARITY)))])
    fit = F.expr(f"1 + least(n - 1 - pos, n_y - 1 - pos_y) >= ceil({percent} * (n + n_y) / {100 + percent}.0D - 1e-9)")
    short = F.col("m") <= LONG_LIST
    two = tagged.where(short | (F.col("comp") != F.col("most"))).join(other, "token").where("comp <> comp_y")
    two = two.where(F.when(short, F.col("doc_id") < F.col("doc_id_y")).otherwise((F.col("comp_y") == F.col("most_y")) | (F.col("doc_id") < F.col("doc_id_y"))))
    two = two.where(_may_link(percent, "_y")).where(fit)
    two = two.select(F.least("doc_id", "doc_id_y").alias("x"), F.greatest("doc_id", "doc_id_y").alias("y")).distinct()
    more = _checked(two, heads, docs, k, percent)
    same_id = members.where("doc_id <> rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    repeats = heads.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    same_id = same_id.join(repeats, F.col("x") == F.col("doc_id"), "left_semi")  # an id whose texts are of several classes
    every = links.unionByName(more).unionByName(same_id)
    final = components(every.select(F.col("x").alias("a"), F.col("y").alias("b")))

    owner = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    owner = owner.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id"), F.coalesce("component", "rep").alias("_c"))
    result = heads.select("doc_id", "n").join(owner, "doc_id", "left")
    result = cut(result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id")), "similar")
    drop(heads, classes, lists, posting, stars, links, found, tagged, more)
    for table in (levels, reps, shared_tokens):
        delete(docs.sparkSession, table.folder)
    return result


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are near a document of a smaller id: one of each component stays, whole. Of rows
    that repeat an id, which are one document, one stays (the first by hash, then by text); rows without an id all do."""
    found = similar_components(docs, k=k, percent=percent)
    ids = found.groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("doc_id is not null")
    gone = cut(ids.where("doc_id <> component_id or rows > 1").select("doc_id", F.expr("doc_id = component_id").alias("first")), "gone")
    # texts are shuffled only where their id may have to go or to be one of several rows
    marks = _marks(gone.select("doc_id"))
    some = cut(_only(docs, "doc_id", marks), "some")
    kept = some.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    one = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row")
    once = some.join(gone.where("first").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*")
    return _only(docs, "doc_id", marks, False).unionByName(kept).unionByName(once)
