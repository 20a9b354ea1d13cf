"""A vector index parted by space: lists of vectors around centres, and exact nearest neighbours that read few of them.

Vectors are taken at unit length, so that the cosine distance d and the straight distance e go together (e * e = 2 * d)
and the triangle inequality holds for e: a vector x of a list with centre c is no nearer to a query q than |e(q, c) - e(x, c)|.
Centres come from rounds of Lloyd's method over all vectors: each task adds up its own vectors for each centre, the sums meet by
centre. The index is a table by list, sorted by the distance to the centre (gap), so lists and runs of rows are known by
narrow bounds. A query first meets the lists next to it, until they hold n vectors; the n-th distance found bounds what can
still matter, and a second pass reads other lists, and of these the runs within the bound. Nothing is missed: the result
is that of comparing all vectors.

Queries are written to the shared folder in blocks and pass the vectors of a task, as in operators.index.knn; vectors are
never shuffled by a query, broadcast or collected. Centres are a table of a stated size (lists x dimensions).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.index import top_n
from folioworks.sources.scratch import cut, drop, open_file, scratch_path, small_batches, write_file

#: Lists of an index, rounds of Lloyd's method.
LISTS, ROUNDS = 256, 5
#: Rows of a list that are bounded together, queries in a block.
RUN, QUERY_BLOCK = 1024, 1024
#: Digits that count when distances are ranked; equal vectors are as far away whatever block they are in.
DIGITS = 12
#: What bounds are widened by: the root of what rounding leaves of a cosine distance, and more.
SLACK = 1e-5


class VectorIndex(NamedTuple):
    """vectors (chunk_id and other columns, unit, gap, list), lists (list, n, low, high: its vectors, the least and the
    greatest gap), centres (the file of an array, lists x dimensions)."""

    vectors: DataFrame
    lists: DataFrame
    centres: str


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors (embedding, ...) -> unit, the vector at unit length (zero stays zero), instead; null and empty ones, and those
    with a component that is null or no finite number, go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    some = vectors.where((F.size("embedding") > 0) & finite).withColumn("_norm", F.greatest(norm, F.lit(1e-300)))
    return some.withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))).drop("_norm", "embedding")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances between rows of a and rows of b, at unit length (or zero)."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _save(array: np.ndarray, folder: str, name: str) -> str:
    sink = io.BytesIO()
    np.save(sink, array)
    return write_file(folder, name, [sink.getvalue()])[0]


def _load(uri: str) -> np.ndarray:
    with open_file(uri) as source:
        return np.load(io.BytesIO(source.read()))


def fit_centres(units: DataFrame, lists: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """units (chunk_id, unit) -> centres: at first the vectors whose ids have the smallest hashes, then, round by round, the
    directions of the sums of the vectors next to each. A centre without vectors stays. Only sums come to the driver."""
    start = units.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(lists).select("unit").collect()
    centres = np.unique(np.array([r["unit"] for r in start], np.float64), axis=0)
    if not len(centres):
        return centres
    dims = centres.shape[1]
    for _ in range(rounds):
        uri = _save(centres, scratch_path(units.sparkSession, "centres"), "centres.npy")

        def added(batches: Iterator[pa.RecordBatch], uri: str = uri) -> Iterator[pa.RecordBatch]:
            centres, total, count = _load(uri), None, None
            for batch in batches:
                if total is None:
                    total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
                v = _matrix(batch.column(0), centres.shape[1])
                near = (v @ centres.T).argmax(1)
                order = np.argsort(near, kind="stable")
                own, first = np.unique(near[order], return_index=True)
                if len(own):
                    total[own] += np.add.reduceat(v[order], first, axis=0)
                    count[own] += np.diff(np.append(first, len(near)))
            if total is not None:
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["list", "total"])

        def met(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"list": part["list"].iloc[:1], "total": [np.sum(np.stack(part["total"].to_list()), axis=0)]})

        sums = units.where(F.size("unit") == dims).select("unit").mapInArrow(added, "list long, total array<double>")
        for r in sums.groupBy("list").applyInPandas(met, "list long, total array<double>").toLocalIterator():
            norm = np.linalg.norm(r["total"])
            if norm > 0:
                centres[r["list"]] = np.array(r["total"]) / norm
    return centres


def write_vector_index(vectors: DataFrame, path: str, lists: int = LISTS, rounds: int = ROUNDS) -> VectorIndex:
    """Write the index of vectors (chunk_id, embedding, ...) below path. All vectors have one length; others are left
    out, as are those that are no numbers. A list is spread over as many files as it fills."""
    spark = vectors.sparkSession
    small_batches(spark)
    units = cut(unit_vectors(vectors), "units")
    centres = fit_centres(units, lists, rounds)
    uri = _save(centres, path, "centres.npy")
    dims = centres.shape[1] if len(centres) else 0
    some = units.where(F.size("unit") == dims)
    at = some.schema.names.index("unit")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _load(uri)
        for batch in batches:
            v = _matrix(batch.column(at), dims)
            near = (v @ centres.T).argmax(1)
            gap = np.sqrt(np.maximum(((v - centres[near]) ** 2).sum(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "list", "gap"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
    placed = some.mapInArrow(assign, f"{columns}, list int, gap double")
    placed.repartitionByRange("list", "gap", "chunk_id").sortWithinPartitions("list", "gap").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    drop(units)
    kinds = f"{columns}, gap double, list int"
    counts = spark.read.schema(kinds).parquet(f"{path}/vectors").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return read_vector_index(spark, path, kinds)


def read_vector_index(spark, path: str, columns: str) -> VectorIndex:
    """The index written below path; columns are those it was written with, list the last."""
    return VectorIndex(spark.read.schema(columns).parquet(f"{path}/vectors"), spark.read.schema("list int, n long, low double, high double").parquet(f"{path}/lists"), f"{path}/centres.npy")


def _pass(index: VectorIndex, vectors: DataFrame, blocks: list[str], n: int, kinds: tuple[str, str], compared: bool) -> DataFrame:
    """Runs of the vectors' rows against the queries of the blocks (query_id, v, bound, first, last): those of a list among
    first and last of the nearest ones, within the bound. Rows of query_id, chunk_id, distance, or, without a chunk_id, the
    number of vectors that a run compared with a query."""

    centres_at = index.centres

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _load(centres_at)
        for batch in batches:
            lists, gaps = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            v = _matrix(batch.column(3), centres.shape[1]) if batch.num_rows else np.zeros((0, centres.shape[1]))
            new = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
            edges = [e for a, b in zip(new, np.append(new[1:], len(lists)), strict=True) for e in range(a, b, RUN)] if len(lists) else []
            for uri in blocks:
                with open_file(uri) as source:
                    asked = pa.ipc.open_stream(source).read_all()
                q = _matrix(asked.column("v"), centres.shape[1])
                bound = asked.column("bound").to_numpy()
                own = [set(x) for x in asked.column("lists").to_pylist()]
                skip = asked.column("skip").to_numpy()
                away = _apart(q, centres)
                for a, b in zip(edges, [*edges[1:], len(lists)], strict=True):
                    c = lists[a]
                    listed = np.fromiter((c in x for x in own), bool, len(own)) != skip
                    low, high = gaps[a:b].min(), gaps[a:b].max()
                    least = np.maximum(np.maximum(away[:, c] - high, low - away[:, c]), 0)
                    some = np.flatnonzero(listed & (least <= bound + SLACK))
                    if not len(some):
                        continue
                    near = np.round(1 - q[some] @ v[a:b].T, DIGITS)
                    k = min(n, near.shape[1])
                    edge = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                    rows, cols = np.nonzero((near <= edge) & (near <= (bound[some] ** 2 / 2 + SLACK)[:, None]))
                    ids = asked.column("query_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[rows])), batch.column(0).slice(a, b - a).take(pa.array(cols)), pa.array(near[rows, cols])], names=["query_id", "chunk_id", "distance"])
                    if compared:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.nulls(len(some), batch.column(0).type), pa.array(np.full(len(some), float(b - a)))], names=["query_id", "chunk_id", "distance"])

    return vectors.select("chunk_id", "list", "gap", "unit").mapInArrow(meet, f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")


def _query_blocks(asked: DataFrame, block: int = QUERY_BLOCK) -> list[str]:
    """Write asked (query_id, v, bound, lists, skip) in blocks of rows to the shared folder; their names."""
    spark, folder = asked.sparkSession, scratch_path(asked.sparkSession, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, k = TaskContext.get(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, block))
                uri = write_file(folder, f"{context.partitionId():06d}-{k:06d}-{context.taskAttemptId()}.arrow", [sink.getvalue()])[0]
                k += 1
                yield pa.RecordBatch.from_pydict({"uri": [uri]})

    small_batches(spark)
    return sorted(r["uri"] for r in cut(asked.mapInArrow(write, "uri string"), "queries-manifest").collect())


def indexed_knn(queries: DataFrame, index: VectorIndex, n: int = 20, where: Column | None = None, work: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """queries (query_id, embedding) against an index -> the n nearest by cosine: query_id, rank, chunk_id, distance, as
    operators.index.knn. With work, also (query_id, compared): how many vectors each query was compared with."""
    vectors = index.vectors if where is None else index.vectors.where(where)
    units = unit_vectors(queries.where("query_id IS NOT NULL"))
    kinds = (queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["chunk_id"].dataType.simpleString())
    known = {r["list"]: (r["n"], r["low"], r["high"]) for r in index.lists.collect()}  # a row for each list
    uri = index.centres

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _load(uri)
        size = np.array([known.get(i, (0,))[0] for i in range(len(centres))], np.int64)
        for batch in batches:
            q = _matrix(batch.column(1), centres.shape[1])
            order = np.argsort(_apart(q, centres), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = [o[b < n].astype(np.int32) for o, b in zip(order, before, strict=True)]
            bound = np.full(len(q), 2.0)  # no two unit vectors are further apart
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound), pa.array(first, pa.list_(pa.int32())), pa.array(np.zeros(len(q), bool))], names=["query_id", "v", "bound", "lists", "skip"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _load(uri)
        low, high = (np.array([known.get(i, (0, np.inf, -np.inf))[k] for i in range(len(centres))]) for k in (1, 2))
        for batch in batches:
            away = _apart(_matrix(batch.column(1), centres.shape[1]), centres)
            reach = (np.maximum(away - high, low - away) <= batch.column(2).to_numpy()[:, None] + SLACK).any(axis=0)
            yield pa.RecordBatch.from_pydict({"list": pa.array(np.flatnonzero(reach).astype(np.int32))})

    def of(lists: DataFrame) -> DataFrame:  # a number for each list at most comes to the driver, and prunes the scan
        return vectors.where(F.col("list").isin([r["list"] for r in lists.distinct().collect()]))

    first = index.vectors.select("unit").head()
    schema = f"query_id {kinds[0]}, v array<double>, bound double, lists array<int>, skip boolean"
    asked = cut(units.where(F.size("unit") == len(first["unit"] if first else ())).select("query_id", F.col("unit").alias("v")).mapInArrow(nearest, schema), "asked")
    near = cut(_pass(index, of(asked.select(F.explode("lists").alias("list"))), _query_blocks(asked), n, kinds, work), "near")
    best = top_n(near.where("chunk_id IS NOT NULL"), ["query_id"], n, F.col("distance"), F.col("chunk_id"))
    bounds = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"), F.max("distance").alias("furthest"))
    bound = F.when(F.col("got") >= n, F.sqrt(F.greatest(2 * F.col("furthest"), F.lit(0.0)))).otherwise(2.0)
    rest = cut(asked.join(bounds, "query_id", "left").select("query_id", "v", bound.alias("bound"), "lists", F.lit(True).alias("skip")), "bounded")
    far = _pass(index, of(rest.mapInArrow(within, "list int")), _query_blocks(rest), n, kinds, work)
    every = near.unionByName(far) if not work else cut(near.unionByName(far), "met")
    out = top_n(every.where("chunk_id IS NOT NULL"), ["query_id"], n, F.col("distance"), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "distance")
    if not work:
        return out
    return out, every.where("chunk_id IS NULL").groupBy("query_id").agg(F.sum("distance").cast("long").alias("compared"))
