"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

Components become integers, floor(scale * x). The queries are written to the shared folder in blocks; each task takes
its candidates block by block and streams all query blocks past each (a query set against all rows, in blocks), so
candidates are never copied or shuffled. A candidate block is turned into postings (for each component, the rows where
it is not 0 and their values), and each query row, sparse likewise, scatters weight x posting into a dense array of
scores, component by component. A partition by score selects the best k of the block with all ties at the edge; the
blocks' lists are merged by rank.

A candidate block has block_rows rows and a query block query_rows, whatever the tables' sizes; nothing is broadcast
but the names of the query files, and no vector passes through the driver.

Defined cases: vectors that are null or empty or hold a null or non-finite component take no part, nor do null ids;
vectors meet those of their own length only; of a repeated id each row is a query (with a list of its own) and a
candidate of its own, none of them of its own id; fewer than k candidates give fewer rows; an empty table gives an
empty result; further columns are ignored. Ties go to the smaller id. Scores are 64-bit.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, open_file, scratch_path, small_batches, write_file


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, v (array of longs), whole and finite vectors only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def select(scores: np.ndarray, ids: np.ndarray, k: int, leave: np.ndarray) -> np.ndarray:
    """Places of the k highest scores but those to leave out, ties to the smaller id, best first."""
    more = k + int(np.count_nonzero(leave))
    if len(scores) > more:
        edge = np.partition(scores, len(scores) - more)[len(scores) - more]
        at = np.flatnonzero((scores >= edge) & ~leave)
    else:
        at = np.flatnonzero(~leave)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of all candidates (rows) for each query row, term at a time, in 32 bits where no sum can pass them."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * candidates.shape[1]
    kind = np.int32 if most < 1 << 31 else np.int64
    postings = []
    for term in candidates.T:
        rows = np.flatnonzero(term)
        postings.append((slice(None) if len(rows) == len(term) else rows, term[rows].astype(kind)))
    for query in queries.astype(kind):
        scores = np.zeros(len(candidates), kind)
        for term in np.flatnonzero(query):
            rows, values = postings[term]
            scores[rows] += query[term] * values
        yield scores


def _rows_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _by_length(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each length of vector, and their vectors as one array."""
    sizes = pc.list_value_length(table.column("v")).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    for size in np.unique(sizes):
        own = table.filter(pa.array(sizes == size))
        yield own, pc.list_flatten(own.column("v")).to_numpy(zero_copy_only=False).reshape(-1, int(size))


def query_files(queries: DataFrame, rows: int) -> DataFrame:
    """Write queries (query, vec_id, v) to files of about so many rows in the shared folder -> their manifest, written."""
    folder = scratch_path(queries.sparkSession, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        for k, table in enumerate(_rows_of(batches, rows)):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            uri, _ = write_file(folder, f"{context.partitionId():06d}-{k:06d}-{context.taskAttemptId()}.arrow", [sink.getvalue()])
            yield pa.RecordBatch.from_pydict({"uri": [uri], "rows": [table.num_rows]})

    return cut(queries.mapInArrow(write, "uri string, rows long"), "queries-manifest")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block_rows: int = 1 << 15, query_rows: int = 1 << 12) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row where is_query holds, its k best among all other ids."""
    small_batches(vectors.sparkSession)
    x = quantised(vectors, scale)
    # a query row's name is drawn once, as the table of queries is written
    manifest = query_files(x.where(is_query).select(F.monotonically_increasing_id().alias("query"), "vec_id", "v"), query_rows)
    uris = [r["uri"] for r in manifest.orderBy("uri").collect()]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows_of(batches, block_rows):
            sides = {v.shape[1]: (own.column("vec_id").to_numpy(), v) for own, v in _by_length(block)}
            for uri in uris:
                with open_file(uri) as source:
                    queries = pa.ipc.open_stream(source).read_all()
                for own, q in _by_length(queries):
                    if q.shape[1] not in sides:
                        continue
                    ids, v = sides[q.shape[1]]
                    found: list[tuple] = []
                    for query, query_id, scores in zip(own.column("query").to_numpy(), own.column("vec_id").to_numpy(), accumulate(q, v), strict=True):
                        best = select(scores, ids, k, ids == query_id)
                        found.append((np.full(len(best), query), np.full(len(best), query_id), ids[best], scores[best].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query", "query_id", "vec_id", "score"])

    best = x.select("vec_id", "v").mapInArrow(meet, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
