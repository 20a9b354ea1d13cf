"""Lexical and vector index tables, and the state that says what is to be indexed."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.sources.scratch import cut, open_file, scratch_path, small_batches, write_file

# BM25 parameters, dashes, and the token patterns in the order in which they are tried.
K1, B, EPSILON = 1.5, 0.75, 0.25
DASH = r"[‐-―−-]"
ARTICLE = r"ст\.?\s*\d+(?:\.\d+)*"
DOC_REF = rf"(?:№\s*)?\d{{1,5}}\s*{DASH}\s*[а-яёa-z]{{1,6}}"
SLASH = r"[а-яёa-z]{2,10}(?:/[а-яёa-z]{2,10})+"
ALNUM = r"(?:[a-zа-яё]+\d+[a-zа-яё]*|\d+[a-zа-яё]+)"
TOKEN = "|".join((ARTICLE, DOC_REF, SLASH, ALNUM, r"[а-яёa-z]+"))
#: The same for a search engine that goes back by trial: what follows a run of letters is no letter, so runs are kept, and
#: words with and without digits behind are one alternative.
_SEARCH = "|".join((ARTICLE, DOC_REF, SLASH.replace("{2,10}(", "{2,10}+("), r"[а-яёa-z]++(?:\d+[а-яёa-z]*)?", r"\d+[а-яёa-z]+"))


def tokenize(text: Column) -> Column:
    """Tokens of a text: references and abbreviations whole and in parts, other words as they are, lower-cased."""
    raw = F.regexp_extract_all(F.replace(F.lower(text), F.lit(" "), F.lit(" ")), F.lit(f"({_SEARCH})"), F.lit(1))

    def variants(t: Column) -> Column:
        ref = F.regexp_replace(F.regexp_replace(F.trim(F.replace(t, F.lit("№"), F.lit(""))), DASH + "+", "-"), r"\s*-\s*", "-")
        part = F.split(ref, "-")
        whole_and_parts = F.array_compact(F.array(ref, part[0], F.when(F.length(part[1]) > 1, part[1])))
        return (
            F.when(t.rlike(f"^(?:{ARTICLE})$"), F.array(F.concat(F.lit("ст."), F.regexp_replace(t, r"^ст\.?\s*", ""))))
            .when(t.rlike(f"^(?:{DOC_REF})$"), whole_and_parts)
            .when(t.contains("/"), F.concat(F.array(t), F.split(t, "/")))
            .otherwise(F.array(t))
        )

    # all that has parts holds a digit or a slash; other tokens, and texts without either, need no second look
    parts = F.transform(raw, lambda t: F.when(t.rlike("[0-9/]"), variants(t)).otherwise(F.array(t)))
    return F.when(text.rlike(r"[0-9/\p{Nd}]"), F.flatten(parts)).otherwise(raw)


def lemmatized(tokens: DataFrame, lemmas: DataFrame | None, endings: DataFrame | None = None) -> DataFrame:
    """tokens (term, ...) with each term that the dictionary (form, lemma) has replaced by its lemma, and, with endings, each
    other term by what suffix_lemmas makes of it."""
    if lemmas is None:
        return tokens
    known = lemmas.select(F.col("form").alias("term"), "lemma")
    x = tokens.join(known, "term", "left")
    if endings is not None:
        guessed = suffix_lemmas(tokens.select("term").distinct().join(known, "term", "left_anti"), endings)
        x = x.join(guessed.withColumnRenamed("lemma", "_guess"), "term", "left").withColumn("lemma", F.coalesce("lemma", "_guess")).drop("_guess")
    return x.withColumn("term", F.coalesce("lemma", "term")).drop("lemma")


#: Letters of the longest ending, and of the shortest stem that an ending leaves.
LONGEST_ENDING, LEAST_STEM = 5, 2


def learn_endings(lemmas: DataFrame, longest: int = LONGEST_ENDING) -> DataFrame:
    """lemmas (form, lemma) -> ending, cut, added: for each ending of the forms what, most often, is cut off behind and put
    there instead; of two as frequent, what cuts less, then the first by letters. It is a trie of endings laid out as a table: the node of an
    ending is its row, and the longest one that a word has is found by a join with the word's own endings."""
    shorter = F.least(F.length("form"), F.length("lemma"))
    shared = F.array_max(F.transform(F.sequence(F.lit(0), shorter), lambda i: F.when(F.substring("form", F.lit(1), i) == F.substring("lemma", F.lit(1), i), i).otherwise(0)))
    x = lemmas.where("form <> '' AND lemma IS NOT NULL").select("form", (F.length("form") - shared).alias("cut"), F.substring("lemma", shared + 1, F.length("lemma")).alias("added"))
    lengths = F.sequence(F.greatest("cut", F.lit(1)), F.greatest(F.least(F.length("form"), F.lit(longest)), F.greatest("cut", F.lit(1))))
    x = x.select("cut", "added", F.explode(F.transform(lengths, lambda k: F.right("form", k))).alias("ending")).where(F.length("ending") <= longest)
    counted = x.groupBy("ending", "cut", "added").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("ending").agg(F.min(F.struct(-F.col("n"), "cut", "added")).alias("b"))
    return best.select("ending", "b.cut", "b.added")


def suffix_lemmas(terms: DataFrame, endings: DataFrame, longest: int = LONGEST_ENDING) -> DataFrame:
    """terms (term, each once) -> term, lemma: by the rule of the longest ending known; terms without one, and those of which
    it would leave less than LEAST_STEM letters, are left out."""
    x = terms.select("term", F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest)))).alias("k")).withColumn("ending", F.right("term", F.col("k")))
    x = x.join(endings, "ending").groupBy("term").agg(F.max(F.struct("k", "cut", "added")).alias("r"))
    stem = F.length("term") - F.col("r.cut")
    return x.where(stem >= LEAST_STEM).select("term", F.concat(F.substring("term", F.lit(1), stem), "r.added").alias("lemma"))


class Index(NamedTuple):
    """The tables of a lexical index: postings (cluster, term, chunk_id, tf), terms (cluster, term, df, idf), lengths
    (cluster, chunk_id, len), stats (cluster, n, avg_len); chunks (cluster, chunk_id, len, terms, tfs), which is what is stored
    of postings and lengths: a row for each chunk, with its terms, each once, and how often it has them."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    chunks: DataFrame


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, chunk_id, t: tokens) -> (cluster, chunk_id, len, terms, tfs), row by row."""
    for batch in batches:
        tokens = batch.column(2)
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(tokens).dictionary_encode()
        known = max(1, len(words.dictionary))
        keys, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * known + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys // known, minlength=len(sizes)))]).astype(np.int32)
        terms = words.dictionary.take(pa.array(keys % known))
        rows = [batch.column(0), batch.column(1), pa.array(sizes), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(rows, names=["cluster", "chunk_id", "len", "terms", "tfs"])


def _by_chunk(words: DataFrame) -> DataFrame:
    """words (cluster, chunk_id, term, tf; tf without a term is the length) -> rows of a stored index."""
    counts = words.groupBy("cluster", "chunk_id", "term").agg(F.sum("tf").alias("tf"))
    x = counts.groupBy("cluster", "chunk_id").agg(F.sum(F.when(F.col("term").isNull(), F.col("tf"))).alias("len"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", F.col("tf").cast("int").alias("tf")))).alias("l"))
    return x.select("cluster", "chunk_id", "len", F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs"))


def _words(rows: DataFrame) -> DataFrame:
    """The other way round."""
    pairs = F.transform(F.arrays_zip("terms", "tfs"), lambda p: F.struct(p["terms"].alias("term"), p["tfs"].cast("long").alias("tf")))
    return rows.select("cluster", "chunk_id", F.inline(F.concat(pairs, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("len").alias("tf"))))))


def write_index(chunks: DataFrame, path: str, lemmas: DataFrame | None = None) -> None:
    """Write the index of chunks (cluster, chunk_id, text) below path, each table partitioned by cluster; clusters that are
    written again replace their old files only, and the small tables are written anew for all.

    Texts are read and tokenized once, and what a chunk holds is counted in its own row, so postings are written without a
    shuffle; the other tables come from what is written, by counts before the shuffle. Nothing is keyed by a cluster alone
    but counts and sums. Rows of one chunk, where there are such, are put together afterwards; a dictionary of lemmas is
    joined with the tokens first. An idf below 0 becomes a quarter of the cluster's mean idf.
    """
    spark = chunks.sparkSession
    small_batches(spark)
    tokens = chunks.select("cluster", "chunk_id", tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    if lemmas is None:
        kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("cluster", "chunk_id"))
        rows = tokens.mapInArrow(_counted, f"{kinds}, len long, terms array<string>, tfs array<int>")
    else:
        with_length = F.concat(F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("tf"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("t").cast("long").alias("tf"))))
        rows = _by_chunk(lemmatized(tokens.select("cluster", "chunk_id", F.inline(with_length)), lemmas))
    _put(rows, f"{path}/chunks")
    written = spark.read.schema(rows.schema).parquet(f"{path}/chunks")
    if not written.groupBy("cluster", "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        _put(cut(_by_chunk(_words(written)), "chunks"), f"{path}/chunks")
        written = spark.read.schema(rows.schema).parquet(f"{path}/chunks")
    stats = written.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    _put(stats, f"{path}/stats")
    df = written.select("cluster", F.explode("terms").alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(stats, "cluster").select("cluster", "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    raw = cut(raw, "terms")
    mean = raw.groupBy("cluster").agg(F.avg("idf").alias("mean"))
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf"))
    _put(raw.join(mean, "cluster").select("cluster", "term", "df", idf.alias("idf")), f"{path}/terms")


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster").parquet(path)


def read_index(spark: SparkSession, path: str, kinds: str = "cluster string, chunk_id string") -> Index:
    """The index written below path; kinds are the types of cluster and chunk_id."""
    cluster, chunk = kinds.split(", ")
    read = lambda name, *columns: spark.read.schema(", ".join(columns)).parquet(f"{path}/{name}")
    chunks = read("chunks", chunk, "len long", "terms array<string>", "tfs array<int>", cluster).select("cluster", "chunk_id", "len", "terms", "tfs")
    postings = chunks.select("cluster", "chunk_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("cluster", F.col("p.terms").alias("term"), "chunk_id", F.col("p.tfs").cast("long").alias("tf"))
    lengths = chunks.select("cluster", "chunk_id", "len")
    return Index(postings, read("terms", "term string", "df long", "idf double", cluster), lengths, read("stats", "n long", "avg_len double", cluster), chunks)


def bm25_index(chunks: DataFrame, lemmas: DataFrame | None = None, path: str | None = None) -> Index:
    """Write the index of chunks (cluster, chunk_id, text), by default into the shared folder, and give its tables."""
    path = path or scratch_path(chunks.sparkSession, "bm25")
    write_index(chunks, path, lemmas)
    return read_index(chunks.sparkSession, path, ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("cluster", "chunk_id")))


def top_n(scores: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


#: Queries of a block, rows of chunks at a time, and products worked out at a time.
QUERY_BLOCK, CHUNK_BLOCK, PRODUCTS = 256, 4096, 1 << 20


def _best(scores: np.ndarray, edge: np.ndarray, n: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores above 0 that can be among a column's n best, equal ones by id; edge, what n others of the
    column are known to reach, is put up."""
    if len(scores) >= n:
        np.maximum(edge, np.partition(scores, len(scores) - n, axis=0)[len(scores) - n], out=edge)
    rows, cols = np.nonzero((scores >= edge) & (scores > 0))
    many = np.bincount(cols, minlength=scores.shape[1]) > n
    if many.any():
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        own = many[cols]
        r, c = rows[own], cols[own]
        order = np.lexsort((place[r], -scores[r, c], c))
        r, c = r[order], c[order]
        first = np.arange(len(c)) - np.searchsorted(c, c) < n
        rows, cols = np.concatenate([rows[~own], r[first]]), np.concatenate([cols[~own], c[first]])
    return rows, cols


def bm25_query(queries: DataFrame, index: Index, n: int = 20, lemmas: DataFrame | None = None) -> DataFrame:
    """The n best chunks of the query's cluster (of each, where queries name none) with a score above 0: query_id, cluster,
    chunk_id, score, rank. Exact: the weights of the queries' terms are written to the shared folder in blocks of queries of a
    cluster, and each task streams those of its chunks' clusters past its own chunks, some rows at a time. A chunk's scores are
    worked out where it lies; what moves are the n best of a task's rows for each query."""
    spark = queries.sparkSession
    small_batches(spark)
    keys = ["query_id", "cluster"] if "cluster" in queries.columns else ["query_id"]
    asked = lemmatized(queries.select(*keys, F.explode(tokenize(F.col("text"))).alias("term")), lemmas).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf"))
    weights = index.terms.join(index.stats, "cluster").join(cut(asked, "asked"), [*keys[1:], "term"])
    weights = cut(weights.select("query_id", "cluster", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avg_len"), "query-terms")
    blocks = -(-weights.select("query_id").distinct().count() // QUERY_BLOCK)
    folder = scratch_path(spark, "query-terms")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        name = f"{uuid.uuid4().hex}.arrow"
        return pa.table({"cluster": table.column("cluster")[:1], "uri": [write_file(folder, name, [sink.getvalue()])[0]]})

    kind = {c: df.schema[c].dataType.simpleString() for df in (index.chunks, queries) for c in ("query_id", "cluster", "chunk_id") if c in df.columns}
    kind["cluster"] = weights.schema["cluster"].dataType.simpleString()
    dealt = weights.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    manifest = cut(dealt.groupBy("cluster", "block").applyInArrow(write, f"cluster {kind['cluster']}, uri string"), "query-terms-manifest")
    uris: dict[object, list[str]] = {}
    for r in sorted(manifest.collect(), key=lambda r: r["uri"]):
        uris.setdefault(r["cluster"], []).append(r["uri"])

    def read(uri: str) -> tuple[pa.Array, pa.Array, np.ndarray, float]:
        """A block: ids, terms, weights (a row for each term, a column for each query), mean length."""
        with open_file(uri) as source:
            table = pa.ipc.open_stream(source).read_all().combine_chunks()
        ids, terms = (table.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        w = np.zeros((len(terms.dictionary), len(ids.dictionary)))
        w[terms.indices.to_numpy(), ids.indices.to_numpy()] = table.column("w").to_numpy()
        return ids.dictionary, terms.dictionary, w, table.column("avg_len")[0].as_py()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict[str, np.ndarray] = {}
        for table in _tables(batches, CHUNK_BLOCK):
            for cluster in pc.unique(table.column("cluster")):
                if cluster.as_py() not in uris:
                    continue
                own = table.filter(pc.equal(table.column("cluster"), cluster)).combine_chunks()
                chunk_ids, terms, tfs = (own.column(c).combine_chunks() for c in ("chunk_id", "terms", "tfs"))
                words, tf = pc.list_flatten(terms).dictionary_encode(), pc.list_flatten(tfs).to_numpy().astype(float)
                row, length = np.repeat(np.arange(len(own)), pc.list_value_length(terms).to_numpy()), own.column("len").to_numpy()
                for uri in uris[cluster.as_py()]:
                    query_ids, known, w, mean = read(uri)
                    at = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()[words.indices.to_numpy()]
                    some = np.nonzero(at >= 0)[0]
                    at, r, f = at[some], row[some], tf[some]
                    weight = f * (K1 + 1) / (f + K1 * (1 - B + B * length[r] / mean))
                    begin = np.nonzero(np.diff(r, prepend=-1))[0]  # where the postings of the next chunk begin
                    scores, k = np.zeros((len(begin), w.shape[1])), 0
                    while k < len(begin):
                        last = max(k + 1, int(np.searchsorted(begin, begin[k] + PRODUCTS // w.shape[1])))
                        part = slice(begin[k], begin[last] if last < len(begin) else len(at))
                        scores[k:last] = np.add.reduceat(w[at[part]] * weight[part, None], begin[k:last] - begin[k], axis=0)
                        k = last
                    ids = chunk_ids.take(pa.array(r[begin]))
                    scores = np.round(scores, 9)
                    rows, cols = _best(scores, edges.setdefault(uri, np.full(w.shape[1], -np.inf)), n, ids)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(cols)), pa.array([cluster.as_py()] * len(rows), cluster.type), ids.take(pa.array(rows)), pa.array(scores[rows, cols])], names=["query_id", "cluster", "chunk_id", "score"])

    rows = index.chunks.where("chunk_id IS NOT NULL").select("cluster", "chunk_id", "len", "terms", "tfs")
    met = rows.mapInArrow(meet, f"query_id {kind['query_id']}, cluster {kind['cluster']}, chunk_id {kind['chunk_id']}, score double")
    return top_n(met, ["query_id", "cluster"], n, F.desc("score"), F.col("chunk_id"))


def bm25_query_all(queries: DataFrame, index: Index, n: int = 20, lemmas: DataFrame | None = None) -> DataFrame:
    """The n best of each cluster, the best score of each chunk, the n best of these."""
    best = bm25_query(queries, index, n, lemmas).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_n(best, ["query_id"], n, F.desc("score"), F.col("chunk_id"))


def index_summary(chunks: DataFrame, built_at: Column) -> DataFrame:
    """(cluster, doc_id, chunk_count, cluster_chunks, built_at): the documents of each cluster, a row each, with their own
    chunks and the cluster's; counts come before the shuffle, and no cluster's documents meet in one row."""
    x = chunks.groupBy("cluster", "doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return x.join(x.groupBy("cluster").agg(F.sum("chunk_count").alias("cluster_chunks")), "cluster").withColumn("built_at", built_at)


def stale_clusters(chunks: DataFrame, index_meta: DataFrame) -> DataFrame:
    """Clusters without an index, or with a chunk newer than it."""
    x = chunks.groupBy("cluster").agg(F.max("chunked_at").alias("newest")).join(index_meta.select("cluster", "built_at"), "cluster", "left")
    return x.where("built_at IS NULL OR newest > built_at").select("cluster")


# ---- vectors -------------------------------------------------------------------------------------------------


#: Components of the default vectors.
DIMS = 1024


def _word_counts(chunks: DataFrame, dims: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF

    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    return HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(chunks.withColumn("_words", words)).drop("_words")


def fit_tfidf(chunks: DataFrame, dims: int = DIMS):
    """chunks (text) -> the frequencies of hashed words in the corpus (a model of pyspark.ml, which can be saved and loaded),
    one pass and a sum of dims numbers."""
    from pyspark.ml.feature import IDF

    return IDF(inputCol="_counts", outputCol="_weights").fit(_word_counts(chunks, dims))


def tfidf_vectors(chunks: DataFrame, model) -> DataFrame:
    """chunks (text, ...) -> with embedding: counts of hashed words times their ln((chunks + 1) / (chunks with it + 1)), at
    unit length; a text without words, or of words that every chunk has, is zero."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array

    names = [c for c in chunks.columns if c != "embedding"]
    x = model.transform(_word_counts(chunks.select(*names), model.idf.size))
    x = Normalizer(p=2.0, inputCol="_weights", outputCol="_unit").transform(x)
    return x.select(*names, vector_to_array("_unit", "float32").alias("embedding"))


def embed_chunks(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64) -> DataFrame:
    """chunks (chunk_id, text, ...) -> with embedding. The encoder is called with batches of texts; without one, vectors are
    those of tfidf_vectors with the frequencies of these chunks."""
    if encoder is None:
        return tfidf_vectors(chunks, fit_tfidf(chunks))
    names = [c for c in chunks.columns if c != "embedding"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].fillna("").tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in encoder(texts[k : k + batch])]
            yield part.assign(embedding=vectors)

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in names)
    return chunks.select(*names).mapInPandas(run, f"{schema}, embedding array<float>")


def vector_upsert(existing: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """existing with the rows of new put in or replaced by chunk_id; of rows of new with one id, the last by order."""
    last = top_n(new, ["chunk_id"], 1, order.desc()).drop("rank")
    return existing.join(last, "chunk_id", "left_anti").unionByName(last.select(*existing.columns))


def delete_docs(vectors: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors of other documents, number of vectors removed for each document)."""
    gone = vectors.join(doc_ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed"))
    return vectors.join(doc_ids, "doc_id", "left_anti"), gone


def fetch_by_ids(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """ids (pos, chunk_id) -> their rows, at their places; ids without a row are left out."""
    return ids.join(chunks, "chunk_id").orderBy("pos")


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
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


def _units(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """For each length of vector: (length, ids, unit vectors) of a table (id, v)."""
    sizes = pc.list_value_length(table.column("v")).to_numpy()
    for size in np.unique(sizes):
        own = table.filter(pa.array(sizes == size))
        v = pc.list_flatten(own.column("v")).to_numpy().astype(np.float64).reshape(-1, int(size))
        yield int(size), own.column("id").combine_chunks(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def knn(queries: DataFrame, vectors: DataFrame, n: int = 20, where: Column | None = None, block: int = 1 << 14, query_block: int = 1024) -> DataFrame:
    """queries (query_id, embedding) x vectors (chunk_id, embedding) -> the n nearest by cosine: query_id, rank, chunk_id,
    distance. Exact: queries are written to the shared folder in blocks, and each task streams all of them past its
    own vectors, block by block; each block keeps its n best of a query with all ties, and these are ranked. Vectors stay
    where they are. Null or empty vectors and those with a component that is null or no finite number take no part, and
    vectors meet those of their own length only."""
    spark = queries.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda df, key: df.where(F.col(key).isNotNull() & (F.size("embedding") > 0) & finite).select(F.col(key).alias("id"), F.col("embedding").alias("v"))
    asked, some = whole(queries, "query_id"), whole(vectors if where is None else vectors.where(where), "chunk_id")
    folder = scratch_path(spark, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        for k, table in enumerate(_tables(batches, query_block)):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"uri": [write_file(folder, f"{context.partitionId():06d}-{k:06d}-{context.taskAttemptId()}.arrow", [sink.getvalue()])[0]]})

    uris = sorted(r["uri"] for r in cut(asked.mapInArrow(write, "uri string"), "queries-manifest").collect())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches, block):
            sides = {size: (ids, v) for size, ids, v in _units(table)}
            for uri in uris:
                with open_file(uri) as source:
                    asked = pa.ipc.open_stream(source).read_all()
                for size, query_ids, m in _units(asked):
                    if size not in sides:
                        continue
                    ids, v = sides[size]
                    near = 1 - m @ v.T
                    k = min(n, near.shape[1])
                    edge = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                    rows, cols = np.nonzero(near <= edge)  # all ties at the edge: the ranking settles them by id
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(near[rows, cols])], names=["query_id", "chunk_id", "distance"])

    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, some)]
    met = some.mapInArrow(meet, f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")
    return top_n(met, ["query_id"], n, F.col("distance"), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "distance")


# ---- state ---------------------------------------------------------------------------------------------------


def pending_documents(selected: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    return selected if force else selected.join(state.select("doc_id"), "doc_id", "left_anti")


def index_status(selected: DataFrame, chunks: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """doc_id -> skipped (already indexed), failed (no chunks, or none to index), or ok."""
    counts = chunks.groupBy("doc_id").agg(F.count_if("is_indexed").alias("n"))
    x = selected.select("doc_id").join(counts, "doc_id", "left").join(state.select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    skipped = F.col("done").isNotNull() & F.lit(not force)
    return x.select("doc_id", F.when(skipped, "skipped").when(F.coalesce("n", F.lit(0)) == 0, "failed").otherwise("ok").alias("status"))


def mark_dirty(dirty: DataFrame, indexed: DataFrame) -> DataFrame:
    return dirty.select("cluster").union(indexed.select("cluster").where("cluster <> ''")).distinct()


def clusters_to_rebuild(mode: str, state: DataFrame, dirty: DataFrame | None = None, cluster: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """The given cluster; or the dirty ones; or those of given indexed documents; or all indexed ones."""
    if mode == "cluster":
        return state.sparkSession.range(1).select(F.lit(cluster).alias("cluster"))
    if mode == "dirty":
        return dirty.select("cluster").distinct()
    x = state if mode == "all" else state.join(docs, "doc_id", "left_semi")
    return x.select("cluster").where("cluster <> ''").distinct()


def rebuild_dirty(chunks: DataFrame, dirty: DataFrame, path: str | None = None) -> tuple[Index, DataFrame]:
    """Write the index of the dirty clusters, replacing theirs below path and leaving other clusters' as they are ->
    (the tables below path, clusters that stay dirty because they have no chunks)."""
    some = chunks.join(dirty, "cluster", "left_semi")
    return bm25_index(some, path=path), dirty.join(some.select("cluster").distinct(), "cluster", "left_anti")
