"""Hybrid retrieval for whole batches of queries, its telemetry, and ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import strip
from folioworks.operators.index import Index, bm25_query, bm25_query_all, knn
from folioworks.sources.scratch import cut

RRF_K, CANDIDATES = 60, 20


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """ranked (query_id, list, rank from 1, chunk_id) -> query_id, chunk_id, score = sum of 1 / (k + rank), rank. Equal
    scores keep the order in which they are first seen, list by list."""
    x = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("_seen"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "_seen")
    return x.withColumn("rank", F.row_number().over(order)).drop("_seen")


#: So many ids go to the tasks that read texts.
FEW_IDS = 100_000


def attached(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Those rows (chunk_id, text, ...) that ids (chunk_id) name. Where they are few, texts are read past them, so no other
    text moves."""
    ids = cut(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids), "chunk_id", "left_semi") if ids.count() <= FEW_IDS else rows


def hybrid_retrieve(queries: DataFrame, index: Index, vectors: DataFrame, chunks: DataFrame, top_k: int = 5, candidates: int = CANDIDATES, k: int = RRF_K, cluster: str | None = None) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text, embedding) -> (hits, facts).

    Blank queries go. Both lists have max(top_k, candidates) rows, of one cluster or of all; fused ids are cut to top_k
    before rows are attached, so ids without a row leave a gap. A query that ends without rows gets its nearest
    vectors instead (source semantic_fallback). facts has the counts of every query.
    """
    asked = queries.withColumn("text", strip("text")).where("text <> ''")
    n = max(top_k, candidates)
    # both lists are read several times below; n rows a query each, they are written once
    near = cut(knn(asked.select("query_id", "embedding"), vectors, n, None if cluster is None else F.col("cluster") == cluster), "nearest")
    if cluster is None:
        lexical = bm25_query_all(asked.select("query_id", "text"), index, n)
        missing = F.lit(False)
    else:
        lexical = bm25_query(asked.select("query_id", "text", F.lit(cluster).alias("cluster")), index, n)
        missing = F.lit(index.stats.where(F.col("cluster") == cluster).isEmpty())
    lexical = cut(lexical, "lexical")
    lists = lexical.select("query_id", F.lit(1).alias("list"), "rank", "chunk_id").unionByName(near.select("query_id", F.lit(2).alias("list"), "rank", "chunk_id"))
    fused = rrf(lists, k).where(F.col("rank") <= top_k)
    rows = chunks.select("chunk_id", "doc_id", "text", "cluster", F.col("section_id").alias("section_title"), F.col("doc_id").alias("doc_title"))
    spare = near.where(F.col("rank") <= top_k).select("query_id", "chunk_id", (1.0 / (k + F.col("rank"))).alias("score"), "rank", F.lit("semantic_fallback").alias("source"))
    wanted = fused.select("query_id", "chunk_id", "score", "rank", F.lit("hybrid_rrf").alias("source")).unionByName(spare)
    wanted = cut(wanted, "wanted")
    found = wanted.join(attached(wanted.select("chunk_id"), rows), "chunk_id")  # the only scan of texts: fused and spare rows together
    of_query = Window.partitionBy("query_id")
    found = found.withColumn("_fused", F.max(F.col("source") == "hybrid_rrf").over(of_query)).where(F.col("_fused") == (F.col("source") == "hybrid_rrf"))
    hits = found.withColumn("rank", F.row_number().over(of_query.orderBy("rank")))
    hits = hits.select("query_id", "rank", "chunk_id", "doc_id", "text", "score", "cluster", "section_title", "doc_title", "source")
    return hits, retrieval_facts(asked, lexical, near, fused, hits, missing)


def retrieval_facts(asked: DataFrame, lexical: DataFrame, near: DataFrame, fused: DataFrame, hits: DataFrame, missing: Column) -> DataFrame:
    """Per query: hits of each list, their overlap, fused and final hits, fused ids that no vector list had."""
    seen = (
        lexical.select("query_id", "chunk_id", F.lit("l").alias("s"))
        .unionByName(near.select("query_id", "chunk_id", F.lit("n").alias("s")))
        .unionByName(fused.select("query_id", "chunk_id", F.lit("f").alias("s")))
        .groupBy("query_id", "chunk_id")
        .agg(*[F.max(F.col("s") == s).alias(s) for s in "lnf"])
    )
    count = lambda c: F.count_if(c)
    x = seen.groupBy("query_id").agg(
        count("n").alias("semantic_hits"), count("l").alias("bm25_hits"), count(F.col("l") & F.col("n")).alias("bm25_semantic_overlap"), count("f").alias("fused_hits"), count(F.col("f") & ~F.col("n")).alias("bm25_missing_ids")
    )
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_hits"))
    x = asked.select("query_id").join(x, "query_id", "left").join(got, "query_id", "left").na.fill(0)
    return x.withColumn("bm25_fallback", missing)


def build_context(hits: DataFrame) -> DataFrame:
    """One numbered context block for each query, in rank order."""
    part = F.sort_array(F.collect_list(F.struct("rank", "doc_title", "section_title", "text")))
    block = F.transform(part, lambda p: F.concat(F.lit("["), p["rank"].cast("string"), F.lit("] "), p["doc_title"].cast("string"), F.lit(" / "), p["section_title"], F.lit("\n"), p["text"]))
    return hits.groupBy("query_id").agg(F.array_join(block, "\n\n").alias("context"))


# ---- ranking quality -----------------------------------------------------------------------------------------

NUMBERS = r"\d+(?:\.\d+)*"


def eval_cases(questions: DataFrame) -> DataFrame:
    """questions (doc_id, questions array) -> case_id, difficulty, question, expected_doc_id, source_hint: blank
    questions go; without an id a case is named by its document and place."""
    x = questions.select("doc_id", F.posexplode("questions").alias("pos", "q"))
    x = x.where(strip(F.coalesce("q.question", F.lit(""))) != "")
    named = F.coalesce(F.nullif(F.col("q.id"), F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit("_q"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")))
    return x.select(named.alias("case_id"), F.coalesce("q.difficulty", F.lit("unknown")).alias("difficulty"), strip("q.question").alias("question"), F.col("doc_id").alias("expected_doc_id"), F.coalesce("q.source_hint", F.lit("")).alias("source_hint"))


def hint_match(hint: Column, section: Column, text: Column) -> Column:
    """The section's name has the hint or the hint has it, or both name a number, or hint and the text's beginning do."""
    plain = lambda c: strip(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(f"({NUMBERS})"), F.lit(1))
    h, s = plain(hint), plain(section)
    named = (s != "") & (F.contains(h, s) | F.contains(s, h))
    shared = F.arrays_overlap(numbers(h), numbers(s)) | F.arrays_overlap(numbers(h), numbers(plain(F.substring(text, 1, 1200))))
    return (h != "") & (named | shared)


def graded_relevance(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """hits (case_id, rank, doc_id, section_title, text) -> case_id, rank, rel_doc 0/1, rel_hint 0..2."""
    x = hits.join(cases.select("case_id", "expected_doc_id", "source_hint"), "case_id")
    doc = (F.col("doc_id") == F.col("expected_doc_id")).cast("int")
    return x.select("case_id", "rank", doc.alias("rel_doc"), (doc + hint_match(F.col("source_hint"), F.col("section_title"), F.col("text")).cast("int")).alias("rel_hint"))


def case_metrics(relevance: DataFrame, cases: DataFrame, top_k: int) -> DataFrame:
    """Per case: recall, precision over top_k, reciprocal rank, gain by document and by hint. The gain by document is
    divided by that of one relevant hit, so it passes 1 when several hits share the document."""
    gain = lambda c: F.coalesce(F.sum((F.pow(F.lit(2.0), F.col(c)) - 1) / F.log2(F.col("rank") + 1.0)), F.lit(0.0))
    x = relevance.where(F.col("rank") <= top_k).groupBy("case_id").agg(
        F.max("rel_doc").alias("m"), F.sum("rel_doc").alias("s"), F.min(F.when(F.col("rel_doc") > 0, F.col("rank"))).alias("r"), gain("rel_doc").alias("gd"), gain("rel_hint").alias("gh")
    )
    x = cases.join(x, "case_id", "left")
    best = F.when(F.col("source_hint") != "", 3.0).otherwise(1.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "case_id", "difficulty", zero(F.col("m").cast("double")).alias("recall_doc"), zero(F.col("s") / F.lit(float(top_k))).alias("precision_doc"), zero(1.0 / F.col("r")).alias("rr_doc"), zero(F.col("gd")).alias("ndcg_doc"), zero(F.col("gh") / best).alias("ndcg_hint")
    )


METRICS = ("recall_doc", "precision_doc", "rr_doc", "ndcg_doc", "ndcg_hint")


def eval_summary(metrics: DataFrame) -> DataFrame:
    """Means and numbers of queries, for each difficulty and over all (difficulty null, is_total)."""
    x = metrics.rollup("difficulty").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS], (F.grouping("difficulty") == 1).alias("is_total"))
    return x


def tune_k(relevance: DataFrame, cases: DataFrame, grid: Sequence[int] = (3, 5, 8, 10, 15, 20), min_recall: float | None = None, min_precision: float | None = None) -> DataFrame:
    """Every k of the grid: metrics, harmonic mean of recall and precision, feasible, recommended (best score, then
    smaller k, among the feasible or, where there are none, all). The hits must hold the greatest k."""
    ks = F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(grid))]))
    x = relevance.select("*", ks.alias("k")).where("rank <= k").groupBy("k", "case_id").agg(F.max("rel_doc").alias("m"), F.sum("rel_doc").alias("s"))
    n = cases.count()
    rows = x.groupBy("k").agg(F.round(F.sum("m") / n, 4).alias("recall"), F.round(F.sum(F.col("s") / F.col("k")) / n, 4).alias("precision"))
    rows = cases.sparkSession.range(1).select(ks.alias("k")).join(rows, "k", "left").na.fill(0.0)
    both = F.col("recall") + F.col("precision")
    rows = rows.withColumn("score", F.when(both > 0, F.round(2 * F.col("recall") * F.col("precision") / both, 6)).otherwise(0.0))
    fit = F.lit(True)
    if min_recall is not None:
        fit = fit & (F.col("recall") >= min_recall)
    if min_precision is not None:
        fit = fit & (F.col("precision") >= min_precision)
    rows = rows.withColumn("feasible", fit)
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("feasible"), F.desc("score"), "k")
    return rows.withColumn("recommended", F.row_number().over(best) == 1)
