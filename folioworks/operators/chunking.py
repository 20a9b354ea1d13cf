"""Sections to chunks: small leaves as they are, large leaves as a parent and indexed pieces, other sections as parents
where they are small enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions import splitting
from folioworks.functions.text import as_of_date, chunk_id, table_ids

CHILD, OVERLAP, PARENT = 800, 120, 3500


def split_text(texts: DataFrame, limit: int = CHILD, overlap: int = OVERLAP, table_aware: bool = True) -> DataFrame:
    """texts (id columns, text) -> id columns, index, total, text: pieces of at most limit characters (overlap added)."""
    cut = splitting.split_table_aware if table_aware else splitting.split_text

    ids = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[ids].assign(text=part["text"].map(lambda t: cut(t or "", limit, overlap)))
            x["total"] = x["text"].map(len)
            x["index"] = x["text"].map(lambda p: list(range(len(p))))
            yield x.explode(["text", "index"])[[*ids, "total", "index", "text"]]

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in ids)
    return texts.select(*ids, "text").mapInPandas(run, f"{schema}, total int, index int, text string")


def inject_summaries(texts: DataFrame) -> DataFrame:
    """texts (id columns, text, summaries: map of table id to summary) -> id columns, text with the summaries put in."""
    ids = [c for c in texts.columns if c not in ("text", "summaries")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            said = [splitting.inject_summaries(t or "", dict(s) if s is not None else {}) for t, s in zip(part["text"], part["summaries"], strict=True)]
            yield part[ids].assign(text=said)

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in ids)
    return texts.select(*ids, "text", "summaries").mapInPandas(run, f"{schema}, text string")


def split_tables(blocks: DataFrame, limit: int) -> DataFrame:
    """blocks (doc_id, table_id, raw, optional summary) -> doc_id, table_id, index, text: fragments of a table by rows, each
    with its frame (and the summary, where it fits)."""
    said = F.col("summary") if "summary" in blocks.columns else F.lit(None).cast("string")

    @F.pandas_udf("array<string>")
    def fragments(name: pd.Series, raw: pd.Series, summary: pd.Series) -> pd.Series:
        return pd.Series([splitting.split_table(n, r, r.splitlines(), limit, s) for n, r, s in zip(name, raw, summary, strict=True)])

    return blocks.select("doc_id", "table_id", F.posexplode(fragments("table_id", "raw", said)).alias("index", "text"))


def chunk_profile(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """doc_id -> child_max, overlap, parent_max: the document's own, else the default."""
    x = docs.select("doc_id").join(overrides.select("doc_id", "child_max", "overlap", "parent_max"), "doc_id", "left")
    return x.select("doc_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("child_max", CHILD), ("overlap", OVERLAP), ("parent_max", PARENT))])


def build_chunks(sections: DataFrame, catalog: DataFrame, run_date: Column, overrides: DataFrame | None = None) -> DataFrame:
    """sections (tree rows with text, is_leaf, optional summaries map) x catalog (doc_id, source_type, doc_type,
    doc_subtype, cluster, approval_date) -> one row for each chunk.

    A section's context is its nearest ancestor with a parent chunk; a large section that is no leaf has none, and its
    children take the next one out. Ancestors are found by (doc_id, section_id), a join on narrow rows.
    """
    if "summaries" not in sections.columns:
        sections = sections.withColumn("summaries", F.lit(None).cast("map<string,string>"))

    @F.pandas_udf("string")
    def injected(text: pd.Series, summaries: pd.Series) -> pd.Series:
        return pd.Series([splitting.inject_summaries(t, dict(s)) if s is not None and len(s) else t for t, s in zip(text, summaries, strict=True)])

    profiles = overrides if overrides is not None else catalog.select("doc_id", *[F.lit(None).cast("int").alias(c) for c in ("child_max", "overlap", "parent_max")])
    x = sections.join(chunk_profile(catalog, profiles), "doc_id")
    has_table = F.col("text").contains("⟦TABLE")
    x = x.withColumn("own", F.col("text")).withColumn("text", F.when(has_table & F.col("summaries").isNotNull(), injected("text", "summaries")).otherwise(F.col("text")))
    n = F.length("text")
    kind = F.when(~F.col("is_leaf"), F.when(n <= F.col("parent_max"), "split_parent")).when(n <= F.col("child_max"), "leaf").otherwise("split_parent")
    x = x.withColumn("chunk_type", kind)

    contexts = x.where("NOT is_leaf AND chunk_type IS NOT NULL").select("doc_id", F.col("section_id").alias("a"), chunk_id(F.col("doc_id"), F.col("path"), F.col("order"), F.lit("parent")).alias("context"))
    above = x.select("doc_id", "section_id", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("depth", "a"))
    nearest = above.join(contexts, ["doc_id", "a"]).groupBy("doc_id", "section_id").agg(F.max_by("context", "depth").alias("context"))
    x = x.join(nearest, ["doc_id", "section_id"], "left")

    whole = x.where("chunk_type IS NOT NULL")
    suffix = F.when(F.col("chunk_type") == "leaf", "0").otherwise("parent")
    whole = whole.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("path"), F.col("order"), suffix)).withColumn("parent_chunk_id", F.col("context")).withColumn("chunk_index", F.lit(0)).withColumn("chunk_total", F.lit(1))

    @F.pandas_udf("array<string>")
    def children(text: pd.Series, summaries: pd.Series, child: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([splitting.split_table_aware(t, int(c), int(o), dict(s) if s is not None else None) for t, s, c, o in zip(text, summaries, child, overlap, strict=True)])

    big = x.where("is_leaf AND chunk_type = 'split_parent'")
    big = big.withColumn("_p", children("own", "summaries", "child_max", "overlap")).withColumn("chunk_total", F.size("_p"))
    big = big.select("*", F.posexplode_outer("_p").alias("chunk_index", "_t")).withColumn("text", F.col("_t")).withColumn("chunk_type", F.lit("split_child")).drop("_p", "_t")
    big = big.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("path"), F.col("order"), F.col("chunk_index"))).withColumn("parent_chunk_id", chunk_id(F.col("doc_id"), F.col("path"), F.col("order"), F.lit("parent")))

    every = whole.unionByName(big.select(*whole.columns)).join(catalog.select("doc_id", *CATALOG), "doc_id", "left")
    ids = table_ids(F.col("text"))
    said = F.array_join(F.filter(F.transform(ids, lambda i: F.try_element_at("summaries", i)), lambda s: s.isNotNull()), "\n")
    return _described(every, run_date, F.coalesce(said, F.lit("")))


CATALOG = ("source_type", "doc_type", "doc_subtype", "cluster", "approval_date")


def _described(chunks: DataFrame, run_date: Column, said: Column) -> DataFrame:
    ids, source = table_ids(F.col("text")), F.coalesce("source_type", F.lit("real"))
    return chunks.select(
        "chunk_id", "doc_id", "section_id", "parent_chunk_id", "chunk_type", (F.col("chunk_type") != "split_parent").alias("is_indexed"), "parent_section_id", "path", "level", F.col("order").alias("order_in_doc"),
        "chunk_index", "chunk_total", source.alias("source_type"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("doc_type", "doc_subtype", "cluster")], (source == "synthetic").alias("is_internal"),
        as_of_date(F.col("approval_date"), run_date).alias("as_of_date"), "text", F.length("text").alias("char_count"), (F.size(ids) > 0).alias("contains_table"), ids.alias("table_ids"), said.alias("table_summary"),
    )


def chunk_texts(docs: DataFrame, catalog: DataFrame, run_date: Column, overrides: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text: Markdown) x catalog -> the chunks that build_chunks makes of their sections (without table
    summaries). Outline, tree, contexts and pieces are matters of one text, so they are worked out where its row lies: texts are read
    once, and meet the catalog in one join, before there are chunks."""
    own = {c: F.lit(v) for c, v in (("child_max", CHILD), ("overlap", OVERLAP), ("parent_max", PARENT))}
    known = catalog.select("doc_id", *CATALOG)
    if overrides is None:
        known = known.withColumns(own)
    else:
        known = known.join(overrides.select("doc_id", *own), "doc_id", "left").withColumns({c: F.coalesce(c, v) for c, v in own.items()})
    x = docs.select("doc_id", "text").join(known, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = [c for c in x.columns if c not in ("doc_id", "text", "child_max", "overlap", "parent_max")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                sections = splitting.outline(r.text or "")
                held = tuple(getattr(r, c) for c in carried)
                for c in splitting.chunks(sections, int(r.child_max), int(r.overlap), int(r.parent_max)):
                    s = sections[c.section]
                    above = sections[c.context] if c.context >= 0 else None
                    suffix = {"leaf": "0", "split_parent": "parent"}.get(c.kind, str(c.index))
                    rows.append((r.doc_id, *held, s.path[-1], s.path[-2] if len(s.path) > 1 else None, list(s.path), s.level, s.order, c.kind, suffix, c.index, c.total, c.text, list(above.path) if above else None, above.order if above else None))
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", *carried, "section_id", "parent_section_id", "path", "level", "order", "chunk_type", "suffix", "chunk_index", "chunk_total", "text", "context_path", "context_order"]
    kinds = [kind, *(x.schema[c].dataType.simpleString() for c in carried), "string", "string", "array<string>", "int", "int", "string", "string", "int", "int", "string", "array<string>", "int"]
    made = x.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    named = made.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("path"), F.col("order"), F.col("suffix")))
    context = F.when(F.col("context_path").isNotNull(), chunk_id(F.col("doc_id"), F.col("context_path"), F.col("context_order"), F.lit("parent")))
    return _described(named.withColumn("parent_chunk_id", context), run_date, F.lit(""))


def indexable_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("is_indexed")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if("is_indexed").alias("indexed_count"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Scalar metadata of a chunk: null strings '' , booleans false, numbers 0, table ids joined by commas."""
    text = ("doc_id", "section_id", "parent_chunk_id", "chunk_type", "parent_section_id", "source_type", "doc_type", "doc_subtype", "cluster", "as_of_date")
    return chunks.select(
        "chunk_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("level", "chunk_index", "chunk_total")],
        F.coalesce("contains_table", F.lit(False)).alias("contains_table"), F.array_join("table_ids", ",").alias("table_ids"),
    )


def parent_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chunk_id, ...) -> with context: the parent chunk's text, or the chunk's own."""
    own = chunks.select("chunk_id", "parent_chunk_id", F.col("text").alias("_own"))
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("_parent"))
    x = hits.join(own, "chunk_id").join(parent, "parent_chunk_id", "left")
    return x.select(*hits.columns, F.coalesce("_parent", "_own").alias("context"))


def select_documents(catalog: DataFrame, only: list | None = None, cluster: str | None = None, source: str = "all") -> DataFrame:
    x = catalog if only is None else catalog.where(F.col("doc_id").isin(only))
    x = x if cluster is None else x.where(F.col("cluster") == cluster)
    return x if source == "all" else x.where(F.col("source_type") == source)
