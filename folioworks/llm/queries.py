"""The registered queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import alignment, lm_score, mixing, neardup, packing, pii, prefix_trie, quality_model, quality_rules, token_files, topk, warc, window_packing
from folioworks.llm.shared import cut, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op4_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest, ids=False)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "sizes")
    mixed = mixing.mix_sources(sizes, size=F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    forest = quality_model.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality_model.score(docs, forest, held_out)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


OP8 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) END AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (
    SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE node = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


def op9_suffix_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP10 = """
WITH e AS (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]


def op12_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = window_packing.cut_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    packed = window_packing.pack_windows(pieces)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded")


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_shared_openings(turns))


OP13 = r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN o ON o.conv_id = base AND p <= h UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN o USING (conv_id) WHERE p > h),
l AS (SELECT conv_id, coalesce(list(concat(length(role), ' ', role, text) ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS t, coalesce(list(len(regexp_extract_all(text, '[^ 	-]+')) ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS w
    FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
x AS (SELECT conv_id, unnest(range(0, len(t) + 1)) AS depth, t, w FROM l),
n AS (SELECT depth, list_slice(t, 1, depth) AS k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN w[depth] ELSE 0 END) AS words,
    sha256(coalesce(string_agg(CASE WHEN len(t) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256, max(len(t)) = depth AS leaf FROM x GROUP BY 1, 2),
s AS (SELECT list_slice(k, 1, d) AS k, CAST(sum(leaf::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY 1),
f AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = list_slice(n.k, 1, n.depth - 1) JOIN s ON s.k = n.k LEFT JOIN f ON f.k = n.k
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_field": op2_pii_field,
    "op3_pitman_yor_scores": op3_pitman_yor_scores,
    "op4_wavelet_token_files": op4_wavelet_token_files,
    "op5_source_mix": op5_source_mix,
    "op6_warc_archives": op6_warc_archives,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_array_rules": op9_suffix_array_rules,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_token_alignment": op11_token_alignment,
    "op12_best_fit_decreasing": op12_best_fit_decreasing,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLES = {"op8_ngram_jaccard_join": OP8, "op6_warc_archives": OP6, "op10_exact_top_k": OP10, "op13_conversation_prefix_trie": OP13}
