"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Fitting takes a bounded sample of labelled rows (max_rows, those with the smallest hashes of their id; the bound is a
parameter), puts each statistic into quantile bins, and grows trees level by level on histograms of gradients and
hessians of the logistic loss. Trees are complete binary trees flattened into three arrays, so that scoring walks all
rows of a batch down a tree with a few numpy look-ups. Every text is scored whole.

The label, language, source and id of a row are no inputs of its score. Rows held out are never learnt from.

Defined cases: null text is the empty text and is scored like any other; null labels are not learnt from; of several
labels of one id the mean counts (1 if 0.5 or more); with no labelled rows at all, or only one label, the score is the smoothed share
of label 1; a null id has no label and is not held out; repeated rows are scored each by itself; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import hash_words, mix, slices, small_batches, string_buffers, word_spans

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "symbols", "digits", "upper", "punctuation", "non_ascii", "log_lines", "words_per_line",
    "distinct_words", "top_word", "distinct_pairs", "log_longest_word", "single_letters", "sentences", "repeated_lines",
)


def _classes() -> dict[str, np.ndarray]:
    def of(members: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(members)] = True
        return table

    return {
        "symbols": of(b"#*$%&|<>^~{}[]\\@="),
        "digits": of(b"0123456789"),
        "upper": of(bytes(range(65, 91))),
        "punctuation": of(b".,;:!?'\"()-"),
        "non_ascii": of(bytes(range(128, 256))),
        "newline": of(b"\n"),
        "sentences": of(b".!?"),
    }


_CLASSES = _classes()


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, n_bytes = len(offsets) - 1, np.diff(offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))

    counts = {k: per_text(table[raw]) for k, table in _CLASSES.items()}
    starts, ends, before = word_spans(raw, offsets)
    words, width = np.diff(before), ends - starts
    doc = np.repeat(np.arange(n), words)
    own = mix(doc.astype(np.uint64) + np.uint64(1))
    h = hash_words(raw, starts, ends)

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each text and the count of its most frequent."""
        _, at, times = np.unique(keys ^ own[: len(keys)] if len(keys) == len(own) else keys, return_index=True, return_counts=True)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, of[at], times)
        return np.bincount(of[at], minlength=n), top

    d_words, top = distinct(h, doc)
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pairs = (mix(h[:-1]) + np.uint64(3) * h[1:]) ^ own[1:] if len(h) else h
    d_pairs, _ = distinct(pairs[inside], doc[1:][inside])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, width)
    # equal lines, by a hash of the line: words of a text whose white space is the newline alone
    line_breaks = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([[0], line_breaks + 1, offsets])) if len(raw) else np.zeros(1, np.int64)
    line_start, line_end = edges[:-1], edges[1:] - (np.isin(edges[1:] - 1, line_breaks) if len(edges) > 1 else 0)
    some = line_end > line_start
    line_start, line_end = line_start[some], line_end[some]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_hash = hash_words(raw, line_start, line_end, lower=False) ^ mix(line_doc.astype(np.uint64) + np.uint64(7))
    _, at = np.unique(line_hash, return_index=True)
    lines, d_lines = np.bincount(line_doc, minlength=n), np.bincount(line_doc[at], minlength=n)
    w, b = np.maximum(words, 1), np.maximum(n_bytes, 1)
    singles = np.bincount(doc[width == 1], minlength=n)
    total = np.bincount(doc, width, minlength=n)
    n_pairs = np.maximum(words - 1, 1)
    columns = [
        np.log1p(n_bytes), np.log1p(words), total / w, counts["symbols"] / w, counts["digits"] / b, counts["upper"] / b, counts["punctuation"] / w, counts["non_ascii"] / b,
        np.log1p(counts["newline"]), words / (counts["newline"] + 1), d_words / w, top / w, np.where(words > 1, d_pairs / n_pairs, 1.0), np.log1p(longest), singles / w, counts["sentences"] / w,
        1 - d_lines / np.maximum(lines, 1),
    ]
    return np.stack(columns, 1).astype(np.float64)


def statistics(column, limit: int = 1_000_000) -> np.ndarray:
    """FEATURES of each text of an Arrow string column (rows x features)."""
    raw, offsets = string_buffers(column)
    parts = [_statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, limit)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Complete trees of one depth: node k of a tree goes on to 2 k + 1, or to 2 k + 2 where feature > threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Boosting by Newton steps on the logistic loss; the best split of a node has the greatest gain over all bins."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    all_feature, all_threshold, all_value = [], [], []
    raw = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            sums = np.zeros((3, m, width, bins))
            for j in range(m):
                flat = at * bins + binned[:, j]
                for i, weight in enumerate((grad, hess, None)):
                    sums[i, j] = np.bincount(flat, weight, minlength=width * bins).reshape(width, bins)
            left = np.cumsum(sums, 3)
            whole = left[:, :, :, -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[2] < least) | (right[2] < least)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            choice = best.argmax(1)
            for k in range(width):
                j, b = divmod(int(choice[k]), bins)
                if best[k, choice[k]] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, minlength=leaves) / (np.bincount(leaf, hess, minlength=leaves) + l2)
        raw += value[leaf]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_value.append(value)
    return Forest(np.array(all_feature), np.array(all_threshold), np.array(all_value), start)


_STATS = ", ".join(f"{f} double" for f in FEATURES)


def _featured(docs: DataFrame, more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", more, *FEATURES])

    return docs.select("doc_id", "text", more).mapInArrow(run, f"doc_id long, {more} double, {_STATS}")


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, *, max_rows: int = 20_000, seed: int = 13, **options) -> Forest:
    """Fit on docs (doc_id, text) joined with labels (doc_id, label), on at most max_rows labelled ids out of those
    where learn_from, a condition on doc_id, holds; of rows that repeat an id, the mean."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn_from)
    marked = marked.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    sample = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    rows = _featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "_y")
    # an id's rows count as one, their mean, so that max_rows rows at most come to the driver
    rows = rows.groupBy("doc_id").agg(F.first("_y").alias("_y"), *(F.avg(c).alias(c) for c in FEATURES)).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES]).to_numpy(np.float64)
    return fit_forest(rows[:, 2:], rows[:, 1], **options)


def score(docs: DataFrame, forest: Forest, held_out: Column) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score (probability of label 1), predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
