"""Quality rules with repetition measured on a suffix array of each document's words.

The words of many documents are numbered and sorted together by prefix doubling (a suffix never compares equal across
documents, because the document's number is the leading part of its first rank). The longest common prefix of
neighbours in the suffix array, read off the doubling ranks, gives for each suffix the deepest LCP interval that it
belongs to: the longest passage starting there that occurs at least twice in the document. Those that the word
before does not extend are the maximal repeats; the union of their spans is the part of the document that repeats.

Rules (a document is kept if it fails none):
- base: at least 50 words, and at most half of the words in 3-word windows that occur twice or more;
- spans of maximal repeats of min_repeat words or more cover at most max_covered of the words;
- no repeat is longer than max_longest of the words (when it has min_repeat words at least).
Symbols and repeated lines are measured beside them, with a mark of their own (noisy: more than max_symbols symbol
characters for each word, or more than max_dup_lines of the lines with a word repeat) that decides nothing here.

Defined cases: null text is the empty text (0 words: fails); repeated rows are judged each by itself; an empty table
gives an empty result; further columns are ignored by the verdicts and kept by the filter, whatever their names.
A batch is worked off in slices of about a MB of text, or one document where that is longer; a slice takes some 100 bytes
for each of its words, and 4 more for each doubling up to its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import hash_words, slices, small_batches, string_buffers, word_spans

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

DEFAULTS = {"min_repeat": 8, "max_covered": 0.45, "max_longest": 0.3, "max_symbols": 0.2, "max_dup_lines": 0.45}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, noisy boolean, n_lines long, covered_words long, longest_repeat long, n_maximal long"
)


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage starting there that occurs twice or more in its document.

    words: numbers below 2^31; doc: non-decreasing document numbers of the same length.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, "right")  # one past the last position of the own document
    order = np.argsort((doc.astype(np.int64) << np.int64(32)) | words, kind="stable")
    key = (doc[order].astype(np.int64) << np.int64(32)) | words[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.empty(n, kind)
    group = np.flatnonzero(new)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    levels = [(1, rank)]
    sa = order
    k = 1
    # places in the suffix array that still tie with a neighbour
    tied = ~(new & np.append(new[1:], True))
    while tied.any():
        at = np.flatnonzero(tied)
        pos = sa[at]
        beyond = pos + k
        # what follows: 0 past the document's end (suffixes that end tie no more: all ends differ by length)
        nxt = np.where(beyond < end[pos], rank[np.minimum(beyond, n - 1)] + 1, -(end[pos] - pos))
        base = rank[pos]
        sub = np.lexsort((nxt, base))
        pos, nxt, base = pos[sub], nxt[sub], base[sub]
        sa[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = (base[1:] != base[:-1]) | (nxt[1:] != nxt[:-1])
        first = np.flatnonzero(fresh)
        new_rank = rank.copy()
        new_rank[pos] = at[np.repeat(first, np.diff(np.append(first, len(at))))]
        rank = new_rank
        k *= 2
        levels.append((k, rank))
        still = ~(fresh & np.append(fresh[1:], True))
        tied = np.zeros(n, bool)
        tied[at[still]] = True
    # LCP of neighbours in the suffix array, by descending powers of two
    a, b = sa[:-1].copy(), sa[1:].copy()
    live = np.flatnonzero(levels[0][1][a] == levels[0][1][b]) if n > 1 else np.zeros(0, np.int64)
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: of sa[i - 1] and sa[i]
    if len(live):
        a, b = a[live], b[live]
        got = np.zeros(len(live), np.int64)
        for step, r in reversed(levels):
            inside = (a < n) & (b < n)
            same = inside.copy()
            same[inside] = (r[a[inside]] == r[b[inside]]) & (a[inside] + step <= end[sa[live][inside]]) & (b[inside] + step <= end[sa[live + 1][inside]])
            got += same * step
            a += same * step
            b += same * step
        lcp[live + 1] = got
    deepest = np.empty(n, np.int64)
    deepest[sa] = np.maximum(lcp[:-1], lcp[1:])
    return deepest


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Positions inside the union of spans [i, i + lengths[i]) with lengths[i] >= least."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + lengths[at], n), 1)
    return np.cumsum(edge[:-1]) > 0


def measure(raw: np.ndarray, offsets: np.ndarray, options: dict) -> dict[str, np.ndarray]:
    """The measures and verdicts of some texts (bytes and offsets), in the order of MEASURES. Words are told apart by
    64-bit hashes."""
    starts, ends, before = word_spans(raw, offsets)
    n_words = np.diff(before)
    flat = np.unique(hash_words(raw, starts, ends, lower=False), return_inverse=True)[1].astype(np.int64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    deep = repeat_lengths(flat, doc)
    every = raw.tobytes()
    texts = [every[offsets[k] : offsets[k + 1]] for k in range(len(n_words))]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[before])

    shift = np.zeros(len(deep), np.int64)  # of a span that the word before extends
    if len(deep) > 1:
        shift[1:] = np.where(doc[1:] == doc[:-1], deep[:-1] - 1, 0)
    least = options["min_repeat"]
    maximal = (deep >= least) & (deep > shift)
    spans = np.where(maximal, deep, 0)
    n_repeat, in_spans, n_maximal = count(covered(deep, 3)), count(covered(spans, least)), count(maximal)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, deep)
    word_chars = np.empty(len(texts), np.int64)
    n_symbols, n_lines, n_dup = word_chars.copy(), word_chars.copy(), word_chars.copy()
    for i, t in enumerate(texts):
        solid = t.translate(None, SPACES)
        word_chars[i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
        n_symbols[i] = len(t) - len(t.translate(None, SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    bad = (in_spans > options["max_covered"] * n_words) | ((longest >= least) & (longest > options["max_longest"] * n_words))
    noisy = (n_symbols > options["max_symbols"] * n_words) | (n_dup > options["max_dup_lines"] * n_lines)
    return dict(
        n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup, n_repeat_words=n_repeat,
        base_failed=failed, kept=~failed & ~bad, noisy=noisy, n_lines=n_lines, covered_words=in_spans, longest_repeat=longest, n_maximal=n_maximal,
    )


def _measured(column, options: dict, limit: int = 1_000_000) -> dict[str, np.ndarray]:
    raw, offsets = string_buffers(column)
    parts = [measure(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], options) for i, j in slices(offsets, limit)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else measure(raw, offsets, options)


def judge(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id and MEASURES, one row for each row."""
    opts = DEFAULTS | options
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _measured(batch.column(1), opts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], names=["doc_id", *got])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {MEASURES}")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that the rules keep: each task filters what it has read, nothing is shuffled."""
    opts, at = DEFAULTS | options, docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch.column(at), opts)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def plain_measures(text: str | None, options: dict = DEFAULTS) -> dict[str, int]:
    """The base measures by brute force, for tests."""
    text = text or ""
    words = text.encode().split()
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {p + d for at in windows.values() if len(at) > 1 for p in at for d in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(text.count(c.decode()) for c in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }
