"""The trie of conversations' beginnings, and what sharing them saves.

A node of depth d is a distinct sequence of d first turns; the root has none. Turns are told apart by a 128-bit hash of
role and text. A conversation's turns are laid out in blocks of BLOCK positional columns, and one ROLLUP over these
columns aggregates all prefixes together; grouping_id says how many turns each of its rows has. A conversation longer than
a block goes on in further blocks, each grouped first by the node in which the block before it ends.

A node is named by two 64-bit exclusive ors, one term for each block up to it, a hash of the block's number and turns. So the
node before a block is an exclusive or over the blocks before it, which is worked out in two steps (stretches of blocks,
then blocks of a stretch): no conversation, however long, meets in one task or one array, and no round of jobs is made for a depth.

Sums over subtrees come from a second ROLLUP over conversations, not from walks along the trie: a node is its smallest
member's own, the nodes that a conversation owns lie at the end of its path, and so those of a subtree are what its
members own, but for the part of the smallest member's that lies above. Pairs of nodes and ancestors are never made.

Positions in a conversation are counted in ranges of rows of about equal size (partial counts of the ranges before are
added), so a conversation with a third of all rows is spread. ids of the conversations that end at a node are written
out in sorted ranges, in texts of many ids, which one pass per node then digests in order.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty; turns of one number go by role,
then by the text's MD5; repeated rows are turns of their own; a conversation without turns ends at the root; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, word_count

#: Turns in a block of columns, blocks in a stretch.
BLOCK, STRETCH = 8, 1024
_KEY = ["depth", "x", "y"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, pos from 1, id (16 bytes), words. The text stays behind."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"))).alias("id"), word_count(text).alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "role", "digest", "row"]  # row spreads equal rows over ranges
    ranges = cut(rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select("conv_id", *order, "id", "words", F.spark_partition_id().alias("range")), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "range").orderBy(*order)
    placed = ranges.withColumn("own", F.row_number().over(own)).join(counts, ["conv_id", "range"])
    return cut(placed.select("conv_id", (F.col("before") + F.col("own")).alias("pos"), "id", "words"), "positions")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild conversations: the first h turns are those of the conversation whose id is the next multiple of every
    towards 0, then the own ones after the first h; h is the CRC-32 of the id modulo most -> (turns, conversations' ids)."""
    ids = turns.select("conv_id").distinct()
    base, h = F.col("conv_id") - F.col("conv_id") % every, F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    openings = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    borrowed = ids.withColumn("base", base).join(openings, "base").where(F.col("pos") <= h).select("conv_id", "pos", "id", "words")
    sizes = openings.groupBy("base").agg(F.count(F.lit(1)).alias("size"))
    own = turns.where(F.col("pos") > h).withColumn("base", base).join(sizes, "base", "left")
    own = own.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("size", F.lit(0)))).alias("pos"), "id", "words")
    return own.unionByName(borrowed), ids


T, W = [f"t{i}" for i in range(BLOCK)], [f"w{i}" for i in range(BLOCK)]


def blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each block of each conversation, one without turns for a conversation that has none: conv_id, block, size,
    turns t0, t1, ... and their words w0, w1, ..., the block's hashes (hx, hy), and, of what lies before it, the node (px, py) and
    the words (before)."""
    turn = F.struct(((F.col("pos") - 1) % BLOCK).alias("slot"), "id", "words")
    rows = turns.select("conv_id", ((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), turn.alias("turn"))
    rows = rows.unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn")))
    x = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # without nulls, BLOCK at most
    x = x.select("conv_id", "block", F.size("turns").alias("size"), *(F.get("turns", F.lit(i))[c].alias(f"{n}{i}") for n, c in (("t", "id"), ("w", "words")) for i in range(BLOCK)))
    own = {"hx": F.xxhash64(F.lit(1), "block", *T), "hy": F.xxhash64(F.lit(2), "block", *T), "words": sum((F.coalesce(w, F.lit(0)) for w in W), F.lit(0).cast("long"))}
    x = cut(x.withColumns(own | {"stretch": (F.col("block") / STRETCH).cast("long")}), "blocks")
    before = {"px": (F.bit_xor, "hx"), "py": (F.bit_xor, "hy"), "before": (F.sum, "words")}
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    stretches = x.groupBy("conv_id", "stretch").agg(*(f(c).alias(f"all_{name}") for name, (f, c) in before.items()))
    stretches = stretches.select("conv_id", "stretch", *(F.coalesce(f(f"all_{name}").over(earlier), zero).alias(f"far_{name}") for name, (f, _) in before.items()))
    x = x.withColumns({name: F.coalesce(f(c).over(inside), zero) for name, (f, c) in before.items()}).join(stretches, ["conv_id", "stretch"])
    x = x.withColumns({"px": F.col("px").bitwiseXOR(F.col("far_px")), "py": F.col("py").bitwiseXOR(F.col("far_py")), "before": F.col("before") + F.col("far_before")})
    return cut(x.drop("stretch", *(f"far_{name}" for name in before)), "blocks")


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of blocks' rows by one ROLLUP: depth, x, y, those of the parent (ux, uy), and the sums asked for."""
    names = ", ".join(T)
    x = rows.sparkSession.sql(f"SELECT block, px, py, {names}, grouping_id() AS g, {sums} FROM {{rows}} GROUP BY block, px, py, ROLLUP ({names})", rows=rows)
    x = x.withColumn("level", BLOCK - F.bit_count("g"))
    x = x.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.get(F.array(*T), F.col("level") - 1).isNotNull()))

    def key(seed: int, before: str, level: Column) -> Column:
        turns = [F.when(level > i, F.col(t)) for i, t in enumerate(T)]
        return F.when(level <= 0, F.col(before)).otherwise(F.col(before).bitwiseXOR(F.xxhash64(F.lit(seed), "block", *turns)))

    level = F.col("level")
    keys = {"x": key(1, "px", level), "y": key(2, "py", level), "ux": key(1, "px", level - 1), "uy": key(2, "py", level - 1), "depth": F.col("block") * BLOCK + level}
    return x.withColumns(keys).drop(*T, "px", "py", "g", "block")


def _digests(ends: DataFrame) -> DataFrame:
    """ends (depth, x, y, conv_id) -> ends_sha256 of the ids of each node, ascending, comma-joined. ids are written out in
    sorted ranges of rows, whose texts (of one batch at most) are digested node by node in the order of their first ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            edges = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0))) if batch.num_rows else np.zeros(0, np.int64)
            ids = columns[3].tolist()
            spelled = [",".join(map(str, ids[a:b])) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[edges]) for c in columns), pa.array(spelled, pa.string())], names=[*_KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for d, x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, x, y) == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, x, y), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield _batch(done)
        if node:
            yield _batch([(*node, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*_KEY, "ends_sha256"])

    keys = "depth long, x long, y long, "
    ranged = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(texts, keys + "first long, ids string")
    return ranged.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, keys + "ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns (conv_id, pos from 1, id, words), conversations (conv_id, all of them) -> a row for each node: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    x = blocks(turns, conversations)
    most = ", ".join(f"max({w}) AS {w}" for w in W)
    nodes = _rolled(x, f"min(conv_id) AS conv_id, count(*) AS n_convs, max(before) AS before, {most}")
    w, level = [F.coalesce(c, F.lit(0)) for c in W], F.col("level")
    above = sum((F.when(level > i + 1, c).otherwise(0) for i, c in enumerate(w)), F.col("before"))
    nodes = nodes.withColumns({"above": above, "words": F.coalesce(F.get(F.array(*W), level - 1), F.lit(0))})
    nodes = cut(nodes.select(*_KEY, "ux", "uy", "conv_id", "n_convs", "above", "words"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ux").alias("x"), F.col("uy").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.min("above").alias("above_own"))
    totals = x.groupBy("conv_id").agg(F.sum("words").alias("total")).join(owned, "conv_id", "left")
    totals = cut(totals.select("conv_id", "total", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("owned", "leaves", "above_own"))), "owners")
    under = _rolled(x.join(totals, "conv_id"), "sum(total) AS total, sum(owned) AS owned, sum(leaves) AS n_leaves").select(*_KEY, "total", "owned", "n_leaves")

    last = x.groupBy("conv_id").agg(F.max_by(F.struct("px", "py", "hx", "hy", "block", "size"), "block").alias("l"))
    of_last = lambda before, own: F.when(F.col("l.size") == 0, F.col(f"l.{before}")).otherwise(F.col(f"l.{before}").bitwiseXOR(F.col(f"l.{own}")))
    ends = last.select((F.col("l.block") * BLOCK + F.col("l.size")).alias("depth"), of_last("px", "hx").alias("x"), of_last("py", "hy").alias("y"), "conv_id")

    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(under, _KEY).join(_digests(ends), _KEY, "left").join(totals.select("conv_id", "above_own"), "conv_id")
    out = out.join(parents, ["depth", "ux", "uy"], "left")
    # all members' words from here on, less each node's own words once: what members own, without what the smallest owns above
    saved = F.col("total") - F.col("owned") - F.col("above_own") - (F.col("n_convs") - 1) * F.col("above")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )
