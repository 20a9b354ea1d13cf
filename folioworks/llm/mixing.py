"""Mixing sources to target weights by apportionment, with DataFrame functions only.

1. Targets: sources in code-point order (null last) have weights; each gets its weight's part of all words, but no
   more than max_repeat times its own; what is above goes to the others by weight (water filling, in closed form by a
   running sum over the sources ordered by capacity / weight).
2. The words are dealt in blocks of block_words (of fewer to a source whose target is but a few of these): the Sainte-Lague rule gives each source the number of its quotients
   target / (j - 1/2) among the highest, then each source's blocks go to its cells by the same rule. What a cell's
   quota has above max_repeat times its words goes, word by word, to the source's cells with room, in proportion to it.
3. In a cell, documents stand in a seeded order and their words form one line, cut into blocks. A quota is taken as
   whole passes over the line and, for the rest, as the first blocks of a seeded permutation of the cell's blocks.
   Each document works out from its own place in the line what was taken from it, so no block is ever shuffled.

Shards are slots of a hash of the id, one for each docs_per_shard documents of the table and max_shards at most, so a
source with a third of all rows is many shards. A cell is a run of a source's neighbouring shards, as many as it takes
for some cell_blocks blocks of its own words, so a rare source has few cells, and a source of many words one a shard.
The tables of sources and of shards (sources x max_shards rows at most) are all that meets in few tasks.

Defined cases: null text has size 0 and nothing is taken; null source is a source, the last; repeated rows are rows of
their own (ties in the seeded order go by size, then by the text's hash); a table or a source of a few words is mixed to within
a word or two; an empty table gives an empty result; further columns pass through, whatever their names, and those of the
results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, word_count

#: A source whose target is below so many blocks gets blocks of that part of its target, of a word at least.
FEW_BLOCKS = 16
#: Multipliers of the seeded permutations: primes above 2^31, so prime to any smaller number of blocks.
PRIMES = (2654435761, 2246822519, 3266489917, 4294967291)


def apportion(parts: DataFrame, by: Sequence[str], votes: str, seats: str, tie: Sequence[str], out: str) -> DataFrame:
    """Sainte-Lague: add column out, the seats each row gets of its group's seats (by = [] for one group).

    With S rows, V votes and B seats, divisor V / (B - S/2) surely gives B seats at most and V / (B + S/2) at least,
    so only seats between the two counts (some 2 S of them) are ranked by quotient; ties go in the order of tie.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = (
        parts.withColumn("_v", F.sum(votes).over(group))
        .withColumn("_s", F.count(F.lit(1)).over(group))
        .withColumn("_b", F.col(seats).cast("double"))
    )
    low_div, high_div = F.col("_b") + F.col("_s") / 2 + 1, F.col("_b") - F.col("_s") / 2 - 1
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0)
    x = x.withColumn("_lo", F.when(high_div > 0, F.floor(share * high_div + 0.5)).otherwise(F.lit(0)).cast("long"))
    x = x.withColumn("_hi", F.greatest("_lo", F.floor(share * low_div + 0.5).cast("long")))
    x = x.withColumn("_open", F.col(seats) - F.sum("_lo").over(group))
    tries = (
        x.where("_hi > _lo")
        .withColumn("_j", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
        .withColumn("_q", F.col(votes) / (F.col("_j") - 0.5))
        .withColumn("_r", F.row_number().over(group.orderBy(F.desc("_q"), *tie, "_j")))
        .where(F.col("_r") <= F.col("_open"))
        .groupBy(*by, *[t for t in tie if t not in by])
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    keys = [*by, *[t for t in tie if t not in by]]
    return (
        x.join(tries, keys, "left")
        .withColumn(out, F.col("_lo") + F.coalesce("_more", F.lit(0)))
        .drop("_v", "_s", "_b", "_lo", "_hi", "_open", "_more")
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(_key, source_size) -> with target: weighted shares of all words, none above max_repeat x source_size."""
    everything = Window.partitionBy(F.lit(0))
    rank = (F.row_number().over(everything.orderBy("_key")) - 1) % len(weights)
    x = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    x = x.withColumn("_cap", F.col("source_size") * float(max_repeat))
    x = x.withColumn("_all", F.sum("source_size").over(everything) * float(share))
    x = x.withColumn("_wall", F.sum("_w").over(everything))
    earlier = everything.orderBy(F.col("_cap") / F.col("_w"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    cap0, w0 = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)), F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    x = x.withColumn("_full", F.col("_cap") / F.col("_w") < (F.col("_all") - cap0) / (F.col("_wall") - w0))
    capped = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    level = F.when(weight > 0, (F.col("_all") - capped) / weight).otherwise(0.0)
    x = x.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w")))
    return x.drop("_w", "_cap", "_all", "_wall", "_full")


def redeal(cells: DataFrame, quota: Column, cap: Column) -> DataFrame:
    """Add column _want: each cell's quota cut to its cap, and what all cuts of a source take off dealt to its cells in
    proportion to the room below their caps, in whole words and as far as there is room."""
    source = Window.partitionBy("_key")
    upto = source.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    x = cells.withColumn("_want", F.least(quota, cap)).withColumn("_room", cap - F.col("_want"))
    x = x.withColumn("_all_room", F.sum("_room").over(source)).withColumn("_above", F.sum("_room").over(upto))
    x = x.withColumn("_excess", F.least(F.sum(quota - F.col("_want")).over(source), "_all_room"))
    wide = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    dealt = lambda c: f"{wide('_excess')} * {wide(c)} div {wide('_all_room')}"
    more = F.when(F.col("_excess") > 0, F.expr(f"{dealt('_above')} - {dealt('_above - _room')}")).otherwise(F.lit(0))
    return x.withColumn("_want", F.col("_want") + more).drop("_room", "_all_room", "_above", "_excess")


def mix_sources(
    docs: DataFrame,
    *,
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    max_repeat: int = 3,
    block_words: int = 64,
    docs_per_shard: int = 256,
    max_shards: int = 4096,
    cell_blocks: int = 64,
    seed: int = 17,
) -> DataFrame:
    """docs (doc_id, source, text or size, ...) -> all its rows and columns plus size, source_size, target, passes
    (times the whole document is taken), pieces (array of (start, len): word ranges taken once more) and taken."""
    # the caller's columns travel in one, so that none of them meets a name of the work here
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "passes", "pieces", "taken")]
    words = (word_count(F.col("text")) if size is None else size).cast("long")
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    sized = docs.select(F.struct(*kept).alias("_row"), "doc_id", "source", words.alias("size"), tie.alias("_tie"))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    shards = max(1, min(max_shards, docs.count() // docs_per_shard))
    base = sized.select("_row", "doc_id", "_tie", "size", key.alias("_key"), F.pmod(order, F.lit(shards)).alias("_shard"))

    parts = cut(base.groupBy("_key", "_shard").agg(F.sum("size").alias("_part")), "cells")
    sources = source_targets(parts.groupBy("_key").agg(F.sum("_part").alias("source_size")), weights, share, max_repeat)
    # a source whose target is a few blocks is dealt in smaller ones of its own, the others compete for equal blocks
    few = F.col("target") < FEW_BLOCKS * block_words
    own = F.when(few, F.greatest(F.lit(1), F.floor(F.col("target") / FEW_BLOCKS))).otherwise(F.lit(block_words)).cast("long")
    sources = sources.withColumn("_block", own).withColumn("_share", F.when(few, 0.0).otherwise(F.col("target")))
    total = F.sum("_share").over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("_blocks", F.round(total / block_words).cast("long"))
    sources = apportion(sources, [], "_share", "_blocks", ["_key"], "_quota").drop("_blocks")
    sources = sources.withColumn("_quota", F.when(few, F.round(F.col("target") / F.col("_block"))).otherwise(F.col("_quota")).cast("long")).drop("_share")

    block = F.col("_block")
    own_cells = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (block * cell_blocks))))
    parts = parts.join(sources, "_key").withColumn("_cell", F.floor(F.col("_shard") * own_cells / shards))
    cells = parts.groupBy("_key", "_cell", "source_size", "target", "_quota", "_block").agg(F.sum("_part").alias("_words"))
    cells = apportion(cells, ["_key"], "_words", "_quota", ["_cell"], "_cell_quota")
    cells = redeal(cells, F.col("_cell_quota") * block, F.col("_words") * max_repeat)
    want = F.col("_want")
    n_blocks = F.ceil(F.col("_words") / block)
    pick = F.xxhash64(F.lit(seed + 1), "_key", "_cell")
    cells = (
        cells.withColumn("passes", F.when(F.col("_words") > 0, F.floor(want / F.col("_words"))).otherwise(F.lit(0)))
        .withColumn("_rest", want - F.col("passes") * F.col("_words"))
        .withColumn("_nb", F.greatest(n_blocks, F.lit(1)))
        .withColumn("_a", F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(pick, F.lit(len(PRIMES))) + 1).cast("int")))
        .withColumn("_c", F.pmod(F.shiftright(pick, 8), F.col("_nb")))
        .withColumn("_tail", F.pmod(F.col("_a") * (F.col("_nb") - 1) + F.col("_c"), F.col("_nb")))
        .withColumn("_short", F.col("_nb") * block - F.col("_words"))
        .select("_key", "_cell", "source_size", "target", "passes", "_rest", "_nb", "_a", "_c", "_tail", "_short", "_block")
    )
    # a cell's line is those of its shards, one after the other
    along = Window.partitionBy("_key", "_cell").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("_key", "_cell", "_shard", (F.sum("_part").over(along) - F.col("_part")).alias("_before"))
    cells = parts.join(cells, ["_key", "_cell"]).drop("_cell")

    line = Window.partitionBy("_key", "_shard").orderBy(order, "doc_id", "size", "_tie")
    placed = base.withColumn("_upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    x = placed.join(cells, ["_key", "_shard"]).withColumn("_end", F.col("_before") + F.col("_upto"))
    x = x.withColumn("_start", F.col("_end") - F.col("size"))

    def piece(i: Column) -> Column:
        """What of block i is taken once more, within this document: (start in the document, words)."""
        place = F.pmod(F.col("_a") * i + F.col("_c"), F.col("_nb"))
        earlier = place * block - F.when(place > F.col("_tail"), F.col("_short")).otherwise(F.lit(0))
        got = F.greatest(F.lit(0), F.least(F.col("_rest") - earlier, F.lit(block)))
        start = F.greatest(i * block, F.col("_start"))
        end = F.least(i * block + got, F.col("_end"))
        return F.struct((start - F.col("_start")).cast("long").alias("start"), F.greatest(end - start, F.lit(0)).cast("long").alias("len"))

    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)
    pieces = F.filter(F.transform(F.sequence(first, last), piece), lambda p: p["len"] > 0)
    none = F.array().cast("array<struct<start:bigint,len:bigint>>")
    x = x.withColumn("pieces", F.when((F.col("size") > 0) & (F.col("_rest") > 0), pieces).otherwise(none))
    extra = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["len"])
    x = x.withColumn("passes", F.col("passes").cast("long"))
    x = x.withColumn("taken", F.col("passes") * F.col("size") + extra)
    return x.select(*(F.col("_row").getField(c).alias(c) for c in kept), "size", "source_size", "target", "passes", "pieces", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document once for each pass, and once more with the text of its
    pieces where some of its blocks were drawn. n_chars, where there is such a column, follows the text. Documents
    without words carry nothing to mix and go."""
    columns, row = docs.columns, F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    x = mix_sources(docs.select("doc_id", "source", "text", row), **options).where("taken > 0")
    n = F.col("passes") + F.when(F.size("pieces") > 0, 1).otherwise(0)
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    units = F.regexp_extract_all("text", F.lit(WORD_AND_SPACE), F.lit(0))
    # a lambda's argument is worked out once, where an expression inside it would be again for each piece
    taken = F.transform(F.array(units), lambda u: F.flatten(F.transform("pieces", lambda p: F.slice(u, (p["start"] + 1).cast("int"), p["len"].cast("int")))))
    cut_text = F.array_join(F.get(taken, F.lit(0)), "")
    x = x.withColumn("text", F.when(F.col("copy") <= F.col("passes"), F.col("text")).otherwise(cut_text))
    new = {"text": F.col("text")}  # the text travels once, beside the other columns
    if "n_chars" in columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return x.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))


#: A word with the white space after it.
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
