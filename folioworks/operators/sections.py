"""Texts to sections: Markdown headings and their tree, laws, regulations, coded rows, form patterns; gates and choice
among sources; aliases of section ids.

Sections are flat rows; a tree is section_id, parent_section_id, level, order and path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import splitting
from folioworks.functions.text import strip
from folioworks.sources.scratch import cut, drop

HEADING = r"^(#{1,4})\s+(.*\S.*)$"


def md_headings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, order, level, title, own_text. Text before the first heading is dropped; without a
    heading, one unnamed section holds the whole text.

    Lines are numbered inside a row and headings found there, so a document is one row until its sections explode: the
    job has no shuffle.
    """
    lines = F.split("text", "\n")
    x = docs.select("doc_id", "text", lines.alias("_l"))
    at = F.filter(F.transform("_l", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    x = x.withColumn("_at", at)
    none = F.array(F.struct(F.lit(1).alias("order"), F.lit(1).alias("level"), F.lit("").alias("title"), F.col("text").alias("own_text")))

    def section(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_at", k + 1), F.size("_l"))
        line = F.get("_l", start)
        body = F.array_join(F.slice("_l", start + 2, end - start - 1), "\n")
        return F.struct(
            (k + 1).alias("order"), F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), strip(F.regexp_extract(line, HEADING, 2)).alias("title"), strip(body).alias("own_text")
        )

    x = x.select("doc_id", F.explode(F.when(F.size("_at") > 0, F.transform("_at", section)).otherwise(none)).alias("s"))
    return x.select("doc_id", "s.*")


def section_tree(headings: DataFrame) -> DataFrame:
    """headings -> with section_id (h{level}_{n}), parent_section_id (nearest earlier heading of a lower level), path.

    Ancestors at each level are the last headings of that level, unless one of a lower level came in between.
    """
    doc = Window.partitionBy("doc_id").orderBy("order")
    x = headings.withColumn("section_id", F.concat(F.lit("h"), F.col("level"), F.lit("_"), F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("order"))))
    here = F.struct("order", "section_id")
    seen = doc.rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, here), True).over(seen) for k in (1, 2, 3)}
    x = x.select("*", *[v.alias(f"_{k}") for k, v in last.items()])
    live = []
    for k in (1, 2, 3):
        newer = [F.coalesce(F.col(f"_{j}.order"), F.lit(0)) for j in range(1, k)]
        valid = F.col(f"_{k}").isNotNull() & (F.col("level") > k)
        for n in newer:
            valid = valid & (F.col(f"_{k}.order") > n)
        live.append(F.when(valid, F.col(f"_{k}.section_id")))
    ancestors = F.array_compact(F.array(*live))
    x = x.withColumn("parent_section_id", F.element_at(F.concat(F.array(F.lit(None).cast("string")), ancestors), -1))
    return x.withColumn("path", F.concat(ancestors, F.array("section_id"))).drop("_1", "_2", "_3")


def section_rollup(tree: DataFrame) -> DataFrame:
    """tree -> with text (own text and that of all descendants, in order, blank ones skipped), char_count, is_leaf."""
    pieces = tree.select("doc_id", F.explode("path").alias("section_id"), "order", "own_text")
    whole = pieces.where("own_text <> ''").groupBy("doc_id", "section_id").agg(F.sort_array(F.collect_list(F.struct("order", "own_text"))).alias("_p"))
    counts = tree.where("parent_section_id IS NOT NULL").groupBy("doc_id", F.col("parent_section_id").alias("section_id")).agg(F.count(F.lit(1)).alias("_c"))
    x = tree.join(whole, ["doc_id", "section_id"], "left").join(counts, ["doc_id", "section_id"], "left")
    text = F.coalesce(F.array_join(F.transform("_p", lambda p: p["own_text"]), "\n\n"), F.lit(""))
    return x.withColumn("text", text).withColumn("char_count", F.length("text")).withColumn("is_leaf", F.col("_c").isNull()).drop("_p", "_c")


def _by_text(docs: DataFrame, schema: str, rows) -> DataFrame:
    """Apply a plain function of a text to every document, batch by batch, without a shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]
        for part in batches:
            out = [(doc_id, *row) for doc_id, text in zip(part["doc_id"], part["text"], strict=True) for row in rows(text or "")]
            yield pd.DataFrame(out, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, {schema}")


def split_articles(docs: DataFrame) -> DataFrame:
    """A law's articles: doc_id, pos, section_id, title, text, service (looks like a note of change)."""
    return _by_text(docs, "pos int, section_id string, title string, text string, service boolean", lambda t: [(i, *a) for i, a in enumerate(splitting.articles(t))])


def split_chapters(docs: DataFrame) -> DataFrame:
    """A regulation's chapters, appendices and points: doc_id, pos, section_id, parent_section_id, title, text."""
    return _by_text(docs, "pos int, section_id string, parent_section_id string, title string, text string", lambda t: [(i, *c) for i, c in enumerate(splitting.chapters(t))])


def mask_tables(docs: DataFrame) -> DataFrame:
    return _by_text(docs, "masked string", lambda t: [(splitting.mask_tables(t),)])


def dedupe_sections(sections: DataFrame, priority: Sequence[Column], key: Sequence[str] = ("doc_id", "section_id")) -> DataFrame:
    """One row for each key: the highest priority, the first of equals; it takes the place of the first. The choice is
    made on narrow rows, and the texts of all candidates meet it by the key."""
    narrow = sections.select(*key, "pos", F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], (-F.col("pos")).alias("first")).alias("_p"))
    best = narrow.groupBy(*key).agg(F.max_by("pos", "_p").alias("_from"), F.min("pos").alias("_to"))
    x = sections.join(best, list(key)).where("pos = _from")
    return x.withColumn("pos", F.col("_to")).drop("_from", "_to")


def article_priority() -> list[Column]:
    """No note of change, then a body, then its length."""
    return [~F.col("service"), F.length("text") > 0, F.length("text")]


def child_counts(sections: DataFrame) -> DataFrame:
    """sections of split_chapters with children: how many points stand under a chapter or appendix up to the next one."""
    run = F.sum(F.col("parent_section_id").isNull().cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    held = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_run")) - 1
    x = sections.withColumn("_run", run)
    return x.withColumn("children", F.when(F.col("parent_section_id").isNull(), held).otherwise(0)).drop("_run")


def _refers_elsewhere() -> Column:
    # What the notes of a legal database begin with.
    return F.lower("text").contains("см. предыдущ") | F.lower("text").contains("см. будущ")


def point_priority() -> list[Column]:
    """Of points with one number: no note of another edition, then a text, then the number of children."""
    return [~_refers_elsewhere(), strip("text") != "", F.col("children")]


def chapter_priority() -> list[Column]:
    """Of chapters and appendices with one number: a heading that names that number, then any heading, then a point of
    that chapter at the start, then no note of another edition, then children (999 at most), then length (250,000)."""
    # The six ranks in their order, the patterns of headings, and the bounds 999 and 250,000.
    chapter, appendix = F.col("section_id").startswith("гл."), F.col("section_id").startswith("Приложение")
    number = F.regexp_extract("section_id", r"(\d*)$", 1)
    low = F.lower(F.regexp_replace("text", r"(?U)^\s+", ""))
    named = F.regexp_extract("text", r"(?U)^\s*(?:ГЛАВ[АЕ]|Глав[ае])\s+(\d+)\b", 1)
    annexed = F.regexp_extract("text", r"(?U)^\s*(?:ПРИЛОЖЕНИЕ|Приложение)\s+(?:N\s*)?(\d+)\b", 1)
    bare = F.col("text").rlike(r"(?U)^\s*(?:ПРИЛОЖЕНИЕ|Приложение)\b")
    matches = F.when(chapter, named == number).when(appendix & (number == ""), bare).when(appendix, annexed == number).otherwise(False)
    headed = F.when(chapter, low.startswith("глава")).when(appendix, low.startswith("приложение")).otherwise(False)
    point = chapter & (F.regexp_extract("text", r"(?U)^\s*(\d+)(?:\.\d+)+\.", 1) == number)
    return [matches, headed, point, ~_refers_elsewhere(), F.least("children", F.lit(999)), F.least(F.length("text"), F.lit(250_000))]


# A code, and how it is named inline.
CODE, INLINE_CODE = r"\d{3,5}", r"(?i)(?:Счет|Счета)\s*N\s*(\d{3,5})\b"


def code_rows(docs: DataFrame, code: str = CODE, inline: str = INLINE_CODE) -> DataFrame:
    """Coded rows of (doc_id, section_id, text, optional pos, the section's place): cells of a pipe row whose first is a
    code, and codes named inline. Within a section the first row of a code counts, within a document the longest, at the
    place of the first; without pos, sections stand in the order of their ids."""
    place = F.col("pos") if "pos" in docs.columns else F.lit(0)
    x = docs.select("doc_id", F.struct(place.alias("place"), "section_id").alias("section"), F.posexplode(F.split("text", "\n")).alias("line", "s")).withColumn("s", strip("s"))
    cells = F.transform(F.split(F.expr("substring(s, 2, length(s) - 2)"), r"\|"), strip)
    row = F.col("s").rlike(r"^\|.*\|$")
    table = x.where(row).withColumn("c", cells).where(F.col("c")[0].rlike(f"^{code}$"))
    table = table.select("doc_id", "section", "line", F.lit(0).alias("k"), F.col("c")[0].alias("code"), F.coalesce(F.get("c", F.lit(1)), F.lit("")).alias("title"), F.array_join(F.filter("c", lambda v: v != ""), " | ").alias("text"))
    named = x.where(~row).select("doc_id", "section", "line", F.posexplode(F.regexp_extract_all("s", F.lit(inline), F.lit(1))).alias("k", "code"), F.lit("").alias("title"), F.col("s").alias("text"))
    every = table.unionByName(named).withColumn("pos", F.struct("section", "line", "k"))
    first = every.groupBy("doc_id", "section", "code").agg(F.min_by(F.struct("title", "text"), "pos").alias("v"), F.min("pos").alias("pos"))
    longest = first.groupBy("doc_id", "code").agg(F.max(F.length("v.text")).alias("longest"), F.min("pos").alias("at"))
    best = first.join(longest, ["doc_id", "code"]).where(F.length("v.text") == F.col("longest")).groupBy("doc_id", "code", "at").agg(F.min_by("v", "pos").alias("v"))
    return best.select("doc_id", "code", "v.title", "v.text", F.col("at.section.section_id").alias("section_id"), F.col("at.line").alias("line"))


def split_by_pattern(docs: DataFrame, patterns: Sequence[str], prefix: str = "форма ") -> DataFrame:
    """Sections from the first pattern (one group: the code) that matches any line of the document; the first anchor of
    each code; the body runs from the next line to the next anchor."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    hits = [F.regexp_extract("s", p, 1) for p in patterns]
    marked = lines.withColumn("h", F.array(*hits))
    which = F.coalesce(*[F.when(h != "", F.lit(i)) for i, h in enumerate(hits)])
    kind = marked.withColumn("w", which).groupBy("doc_id").agg(F.min("w").alias("w")).where("w IS NOT NULL")
    marked = marked.join(kind, "doc_id").withColumn("code", F.expr("h[w]"))
    fresh = F.row_number().over(Window.partitionBy("doc_id", "code").orderBy("line")) == 1
    marked = marked.withColumn("_a", ((F.col("code") != "") & fresh).cast("int"))
    run = F.sum("_a").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    x = marked.withColumn("n", run).where("n > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_a") == 0, F.struct("line", "s")))), lambda p: p["s"]), "\n")
    return x.groupBy("doc_id", "n").agg(F.max(F.when(F.col("_a") == 1, F.col("code"))).alias("title"), strip(body).alias("text")).select(
        "doc_id", F.col("n").alias("pos"), F.concat(F.lit(prefix), "title").alias("section_id"), "title", "text"
    )


def split_forms(docs: DataFrame, patterns: Sequence[str], prefix: str = "форма ") -> DataFrame:
    """Sections by split_by_pattern; documents in which no pattern matches any line are split by chapters instead."""
    lines = F.split("text", "\n")
    held = F.exists(lines, lambda line: F.array_contains(F.array(*[F.regexp_extract(line, p, 1) != "" for p in patterns]), True))
    marked = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    forms = split_by_pattern(marked.where("held").drop("held"), patterns, prefix).withColumn("parent_section_id", F.lit(None).cast("string"))
    columns = ["doc_id", "pos", "section_id", "parent_section_id", "title", "text"]
    return forms.select(*columns).unionByName(split_chapters(marked.where("NOT held").drop("held")).select(*columns))


def route_parser(docs: DataFrame, catalog: DataFrame, by_id: dict[str, str], by_subtype: dict[str, str]) -> DataFrame:
    """doc_id -> parser: that of the id, else of the catalog's subtype, else null with status no_parser."""
    pick = lambda names, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()], F.lit(None).cast("string"))
    x = docs.join(catalog.select("doc_id", "doc_subtype"), "doc_id", "left")
    parser = F.coalesce(pick(by_id, F.col("doc_id").cast("string")), pick(by_subtype, F.col("doc_subtype")))
    return x.select("doc_id", parser.alias("parser"), F.when(parser.isNull(), "no_parser").otherwise("ok").alias("status"))


def flatten_sections(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with unique ids, rows of repeated ids with their number)."""
    repeated = sections.groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sections.join(repeated, ["doc_id", "section_id"], "left_anti"), repeated


def section_gate(sections: DataFrame, docs: DataFrame, dominance: bool = True) -> DataFrame:
    """doc_id -> passed, reason: no sections; and by the dominance profile fewer than 3, an empty one, or one with more
    than 85 % of the characters."""
    x = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("most"), F.sum(F.length("text")).alias("chars"), F.count_if(strip("text") == "").alias("blank"))
    x = docs.select("doc_id").join(x, "doc_id", "left")
    reason = F.when(F.col("n").isNull(), "no_sections")
    if dominance:
        reason = reason.when(F.col("n") < 3, "too_few").when(F.col("blank") > 0, "empty_section").when(F.col("most") > 0.85 * F.col("chars"), "dominant")
    return x.select("doc_id", reason.isNull().alias("passed"), reason.alias("reason"))


def page_gate(pages: DataFrame, min_body: int = 500, min_text: int = 3000) -> DataFrame:
    """pages (url, body_chars, text) -> with reason, null for a page that passes."""
    n = F.length("text")
    reason = (
        F.when(F.col("body_chars") < min_body, "short_body").when(F.col("text").isNull(), "no_container").when(strip("text") == "", "empty").when((n < min_text) & ~F.col("url").endswith("/print"), "contents_only")
    )
    return pages.withColumn("reason", reason)


def pick_source(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates (doc_id, priority, attempt, kind, n_sections, passed) -> the first that passes, in order; a browser copy
    in HTML needs three sections. Documents without one: failed, or no_sources."""
    fit = F.col("passed") & ((F.col("kind") != "browser_html") | (F.col("n_sections") >= 3))
    x = candidates.groupBy("doc_id").agg(F.min(F.when(fit, F.struct("priority", "attempt", "kind"))).alias("best"), F.count(F.lit(1)).alias("n"))
    x = docs.select("doc_id").join(x, "doc_id", "left")
    status = F.when(F.col("n").isNull(), "no_sources").when(F.col("best").isNull(), "failed").when(F.col("best.kind") == "manual_pdf", "manual_pdf").otherwise("ok")
    return x.select("doc_id", F.col("best.kind").alias("kind"), F.col("best.attempt").alias("attempt"), status.alias("status"))


def wanted_sections(catalog: DataFrame) -> DataFrame:
    """catalog (pos, references) -> (ref_doc, section_id, pos): distinct ids wanted of each document, first seen first."""
    x = catalog.select("pos", F.posexplode("references").alias("i", "r")).select("pos", "i", F.col("r.doc").alias("ref_doc"), F.posexplode("r.sections").alias("j", "s"))
    first = x.groupBy("ref_doc", F.col("s.id").alias("section_id")).agg(F.min(F.struct("pos", "i", "j")).alias("at"))
    return first.select("ref_doc", "section_id", (F.row_number().over(Window.partitionBy("ref_doc").orderBy("at")) - 1).alias("pos"))


# A range of numbered sections, and one of them.
RANGE = r"^(п\.|сч\.|гл\.)(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)$"
NUMBERED = r"^(п\.|сч\.|гл\.)(\d+(?:\.\d+)?)$"


def range_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted (doc_id, wanted_id) like п.3.1-3.5 -> text of the sections with that prefix and a number in the range, in
    document order. Numbers compare as decimals (3.10 is 3.1); document and prefix are equality keys of the join."""
    part = lambda c, k, p=RANGE: F.regexp_extract(c, p, k)
    w = wanted.where(F.col("wanted_id").rlike(RANGE)).select("doc_id", "wanted_id", part("wanted_id", 1).alias("prefix"), part("wanted_id", 2).cast("double").alias("lo"), part("wanted_id", 3).cast("double").alias("hi"))
    s = sections.where(F.col("section_id").rlike(NUMBERED)).select("doc_id", part("section_id", 1, NUMBERED).alias("prefix"), part("section_id", 2, NUMBERED).cast("double").alias("num"), "pos", "text")
    x = w.join(s, ["doc_id", "prefix"]).where("num BETWEEN lo AND hi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "\n\n")
    return x.groupBy("doc_id", "wanted_id").agg(text.alias("text"))


def resolve_aliases(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted (doc_id, wanted_id) -> strategy and text: exact, without white space, without the note in brackets, a
    range, a form's number; else not_found. Resolved against the original sections only."""
    keyed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    bare = lambda c: strip(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    form = lambda c: F.concat(F.lit("форма "), F.regexp_extract(c, r"(\d{7})", 1))
    x = wanted.select("doc_id", "wanted_id").distinct()
    out = x
    for name, mine, theirs in (("exact", F.col("wanted_id"), F.col("section_id")), ("spaces", keyed(F.col("wanted_id")), keyed(F.col("section_id"))), ("note", bare(F.col("wanted_id")), F.col("section_id")), ("form", form(F.col("wanted_id")), F.col("section_id"))):
        side = sections.groupBy("doc_id", theirs.alias("_k")).agg(F.min_by("text", "pos").alias(name))
        out = out.withColumn("_k", mine).join(side, ["doc_id", "_k"], "left").drop("_k")
    out = out.join(range_sections(x, sections).withColumnRenamed("text", "range"), ["doc_id", "wanted_id"], "left")
    order = ("exact", "spaces", "note", "range", "form")
    text = F.coalesce(*order)
    strategy = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order], F.lit("not_found"))
    return out.select("doc_id", "wanted_id", strategy.alias("strategy"), text.alias("text"), F.length(text).alias("text_length"))


def _candidates(wanted: Column) -> Column:
    """What a wanted id is looked up as, in order: (rank, strategy, key)."""
    bare = strip(F.substring_index(wanted, "(", 1))
    packed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    # Names of reporting forms, whole and short.
    number = F.coalesce(*(F.nullif(F.regexp_extract(packed(bare), p, 1), F.lit("")) for p in (r"^(0409\d+)$", r"^форм[ыа](\d+)")))
    keys = (("exact", wanted), ("spaces", packed(wanted)), ("note", bare), ("note", packed(bare)), ("form", F.concat(F.lit("форма"), number)), ("form", F.concat(F.lit("форма "), number)))
    rank = {"exact": 0, "spaces": 1, "note": 2, "form": 5}  # a range stands between notes and forms
    return F.array(*(F.struct(F.lit(10 * rank[name] + k).alias("rank"), F.lit(name).alias("strategy"), key.alias("key")) for k, (name, key) in enumerate(keys)))


def resolve_aliases_in_turn(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """wanted (doc_id, pos, wanted_id) -> a row for each: strategy, text, text_length, where aliases resolved at an earlier
    pos of the document are looked up, and taken into ranges, like sections (behind them, in their own order).

    What an alias resolves to depends on those before it, so all are worked out again and again from the state before,
    until nothing changes: as each looks back only, a round settles one link more of every chain, and what stays is what
    going through them one by one gives. Rounds handle ids and places of sections; texts are joined once, in the end. Of
    sections with one id, the first counts; a range whose texts are all empty is not found.
    """
    spark = wanted.sparkSession
    packed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    first = sections.groupBy("doc_id", "section_id").agg(F.min(F.struct("pos", F.length("text").alias("n"))).alias("s"))
    own = first.select("doc_id", F.col("section_id").alias("key"), F.lit(-1).cast("long").alias("turn"), F.array(F.col("s.pos").cast("long")).alias("places"), F.coalesce("s.n", F.lit(0)).cast("long").alias("n"))
    own = cut(own, "pool")
    asked = cut(wanted.select("doc_id", F.col("pos").cast("long").alias("turn"), "wanted_id"), "wanted")
    looked = asked.select("doc_id", "turn", F.inline(_candidates(F.col("wanted_id")))).where("key IS NOT NULL")
    part = lambda c, k, p: F.regexp_extract(packed(c), p, k)
    bare = F.substring_index("wanted_id", "(", 1)
    spans = asked.where(packed(bare).rlike(RANGE)).select("doc_id", "turn", part(bare, 1, RANGE).alias("prefix"), part(bare, 2, RANGE).cast("double").alias("lo"), part(bare, 3, RANGE).cast("double").alias("hi"))
    kinds = "doc_id {}, turn long, wanted_id string, strategy string, places array<long>, n long".format(asked.schema["doc_id"].dataType.simpleString())
    state = cut(spark.createDataFrame([], kinds), "aliases")
    while True:
        earlier = state.where("strategy NOT IN ('exact', 'not_found')").select("doc_id", F.col("wanted_id").alias("key"), F.col("turn"), "places", "n")
        pool = own.unionByName(earlier).withColumnRenamed("turn", "since")
        hits = looked.join(pool, ["doc_id", "key"]).where("since < turn").select("doc_id", "turn", "rank", "strategy", "since", "places", "n")
        numbered = pool.where(packed(F.col("key")).rlike(NUMBERED)).select("doc_id", part(F.col("key"), 1, NUMBERED).alias("prefix"), part(F.col("key"), 2, NUMBERED).cast("double").alias("num"), "since", "places", "n")
        met = spans.join(numbered, ["doc_id", "prefix"]).where("since < turn AND num BETWEEN lo AND hi")
        listed = F.sort_array(F.collect_list(F.struct("since", "places", "n")))
        ranges = met.groupBy("doc_id", "turn").agg(listed.alias("l"), (F.sum("n") + 2 * (F.count(F.lit(1)) - 1)).alias("n")).where("n > 0")
        ranges = ranges.select("doc_id", "turn", F.lit(40).alias("rank"), F.lit("range").alias("strategy"), F.lit(-1).cast("long").alias("since"), F.flatten("l.places").alias("places"), "n")
        best = hits.unionByName(ranges).groupBy("doc_id", "turn").agg(F.min(F.struct("rank", "since", "strategy", "places", "n")).alias("b"))
        found = asked.join(best, ["doc_id", "turn"], "left").select("doc_id", "turn", "wanted_id", F.coalesce("b.strategy", F.lit("not_found")).alias("strategy"), "b.places", "b.n")
        now = cut(found, "aliases")
        settled = now.exceptAll(state).isEmpty()
        drop(state)
        state = now
        if settled:
            break
    pieces = state.where("places IS NOT NULL").select("doc_id", "turn", F.posexplode("places").alias("k", "pos"))
    texts = first.select("doc_id", "section_id", F.col("s.pos").cast("long").alias("pos")).join(sections.select("doc_id", "section_id", F.col("pos").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "section_id", "pos"])
    joined = pieces.join(texts, ["doc_id", "pos"]).groupBy("doc_id", "turn").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("l"))
    text = F.array_join("l.text", "\n\n")
    out = state.join(joined, ["doc_id", "turn"], "left").withColumn("text", text)
    return out.select("doc_id", F.col("turn").alias("pos"), "wanted_id", "strategy", "text", F.length("text").alias("text_length"))


def last_revision_date(docs: DataFrame, as_of: Column) -> DataFrame:
    """doc_id -> the latest date near a phrase that announces a revision; one after as_of only if there is no other."""
    from folioworks.functions.text import extract_dates

    windows = _by_text(docs, "near string", lambda t: [(w,) for w in splitting.revision_windows(t)])
    dates = windows.select("doc_id", F.explode(extract_dates(F.col("near"))).alias("d"))
    past = F.max(F.when(F.col("d") <= as_of, F.col("d")))
    return dates.groupBy("doc_id").agg(F.coalesce(past, F.max("d")).alias("revised"))


def _locate(part: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", part, text, start)


def table_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row for each table block of four lines or more: id, header, separator, rows, and where
    it starts in the text (from 1)."""
    from folioworks.functions.text import BLOCK

    found = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"({BLOCK})"), F.lit(1)).alias("_b"))
    # each block is the next one of its wording after the end of the block before
    after = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, raw: F.struct((_locate(raw, F.col("text"), a["next"]) + F.length(raw)).alias("next"), F.concat(a["starts"], F.array(_locate(raw, F.col("text"), a["next"]))).alias("starts"))
    placed = found.withColumn("_s", F.aggregate("_b", after, step, lambda a: a["starts"]))
    x = placed.select("doc_id", F.posexplode(F.arrays_zip(F.col("_b").alias("raw"), F.col("_s").alias("start"))).alias("pos", "z")).select("doc_id", "pos", "z.raw", "z.start")
    x = x.withColumn("l", F.split("raw", "\n")).where("size(l) >= 4")
    return x.select("doc_id", "pos", F.regexp_extract(F.col("l")[0], r"id=([^\s⟧]+)", 1).alias("table_id"), F.col("l")[1].alias("header"), F.col("l")[2].alias("separator"), F.expr("slice(l, 4, size(l) - 4)").alias("rows"), "raw", "start")


def table_stats(blocks: DataFrame) -> DataFrame:
    pipes = F.length("header") - F.length(F.replace("header", F.lit("|"), F.lit("")))
    return blocks.select("doc_id", "table_id", F.size("rows").alias("row_count"), F.greatest(pipes - 1, F.lit(0)).alias("column_count"))


def compact_table(blocks: DataFrame, max_chars: int = 12_000, max_rows: int = 24) -> DataFrame:
    """A large block as its first and last rows around a line that counts the others, cut to the budget."""
    head = max(1, max_rows // 2)
    tail = max(1, max_rows - head)
    n = F.size("rows")
    more = F.greatest(n - head - tail, F.lit(0))
    # The two notes on what was left out.
    note = F.array(F.concat(F.lit("| ... | Пропущено "), more.cast("string"), F.lit(" строк для сокращения prompt |")))
    some = F.when(more > 0, F.concat(F.slice("rows", 1, head), note, F.slice("rows", F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)))).otherwise(F.slice("rows", 1, max_rows))
    frame = lambda rows: F.array_join(F.concat(F.array(F.split("raw", "\n")[0], F.col("header"), F.col("separator")), rows, F.array(F.lit("⟦/TABLE⟧"))), "\n")
    x = blocks.withColumn("_s", some)
    budget = F.lit(max_chars) - F.length(frame(F.array().cast("array<string>"))) - 64
    step = lambda a, r: F.when((F.size(a["kept"]) > 0) & (a["used"] + F.length(r) + 1 > budget), F.struct(a["kept"].alias("kept"), F.lit(1 << 30).alias("used"))).otherwise(F.struct(F.concat(a["kept"], F.array(r)).alias("kept"), (a["used"] + F.length(r) + 1).alias("used")))
    kept = F.aggregate("_s", F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used")), step, lambda a: a["kept"])
    clipped = F.when((more == 0) & (F.size(kept) < F.size("_s")), F.concat(kept, F.array(F.lit("| ... | Таблица дополнительно обрезана по длине |")))).otherwise(kept)
    small = (F.length("raw") <= max_chars) & (n <= max_rows)
    text = F.when(small, F.col("raw")).when(F.length(frame(F.col("_s"))) <= max_chars, frame(F.col("_s"))).otherwise(frame(clipped))
    return x.select("doc_id", "table_id", text.alias("compact"))
