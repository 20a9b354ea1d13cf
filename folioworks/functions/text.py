"""Column functions for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The table markers, the mark of a cut, and the month names of written dates.
OPEN, CLOSE = "⟦TABLE id=", "⟦/TABLE⟧"
BLOCK = r"⟦TABLE\s+id=[^⟧]+⟧\n(?s:.*?)\n⟦/TABLE⟧"
CLIPPED = "\n\n...[DOCUMENT TRUNCATED]...\n\n"
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def normalize_text(text: Column) -> Column:
    """Words hyphenated over a line break are joined (not before a table), and three or more newlines become two."""
    joined = F.regexp_replace(text, r"(?U)(\w)-\n(?!⟦)(\w)", "$1$2")
    return F.regexp_replace(joined, r"\n{3,}", "\n\n")


def extract_dates(text: Column) -> Column:
    """Every date in a text, dd.mm.yyyy or dd/mm/yyyy first, then written ones; what is no date is dropped."""
    numeric = F.transform(
        F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}[./]\d{1,2}[./]\d{4})\b"), F.lit(1)), lambda x: F.try_to_date(F.regexp_replace(x, "/", "."), "d.M.yyyy")
    )
    written = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b(\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}})"), F.lit(1))
    names = F.array(*map(F.lit, MONTHS))

    def date_of(x: Column) -> Column:
        part = F.split(x, r"(?U)\s+")
        month = F.array_position(names, part[1]).cast("string")
        return F.try_to_date(F.concat_ws(".", part[0], month, part[2]), "d.M.yyyy")

    return F.filter(F.concat(numeric, F.transform(written, date_of)), lambda d: d.isNotNull())


def as_of_date(approval: Column, run_date: Column) -> Column:
    """DD.MM.YYYY as YYYY-MM-DD, padded but not checked against the calendar; run_date where it has other parts."""
    part = F.split(approval, r"\.")
    iso = F.concat_ws("-", F.get(part, F.lit(2)), F.lpad(F.get(part, F.lit(1)), 2, "0"), F.lpad(F.get(part, F.lit(0)), 2, "0"))
    return F.when(approval.isNotNull() & (F.size(part) == 3), iso).otherwise(run_date)


def table_ids(text: Column) -> Column:
    """Ids of the tables that open in a text; one cut off before its end counts."""
    return F.regexp_extract_all(text, F.lit(r"⟦TABLE\s+id=([^\s⟧]+)⟧"), F.lit(1))


def clean_cell(cell: Column) -> Column:
    return F.replace(strip(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def format_table(rows: Column, table_id: Column, caption: Column | None = None) -> Column:
    """A table (array of rows of cells) as a marked block of pipe rows, all as wide as the widest; '' if all is empty."""
    width = F.array_max(F.transform(rows, F.size))
    even = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: clean_cell(F.try_element_at(r, i))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    body = F.transform(F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))), line)
    lines = F.concat(F.array(F.concat(F.lit(OPEN), table_id, F.lit("⟧")), line(even[0]), rule), body, F.array(F.lit(CLOSE)))
    block = F.array_join(lines, "\n")
    if caption is not None:
        title = strip(F.coalesce(caption, F.lit("")))
        block = F.when(title != "", F.concat(title, F.lit("\n"), block)).otherwise(block)
    empty = rows.isNull() | (F.coalesce(width, F.lit(0)) < 1) | ~F.exists(even, lambda r: F.exists(r, lambda c: c != ""))
    return F.when(empty, F.lit("")).otherwise(block)


def overlapped(parts: Column, overlap: int) -> Column:
    """An array of pieces, each after the end of the one before it: its last overlap characters, from the first space on."""
    tail = lambda before: F.regexp_replace(F.right(before, F.lit(overlap)), r"(?s)^[^ ]* (.*)$", "$1")
    joined = lambda x, i: F.when(i == 0, x["part"]).otherwise(F.concat(tail(x["before"]), F.when(tail(x["before"]) == "", "").otherwise(" "), x["part"]))
    # pieces meet the ones before them as two arrays: what stands in a lambda is worked out anew for each piece
    pairs = F.zip_with(parts, F.concat(F.array(F.lit(None).cast("string")), parts), lambda part, before: F.struct(part.alias("part"), before.alias("before")))
    return F.transform(F.slice(pairs, F.lit(1), F.size(parts)), joined) if overlap > 0 else parts


def clip_document(text: Column, limit: int = 90_000) -> Column:
    """A text above the limit as its head, middle and tail thirds between markers, cut to the limit."""
    third = limit // 3
    start = F.greatest(F.lit(0), F.floor(F.length(text) / 2).cast("int") - third // 2) + 1
    cut = F.concat_ws(CLIPPED, F.substring(text, F.lit(1), F.lit(third)), F.substring(text, start, F.lit(third)), F.right(text, F.lit(third)))
    return F.when(F.length(text) > limit, F.substring(cut, 1, limit)).otherwise(text)


def chunk_id(doc_id: Column, path: Column, order: Column, suffix: Column) -> Column:
    safe = F.array_join(F.transform(path, lambda p: F.regexp_replace(p, r"(?U)[^\w-]", "_")), "__")
    return F.concat(doc_id.cast("string"), F.lit("__"), safe, F.lit("__ord_"), order.cast("string"), F.lit("__"), suffix.cast("string"))
