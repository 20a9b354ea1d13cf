"""Raw pages to clean text, batch by batch, with the standard parser; a page that fails gives an error row.

A page is read once and no tree of it is made: text is put together while tags come and go, so its depth costs one name for
each open element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements that end a line, and elements without content.
BLOCKS = frozenset("p div li br h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Profile:
    """What to drop and where a site keeps its text: tag, tag.class, .class or #id; the first container that occurs wins."""

    noise: tuple[str, ...] = ("nav", "script", "style", "footer", "aside", "div.ad")
    containers: tuple[str, ...] = ("article", "main", "body")


def _matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    mark = "#" if "#" in selector else "."
    wanted, _, name = selector.partition(mark)
    if wanted and wanted != tag:
        return False
    return attrs.get("id") == name if mark == "#" else not name or name in attrs.get("class", "").split()


#: Greatest spans that are followed, those of HTML itself.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534


def _span(value: str | None, most: int) -> int:
    digits = (value or "").strip()
    return min(max(1, int(digits[:9])), most) if digits.isdigit() else 1


Cell = tuple[str, int, int]


def grid(rows: list[list[Cell]]) -> list[list[str]]:
    """Rows of cells (text, colspan, rowspan) -> lines of one width; the text of a cell fills every place that it spans.
    Lines are laid out one by one, with what hangs down into the next: for each column, the rows left and the text."""
    out: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    i = 0
    while i < len(rows) or hanging:
        line: list[str] = []
        below: dict[int, tuple[int, str]] = {}

        def put(left: int, text: str, line: list[str] = line, below: dict = below, above: dict = hanging) -> None:
            column = len(line)
            line.append(text)
            if left <= 0 and column in above:
                left, text = above[column][0] - 1, above[column][1]
            if left > 0:
                below[column] = left, text

        for text, across, down in rows[i] if i < len(rows) else ():
            while len(line) in hanging:
                put(hanging[len(line)][0] - 1, hanging[len(line)][1])
            for _ in range(across):
                put(down - 1, text)
        for column in sorted(c for c in hanging if c >= len(line)):
            line += [""] * (column - len(line))
            put(hanging[column][0] - 1, hanging[column][1])
        out.append(line)
        hanging, i = below, i + 1
    width = max(map(len, out), default=0)
    return [line + [""] * (width - len(line)) for line in out] if width else []


def pipe_block(rows: list[list[str]], name: str, caption: str = "") -> str:
    if not any(any(row) for row in rows):
        return ""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    block = "\n".join([f"⟦TABLE id={name}⟧", line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:]), "⟦/TABLE⟧"])
    return f"{caption}\n{block}" if caption else block


class _Table:
    """A table as it is read: rows are children of the table or of its sections, cells children of rows; what else a cell
    holds is text. Depths count from the table."""

    def __init__(self) -> None:
        self.rows: list[list[Cell]] = []
        self.caption: str | None = None
        self._path: list[str] = []
        self._cell: tuple[int, int, int] | None = None  # its depth and its spans
        self._naming = 0
        self._text: list[str] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        path, depth = self._path, len(self._path) + 1
        path.append(tag)
        if self._cell or self._naming:
            return
        section = depth == 2 and path[0] in ("thead", "tbody", "tfoot")
        if tag == "tr" and (depth == 1 or section):
            self.rows.append([])
        elif tag in ("td", "th") and path[-2:-1] == ["tr"] and (depth == 2 or depth == 3 and path[0] in ("thead", "tbody", "tfoot")):
            self._cell, self._text = (depth, _span(attrs.get("colspan"), MAX_COLSPAN), _span(attrs.get("rowspan"), MAX_ROWSPAN)), []
        elif tag == "caption" and depth == 1 and self.caption is None:
            self._naming, self._text = depth, []

    def data(self, text: str) -> None:
        if self._cell or self._naming:
            self._text.append(text)

    def end(self) -> None:
        depth = len(self._path)
        self._path.pop()
        if self._cell and self._cell[0] == depth:
            self.rows[-1].append((" ".join(" ".join(self._text).split()), *self._cell[1:]))
            self._cell = None
        elif self._naming == depth:
            self.caption, self._naming = " ".join("".join(self._text).split()), 0

    def block(self, number: int) -> str:
        return pipe_block(grid(self.rows), f"T{number}", self.caption or "")


class _Reader:
    """Text of an element as its content is read: pieces of text, and tables, which are numbered when the text is asked for.
    What is in a noisy element is left out, what is in a table goes there."""

    def __init__(self, noise: tuple[str, ...], depth: int) -> None:
        self.noise, self.depth = noise, depth
        self.pieces: list[str | _Table] = []
        self._quiet = 0  # depth at which a noisy element or a table began
        self._table: _Table | None = None

    @property
    def listens(self) -> bool:
        return not self._quiet

    def start(self, tag: str, attrs: dict[str, str], depth: int, holds: bool) -> None:
        if self._quiet:
            if self._table and holds:
                self._table.start(tag, attrs)
            elif self._table:
                self._table.start(tag, attrs)
                self._table.end()
            return
        if any(_matches(s, tag, attrs) for s in self.noise):
            self._quiet = depth if holds else 0
        elif tag == "table":
            if holds:
                self._quiet, self._table = depth, _Table()
        elif tag in BLOCKS:
            self.pieces.append("\n")

    def data(self, text: str) -> None:
        if self._table:
            self._table.data(text)
        elif not self._quiet:
            self.pieces.append(text)

    def end(self, depth: int) -> None:
        if self._quiet and depth > self._quiet and self._table:
            self._table.end()
        elif depth == self._quiet:
            if self._table:
                self.pieces.append(self._table)
            self._quiet, self._table = 0, None


def laid_out(pieces: list[str | _Table]) -> str:
    """Tables as blocks, a new line before each block element, spaces collapsed in lines, one blank line at most between
    them."""
    out, tables = [], 0
    for piece in pieces:
        if isinstance(piece, str):
            out.append(piece)
        elif any(piece.rows):
            tables += 1
            block = piece.block(tables)
            out.append(f"\n\n{block}\n\n" if block else "")
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class PageReader(HTMLParser):
    """Reads a page once, with a stack of the open elements' names and nothing else of its tree: the text of the page, that of
    the first element of each container selector, and the first h1 and title. A container's text is a part of the page's;
    only one in a noisy element or a table of the page is read beside it."""

    def __init__(self, profile: Profile) -> None:
        super().__init__(convert_charrefs=True)
        self.profile = profile
        self.open: list[str] = []
        self._number: Counter[str] = Counter()
        self.page = _Reader(profile.noise, 0)
        self._beside: list[_Reader] = []
        self._found: dict[str, tuple[_Reader, int]] = {}  # reader and its first piece
        self._until: dict[str, int] = {}
        self._closes: dict[int, list[str]] = {}  # containers by the depth of their element
        self.titles: dict[str, str] = {}
        self._titled: dict[str, tuple[int, list[str]]] = {}

    def _start(self, tag: str, attrs: list, holds: bool) -> None:
        own, depth = {k: v or "" for k, v in attrs}, len(self.open) + 1
        for reader in (self.page, *self._beside):
            reader.start(tag, own, depth, holds)
        if tag in ("h1", "title") and tag not in self.titles and tag not in self._titled:
            self._titled[tag] = depth, []
            if not holds:
                self._name(tag)
        for selector in self.profile.containers:
            if selector not in self._found and _matches(selector, tag, own):
                reader = self.page if self.page.listens else _Reader(self.profile.noise, depth)
                if reader is not self.page and holds:
                    self._beside.append(reader)
                self._found[selector] = reader, len(reader.pieces)
                if holds:
                    self._closes.setdefault(depth, []).append(selector)
                else:
                    self._until[selector] = len(reader.pieces)
        if holds:
            self.open.append(tag)
            self._number[tag] += 1

    def _name(self, tag: str) -> None:
        self.titles[tag] = " ".join("".join(self._titled.pop(tag)[1]).split())

    def _end(self) -> None:
        depth = len(self.open)
        self._number[self.open[-1]] -= 1
        for selector in self._closes.pop(depth, ()):
            reader, _ = self._found[selector]
            self._until[selector] = len(reader.pieces)
        if self._beside:
            self._beside = [r for r in self._beside if r.depth < depth]
        for reader in (self.page, *self._beside):
            reader.end(depth)
        if self._titled:
            for tag in [t for t, (d, _) in self._titled.items() if d == depth]:
                self._name(tag)
        self.open.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, False)

    def handle_endtag(self, tag: str) -> None:
        if self._number[tag]:
            while self.open[-1] != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        self.page.data(data)
        for reader in self._beside:
            reader.data(data)
        for _, text in self._titled.values():
            text.append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._end()

    def container(self) -> str | None:
        for selector in self.profile.containers:
            if selector in self._found:
                reader, first = self._found[selector]
                return laid_out(reader.pieces[first : self._until[selector]])
        return None


def decode(page: str | bytes) -> str:
    """UTF-8 where the bytes are valid, whatever the page declares; else the declared or a legacy encoding."""
    if isinstance(page, str):
        return page
    try:
        return page.decode("utf-8")
    except UnicodeDecodeError:
        said = re.search(rb"charset=[\"']?([\w-]+)", page[:4096])
        try:
            return page.decode(said[1].decode() if said else "windows-1251", "replace")
        except LookupError:
            return page.decode("windows-1251", "replace")


def extract(page: str | bytes | None, profile: Profile) -> tuple[str | None, str | None, int, str | None]:
    """(title, text, characters of the page's text, error)."""
    reader = PageReader(profile)
    reader.feed(decode(page or ""))
    reader.finish()
    title = reader.titles.get("h1") or reader.titles.get("title")
    whole = len("".join(laid_out(reader.page.pieces).split()))
    text = reader.container()
    return title, text, whole, "no container" if text is None else None


def html_to_text(pages: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, title, text, body_chars, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for page_id, url, html in part[["page_id", "url", "html"]].itertuples(index=False):
                try:
                    rows.append((page_id, url, *extract(html, profile)))
                except Exception as e:  # one bad page must not stop the batch
                    rows.append((page_id, url, None, None, 0, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "text", "body_chars", "error"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string, body_chars int, error string")
