"""HTML extraction by layout: a tree with implied tags, then a rendering of all that is visible.

The tree builder closes what HTML closes by itself (paragraphs, list items, rows, cells, options, the head),
implies rows for cells that lack one, takes forms within tables as transparent, and puts what stands in a table but not in
a cell before it; it leaves the head, scripts, styles, templates and whatever is hidden (hidden, display:none,
visibility:hidden, closed details and dialogs) out of the text. The renderer keeps block spacing, numbers or dashes
and indents lists, keeps preformatted text, and aligns table cells in columns, with colspan and rowspan.

Nesting has no limit: builder and renderer keep their own stacks, and finding an open element by name takes a
binary search. Layout is bounded, text never: indents stop at MAX_INDENT, tables within over MAX_TABLES others come
as lines, and so do tables whose alignment would take over PADDING times their text.

Rows: null and empty pages give an empty text; repeated rows are rendered each; a null page_id is kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.encoding import pieces

MAX_INDENT, MAX_TABLES, PADDING = 80, 8, 8
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "iframe", "object", "svg", "canvas", "audio", "video", "datalist", "colgroup", "col"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "ul", "caption", "thead", "tbody", "tfoot", "tr"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hr"}
IN_HEAD = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
SECTIONS = {"thead", "tbody", "tfoot"}
PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
IN_TABLE = PARTS | {"script", "style", "template"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
#: An opening tag ends these open elements, looked for up to the given borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select"}),
}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """open is the path of open elements; at has the places on it by tag, blocks those of block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open, self.at, self.blocks = [self.root], {}, []

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node):
        self.at.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def cut(self, length: int):
        while len(self.open) > length:
            tag = self.open.pop().tag
            if self.at[tag] and self.at[tag][-1] == len(self.open):  # not so if its end tag has come
                self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end_up_to(self, tags, borders):
        """Close the outermost open element with one of the tags that no border encloses."""
        border, first = self.last(borders), 0
        for t in tags:
            places = self.at.get(t, [])
            k = bisect_right(places, border)
            if k < len(places) and (not first or places[k] < first):
                first = places[k]
        if first:
            self.cut(first)

    def in_table(self) -> int:
        """The place of the table that the current node belongs to directly, 0 if it is in none, in a cell or in a caption."""
        return self.at["table"][-1] if self.open[-1].tag in SECTIONS | {"table", "tr"} and self.at.get("table") else 0

    def add(self, child, allowed: bool):
        table = 0 if allowed else self.in_table()
        if table:  # what a table may not hold comes before it; the open table is its parent's last child
            self.open[table - 1].children.insert(-1, child)
        else:
            self.open[-1].children.append(child)

    def leave(self, tag):
        """Close what cannot hold a tag (None: text): the head, a column group."""
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.open) - 1)
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.cut(len(self.open) - 1)

    def table_part(self, tag):
        """Close all that is open within the table and cannot hold the part, and imply the row of a cell."""
        table = self.at["table"][-1]
        hosts = {"tr": SECTIONS, "td": SECTIONS | {"tr"}, "th": SECTIONS | {"tr"}}.get(tag, {"colgroup"} if tag == "col" else set())
        place = max(table, self.last(hosts))
        if tag == "tr" and self.last({"caption"}) > place:
            place = table
        self.cut(place + 1)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr", {})
            self.open[-1].children.append(row)
            self.push(row)

    def handle_starttag(self, tag, attrs):
        self.leave(tag)
        inside = bool(self.at.get("table"))
        if tag in PARTS and inside:
            self.table_part(tag)
        elif tag in BLOCK and tag not in ("option", "body", "html"):
            self.end_up_to({"p"}, {"td", "th", "caption", "table", "button"})
        if tag == "body":
            self.cut(self.last({"head"}) or len(self.open))
        if tag in IMPLIED:
            self.end_up_to(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        form = tag == "form" and self.in_table()
        self.add(node, tag in IN_TABLE or form)
        if tag not in VOID and not form:
            self.push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("path", "circle", "rect", "use", "g"):
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        place = self.last({tag})
        if not place or tag in ("body", "html"):
            return
        if tag in PARTS:
            border = self.last({"table"})
        elif tag == "table":
            border = 0
        else:
            border = self.last({"table", "td", "th", "caption"})
            inner = self.blocks[-1] if self.blocks else 0
            if tag in FORMATTING and border < place < inner:
                self.end_around(place)
                return
            if tag not in BLOCK:
                border = max(border, inner)
        if place > border:
            self.cut(place)

    def end_around(self, place: int):
        """The end tag of a formatting element stands within a block that began in it: the block stays open."""
        node = self.open[place]
        self.at[node.tag].pop()
        if not visible(node):  # what follows is shown: the blocks go on outside of it
            blocks = [n for n in self.open[place + 1 :] if n.tag in BLOCK]
            self.at[node.tag].append(place)
            self.cut(place)
            for n in blocks:
                again = Node(n.tag, n.attrs)
                self.open[-1].children.append(again)
                self.push(again)

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            self.leave(None)
            self.add(data, False)
        elif not self.in_table():
            self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and _HIDDEN.search(a["style"])))


class Page:
    """Lines under construction: text(), newline(), gap()."""

    def __init__(self):
        self.lines, self.line, self.blank, self.prefix = [], [], False, ""

    def text(self, s: str, pre: bool = False):
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.newline(True)
                if part:
                    self.line.append(part)
            return
        s = _SPACE.sub(" ", s)
        if s == " " or s[:1] == " ":
            if not self.line or self.line[-1][-1:] == " ":
                s = s[1:]
        if s:
            self.line.append(s)

    def newline(self, keep: bool = False):
        s = "".join(self.line).rstrip()
        if s or (keep and self.line):
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append(self.prefix + s)
            if self.prefix.strip():
                self.prefix = " " * len(self.prefix)
        elif keep:
            self.lines.append("")
        self.line = []

    def gap(self):
        self.newline()
        self.blank = True


def _rows(table: Node):
    """The rows of a table that are visible, header first and footer last as they are laid out, by section."""
    sections = {"thead": [], "tbody": [], "tfoot": []}
    loose = None
    for child in table.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag == "tr":
            if loose is None:
                loose = []
                sections["tbody"].append(loose)
            loose.append(child)
        elif child.tag in SECTIONS:
            loose = None
            sections[child.tag].append([x for x in child.children if not isinstance(x, str) and x.tag == "tr" and visible(x)])
    return [rows for tag in ("thead", "tbody", "tfoot") for rows in sections[tag] if rows]


def _number(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1").strip()
    return min(int(n), most) if n.isdecimal() and n.isascii() and len(n) < 9 else 1


def _cells(tr: Node):
    return [c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th") and visible(c)]


def _table(node: Node, page: Page, depth: int):
    """Rows of cells by column: a cell starts at the first column that no cell above still fills."""
    for child in node.children:
        if not isinstance(child, str) and child.tag == "caption" and visible(child):
            yield _render(child, page, False, depth)
            page.newline()
    grid = []  # rows: {column: lines}
    for rows in _rows(node):
        filled: list[tuple[int, int, int]] = []  # columns from, to and the row until which a cell above fills them
        for r, tr in enumerate(rows):
            filled = sorted(f for f in filled if f[2] > r)
            line, column, more = {}, 0, []
            for cell in _cells(tr):
                for a, b, _ in filled:
                    if a <= column < b:
                        column = b
                inner = Page()
                yield _render(cell, inner, False, depth + 1)
                inner.newline()
                line[column] = inner.lines
                wide, high = max(1, _number(cell, "colspan", 1000)), _number(cell, "rowspan", 65534) or len(rows)
                if high > 1:
                    until = min(len(rows), r + high)
                    if more and more[-1][1] == column and more[-1][2] == until:
                        more[-1] = (more[-1][0], column + wide, until)
                    else:
                        more.append((column, column + wide, until))
                column += wide
            filled += more
            grid.append({k: v for k, v in line.items() if v})
    width: dict[int, int] = {}
    for line in grid:
        for k, lines in line.items():
            width[k] = max(width.get(k, 0), max(map(len, lines)))
    starts, at = {}, 0
    for k in sorted(width):
        starts[k], at = at, at + width[k] + 2
    said = sum(len(x) for line in grid for lines in line.values() for x in lines)
    spent = sum(starts[max(line)] * max(map(len, line.values())) for line in grid if line)
    aligned = spent <= PADDING * said + 10_000
    for line in grid:
        for i in range(max(map(len, line.values()), default=0)):
            out, length = [], 0
            for k in sorted(line):
                if i < len(line[k]) and line[k][i]:
                    gap = starts[k] - length if aligned else 2 * bool(out)
                    out.append(" " * gap + line[k][i])
                    length += gap + len(line[k][i])
            page.text("".join(out), pre=True)
            page.newline()


def _flat_table(node: Node, page: Page, depth: int):
    for child in node.children:
        if not isinstance(child, str) and child.tag == "caption":
            yield _element(child, page, False, depth)
    for rows in _rows(node):
        for tr in rows:
            page.newline()
            for cell in _cells(tr):
                yield _render(cell, page, False, depth)
                page.text("  ", pre=bool(page.line))
    page.newline()


def _list(node: Node, page: Page, depth: int):
    start = node.attrs.get("start", "1")
    number, before = int(start) if start.isdecimal() and start.isascii() and len(start) < 10 else 1, page.prefix
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif child.tag == "li" and visible(child):
            page.newline()
            page.prefix = " " * min(MAX_INDENT, len(before)) + (f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            yield _render(child, page, False, depth)
            page.newline()
            page.prefix = before
        else:
            yield _element(child, page, False, depth)
    page.newline()
    page.prefix = before if not before.strip() else " " * len(before)


def _element(node: Node, page: Page, pre: bool, depth: int):
    if not visible(node):
        return
    tag = node.tag
    if tag == "br":
        page.newline(True) if page.line else page.newline()
        return
    if tag == "input":
        if node.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
            page.text(node.attrs.get("value", ""))
        return
    if tag in SPACED:
        page.gap()
    elif tag in BLOCK:
        page.newline()
    if tag == "table":
        yield _table(node, page, depth) if depth < MAX_TABLES else _flat_table(node, page, depth)
    elif tag in ("ul", "ol"):
        if page.prefix:  # a list within an item stays close
            page.blank = False
            yield _list(node, page, depth)
            return
        yield _list(node, page, depth)
    elif tag == "details" and "open" not in node.attrs:
        for child in node.children:
            if not isinstance(child, str) and child.tag == "summary":
                yield _element(child, page, pre, depth)
                break
    else:
        yield _render(node, page, pre or tag in ("pre", "textarea"), depth)
    if tag in SPACED:
        page.gap()
    elif tag in BLOCK:
        page.newline()
    elif tag in ("td", "th"):
        page.text(" ")


def _render(node: Node, page: Page, pre: bool, depth: int):
    for child in node.children:
        if isinstance(child, str):
            page.text(child, pre)
        else:
            yield _element(child, page, pre, depth)


def _run(step) -> None:
    """Run a step and, before it goes on, each step that it yields; the path is a list, so it may be of any length."""
    path = [step]
    while path:
        inner = next(path[-1], None)
        if inner is None:
            path.pop()
        else:
            path.append(inner)


def render(html: str | None) -> str:
    """The visible text of a page."""
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    page = Page()
    _run(_render(builder.root, page, False, 0))
    page.newline()
    return "\n".join(page.lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines): code points and lines of the visible text."""

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["page_id", "text"])

    out = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
