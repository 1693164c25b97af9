"""Text of web pages as a reader sees it: a tree builder with implied tags, visibility rules, and a renderer that keeps
blocks, lists and tables apart.

The tree: start tags close what they imply closed (a paragraph before a block, an item before the next item, a cell
before the next cell), end tags close up to their element, end tags without one are passed over, and all that is open
ends with the page. Tags are read in one pass by the attribute states of the HTML standard, so a quote inside an unquoted value
ends nothing, and a tag that the page ends in is no text. Not visible: comments, ``head`` and everything that never shows
(scripts, styles, templates, form options), elements with ``hidden`` or a style of ``display:none`` (the last declaration
counts, ``!important`` ones first), closed dialogs, and closed ``details`` but for their summary. ``visibility`` is inherited
until an element sets it anew; what it hides in a table leaves its cell empty. Rendering: white space is collapsed outside ``pre``
and ``textarea``; blocks begin on lines of their own, paragraphs, headings, lists and tables with an empty line between; items
have a mark or number and are indented by depth; the cells of a table are padded to the width of their columns, also those that
span several columns or rows, and what a table holds outside its cells comes before it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from functools import cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import new_name, slices

#: Elements by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("script style template head title meta link noscript iframe object audio video canvas desc metadata defs annotation annotation-xml datalist option optgroup noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED_BLOCKS = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "summary", "legend"} | {"li", "dd", "dt"}
#: A start tag ends an open element of these, unless one of the fences stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
_HEAD = set("base link meta noscript script style template title".split())
_FENCES = {"table", "td", "th", "caption", "button", "template", "html"}

#: Inputs whose value is not shown as text.
UNSEEN_INPUTS = set("hidden password checkbox radio file image color range".split())

_NAME = re.compile(r"[^ \t\n\f\r/>]+")
_KEY = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*")
_EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def tag_at(page: str, at: int) -> tuple[str, dict[str, str], int]:
    """Name, attributes (the first of each name) and end of the tag whose name begins at ``at``; end -1 if the page ends in it."""
    name = _NAME.match(page, at)
    attributes: dict[str, str] = {}
    at = name.end()
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page):
            return name.group().lower(), attributes, -1
        if page[at] == ">":
            return name.group().lower(), attributes, at + 1
        key = _KEY.match(page, at)
        value, at = "", key.end()
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at: at + 1]
            if quote in ("'", '"'):
                end = page.find(quote, at + 1)
                if end < 0:
                    return name.group().lower(), attributes, -1
                value, at = page[at + 1: end], end + 1
            else:
                found = _UNQUOTED.match(page, at)
                value, at = found.group(), found.end()
        attributes.setdefault(key.group().lower(), unescape(value) if "&" in value else value)


def tokens(page: str) -> Iterator[tuple[int, int, str, str, dict[str, str]]]:
    """Start, end, kind (text, start or end), name or text, and attributes of what a page holds between its texts, in order.

    Comments and declarations come as empty text. After a start tag of ``RAW`` its text and end tag are one more token.
    """
    at, size = 0, len(page)
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= size:
            return
        mark, letter = page[at + 1], page[at + 2: at + 3]
        if mark.isascii() and mark.isalpha():
            name, attributes, end = tag_at(page, at + 1)
            yield at, size if end < 0 else end, "start" if end >= 0 else "text", name if end >= 0 else "", attributes
            if end >= 0 and name in RAW:
                stop = _raw_end(name).search(page, end)
                close = tag_at(page, stop.start() + 2)[2] if stop else -1
                text = page[end: stop.start() if stop else size]
                yield end, size if close < 0 else close, "raw", text, {}
                end = close
        elif mark == "/" and letter.isascii() and letter.isalpha():
            name, _, end = tag_at(page, at + 2)
            yield at, size if end < 0 else end, "end" if end >= 0 else "text", name if end >= 0 else "", {}
        elif mark in "!?/":
            cdata = page.startswith("<![CDATA[", at)
            close = "-->" if page.startswith("<!--", at) else "]]>" if cdata else ">"
            found = page.find(close, at + 2 if close != "]]>" else at + 9)
            end = found + len(close) if found >= 0 else -1
            yield at, size if end < 0 else end, "text", page[at + 9: size if found < 0 else found] if cdata else "", {}
        else:
            at += 1
            continue
        if end < 0:
            return
        at = end


@cache
def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I)


def tree(page: str) -> Node:
    """The elements of a page. Children are nodes and texts; whatever the page holds, a tree comes out."""
    root = Node("html")
    open_ = [root]
    counts: dict[str, int] = {"html": 1}
    at, end = 0, len(page)

    def push(node: Node) -> None:
        open_[-1].children.append(node)
        open_.append(node)
        counts[node.name] = counts.get(node.name, 0) + 1

    def pop_to(depth: int) -> None:
        while len(open_) > depth:
            counts[open_.pop().name] -= 1

    def close(names: set[str], fences: set[str]) -> None:
        if not any(counts.get(n) for n in names):
            return
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].name in names:
                # an item within an item: the outermost up to the fence ends
                low = depth
                while low - 1 > 0 and open_[low - 1].name not in fences:
                    low -= 1
                first = next(k for k in range(low, depth + 1) if open_[k].name in names)
                pop_to(first)
                return
            if open_[depth].name in fences:
                return

    raw_of = root
    for start, stop, kind, tag, attributes in tokens(page):
        if start > at:
            open_[-1].children.append(unescape(page[at: start]))
        at = stop
        if kind == "text":
            if tag:
                open_[-1].children.append(tag)
            continue
        if kind == "raw":
            raw_of.children.append(unescape(tag) if raw_of.name in {"textarea", "title"} else tag)
            continue
        if kind == "end":
            if tag == "p" and not counts.get("p"):
                open_[-1].children.append(Node("p"))
            if tag == "br":
                open_[-1].children.append(Node("br"))
            if counts.get(tag) and tag != "html":
                fences = {"table"} if tag not in {"table", "body"} else set()
                for depth in range(len(open_) - 1, 0, -1):
                    if open_[depth].name == tag:
                        pop_to(depth)
                        break
                    if open_[depth].name in fences:
                        break
            continue
        if tag == "html":
            continue
        if counts.get("head") and tag not in _HEAD and open_[-1].name == "head":
            pop_to(len(open_) - 1)
        if tag in CLOSES_P and counts.get("p"):
            close({"p"}, _FENCES)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in {"td", "th"} and counts.get("table") and open_[-1].name in {"table", "tbody", "thead", "tfoot"}:
            push(Node("tr"))
        node = Node(tag, attributes)
        if tag in VOID:
            open_[-1].children.append(node)
        elif tag in RAW:
            open_[-1].children.append(node)
            raw_of = node
        else:
            push(node)
    if at < end:
        open_[-1].children.append(unescape(page[at:]))
    return root


def styles(text: str) -> dict[str, str]:
    """The declarations of a style attribute that hold: the last of each property, important ones before others."""
    plain, important = {}, {}
    for part in text.lower().split(";"):
        key, colon, value = part.partition(":")
        value = value.strip()
        if colon and value:
            if value.endswith("important") and value[:-9].rstrip().endswith("!"):
                important[key.strip()] = value[:-9].rstrip()[:-1].rstrip()
            else:
                plain[key.strip()] = value
    return plain | important


def hidden(node: Node) -> bool:
    """Is the element, with all it holds, left out of the page?"""
    a = node.attributes
    if node.name in UNSEEN or node.name == "dialog" and "open" not in a or node.name == "input" and a.get("type", "").lower().strip() in UNSEEN_INPUTS:
        return True
    display = styles(a["style"]).get("display") if "style" in a else None
    return display == "none" if display else "hidden" in a


def seen(node: Node, inherited: bool) -> bool:
    """Does the element's own text show, by its ``visibility`` or that of what it is in?"""
    value = styles(node.attributes["style"]).get("visibility") if "style" in node.attributes else None
    return {"visible": True, "hidden": False, "collapse": False}.get(value, inherited)


class Lines:
    """Text under construction: lines, and how many line ends must come before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space = "", 0, False

    def text(self, text: str) -> None:
        body = _SPACE.sub(" ", text)
        if body[:1] == " ":
            self.space = True
        words = body.strip(" ")
        if not words:
            return
        if self.space and self.line:
            self.line += " "
        self.line += words
        self.space = body[-1:] == " "

    def verbatim(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.line += first
        for x in rest:
            self.end_line(True)
            self.line = x

    def end_line(self, always: bool = False) -> None:
        if self.line.strip() or always:
            if self.gap > 1 and self.lines and self.lines[-1].strip():
                self.lines.append("")
            self.lines.append(self.line.rstrip())
            self.gap = 0
        self.line, self.space = "", False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.gap > 1 and self.lines and self.lines[-1].strip():
                self.lines.append("")
            self.lines += lines
            self.gap = 0

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def table_parts(table: Node) -> tuple[Node, list[Node], list[list[Node]]]:
    """What a table shows before it, its captions, and the cells of each row.

    Other elements within a table but outside its cells (forms, blocks, wrappers of any depth) are passed through: rows,
    cells and captions in them belong to the table, also if the element itself is hidden, and what else they hold comes
    before the table, as does text outside cells. A cell without a row begins one.
    """
    before, captions, rows = Node("div"), [], []
    stack = [(iter(table.children), before, False, [None])]  # children, where the rest goes, inside a tr, the open row
    while stack:
        children, rest, in_row, row = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            rest.children.append(child)
        elif child.name in {"tr", "tbody", "thead", "tfoot", "td", "th", "caption", "colgroup"}:
            if hidden(child):
                continue
            if child.name == "caption":
                captions.append(child)
            elif child.name in {"td", "th"}:
                if row[0] is None:
                    row[0] = []
                    rows.append(row[0])
                row[0].append(child)
            else:
                if not in_row:
                    row[0] = None
                own = [[]] if child.name == "tr" else [None]
                if child.name == "tr":
                    rows.append(own[0])
                stack.append((iter(child.children), rest, child.name == "tr", own))
        elif child.name == "table" or child.name in VOID or child.name in RAW:
            rest.children.append(child)
        elif child.name not in UNSEEN:
            shell = Node(child.name, child.attributes)
            rest.children.append(shell)
            stack.append((iter(child.children), shell, in_row, row))
    return before, captions, rows


#: A step of rendering: a generator that yields the steps it needs and returns its lines.
Step = Generator["Step", "list[str] | None", "list[str] | None"]

#: Lists, definitions and tables nested deeper within each other than this are neither indented nor aligned further, as the
#: text of a page of many levels would grow with their square. Their text, marks and visibility are as everywhere.
INDENTED = 150


def span(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "1").strip()
    return min(most, int(text)) if re.fullmatch(r"\d{1,9}", text) else 1


def grid_places(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """First column and column after the last of each cell, numbered by the columns in which any cell begins.

    Cells that reach down from rows above keep their columns; a row span of 0 reaches to the end. Spans are at most 1000 columns.
    """
    places, reaching = [], []  # reaching: first column, column after the last, row after the last, ascending
    for k, row in enumerate(rows):
        reaching = [x for x in reaching if x[2] > k]
        column, at, own, more = 0, 0, [], []
        for cell in row:
            while at < len(reaching) and reaching[at][0] <= column:
                column = max(column, reaching[at][1])
                at += 1
            wide, deep = max(1, span(cell, "colspan", 1000)), span(cell, "rowspan", 65534) or len(rows)
            own.append((column, column + wide))
            if deep > 1:
                more.append((column, column + wide, k + deep))
            column += wide
        if more:
            reaching = sorted(reaching + more)
        places.append(own)
    starts = sorted({a for own in places for a, _ in own})
    return [[(bisect_left(starts, a), bisect_left(starts, b)) for a, b in own] for own in places]


def table_lines(table: Node, level: int, shown: bool) -> Step:
    """Cells padded to the width of their columns, two blanks between columns; a cell of several lines takes several."""
    before, captions, rows = table_parts(table)
    out = yield rendered(before, level, shown)
    if out:
        out.append("")
    for child in captions:
        out += yield rendered(child, level, shown)
    grid = []
    for row in rows:
        cells = []
        for cell in row:
            cells.append((yield rendered(cell, level, shown)))
        grid.append(cells)
    if level > INDENTED:
        for row in grid:
            for cell in row:
                out += cell
        return out
    places = grid_places(rows)
    width = [0] * max((b for own in places for _, b in own), default=0)
    wide = []
    for row, own in zip(grid, places, strict=True):
        for cell, (a, b) in zip(row, own, strict=True):
            size = max(map(len, cell), default=0)
            if b - a == 1:
                width[a] = max(width[a], size)
            else:
                wide.append((b - a, a, b, size))
    for _, a, b, size in sorted(wide):  # the last column of a span takes what the others leave
        width[b - 1] = max(width[b - 1], size - sum(width[a: b - 1]) - 2 * (b - a - 1))
    left = [0, *accumulate(x + 2 for x in width)]
    for row, own in zip(grid, places, strict=True):
        for k in range(max((len(cell) for cell in row), default=0)):
            line = ""
            for cell, (a, _) in zip(row, own, strict=True):
                if k < len(cell) and cell[k]:
                    line = line.ljust(left[a]) + cell[k]
            out.append(line.rstrip())
    return [x for x in out if x] if not any(out) else out


def run(step: Step) -> list[str] | None:
    """The result of a step. Open steps are kept in a list, so pages may be nested to any depth."""
    open_, value = [step], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as end:
            open_.pop()
            value = end.value
    return value


def rendered(node: Node, level: int = 0, shown: bool = True) -> Step:
    lines = Lines()
    yield _render(node, lines, level, False, shown)
    return lines.done()


def _render(node: Node, lines: Lines, level: int, verbatim: bool, shown: bool) -> Step:
    shown = seen(node, shown)
    seen_summary = False
    number = None
    if node.name == "ol":
        start = node.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if node.name == "details" and "open" not in node.attributes and (isinstance(child, str) or child.name != "summary" or seen_summary):
            continue
        if isinstance(child, str):
            if shown:
                lines.verbatim(child) if verbatim else lines.text(child)
            continue
        seen_summary |= child.name == "summary"
        if hidden(child):
            continue
        name = child.name
        if name == "br":
            lines.end_line(True)
        elif name == "wbr":
            continue
        elif name == "hr":
            lines.block(2)
        elif name == "input":
            if seen(child, shown):
                lines.text(f" {child.attributes.get('value', '')} ")
        elif name == "table":
            lines.block(2)
            lines.add((yield table_lines(child, level + 1, seen(child, shown))))
            lines.block(2)
        elif name == "li":
            lines.block(1)
            if node.name == "ol":
                own = child.attributes.get("value", "")
                number = int(own) if re.fullmatch(r"-?\d{1,9}", own) else number
                mark = f"{number}. "
                number += 1
            else:
                mark = "- "
            inner = yield rendered(child, level + 1, shown)
            if level < INDENTED:
                inner[1:] = [" " * len(mark) + x if x else x for x in inner[1:]]
            inner[:1] = [mark + x for x in inner[:1]]
            lines.add(inner)
            lines.block(1)
        elif name in {"ul", "ol", "menu", "dir"} and node.name == "li":
            lines.block(1)
            yield _render(child, lines, level, verbatim, shown)
            lines.block(1)
        elif name == "dd":
            lines.block(1)
            inner = yield rendered(child, level + 1, shown)
            lines.add(["    " + x if x else x for x in inner] if level < INDENTED else inner)
            lines.block(1)
        elif name in {"pre", "textarea"}:
            lines.block(2 if name == "pre" else 1)
            yield _render(child, lines, level, True, shown)
            lines.block(2 if name == "pre" else 1)
        elif name in {"td", "th", "text"}:  # outside a table; in a drawing
            lines.text(" ")
            yield _render(child, lines, level, verbatim, shown)
            lines.text(" ")
        elif name in BLOCKS or name == "tr":
            gap = 2 if name in SPACED_BLOCKS else 1
            lines.block(gap)
            yield _render(child, lines, level, verbatim, shown)
            lines.block(gap)
        else:
            yield _render(child, lines, level, verbatim, shown)


def visible_text(page: str | None) -> str:
    """The text of a page, as lines; empty for null, empty or textless pages."""
    return "\n".join(run(rendered(tree(page)))) if page else ""


def extract_text(pages: DataFrame, *, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with one more column, and its name: the visible text. Rows are independent; all other columns stay as they are."""
    out = new_name("visible_text", pages.columns)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = [visible_text(x) for x in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(each, schema), out


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, text, n_chars, n_lines."""
    found, out = extract_text(pages.select("page_id", "html"))
    return found.select("page_id", F.col(out).alias("text"), F.length(out).cast("long").alias("n_chars"),
                        F.expr(f"cast(if({out} = '', 0, size(split({out}, '\\n'))) as long)").alias("n_lines"))
