"""Layout-aware rendering of HTML pages to text.

A tree is built from the page's tags with the usual implied ends (a block closes an
open paragraph, list items, table cells and rows close their predecessors) and void
elements.  Elements that a browser does not show (scripts, styles, templates, hidden
or ``display:none`` ones, the head) are left out; ``visibility`` is inherited, and a
visible element inside an invisible one is emitted.  Everything else is emitted, formulas,
the text of drawings, text areas and the chosen options of a selection too:
blocks stand on lines of their own, paragraphs and headings apart by a blank line,
``br`` breaks the line, list items are indented and marked by ``-`` or their number,
preformatted text keeps its spaces, and a table's cells are padded so that columns
stand under each other, cells beside those that reach down from rows above included.
A page is read by a cursor, in time linear in its length.

Defined cases: null or empty HTML gives empty text; text outside any tag is visible;
unclosed elements end with the page, stray end tags are ignored; a ``<`` that opens no tag
is text; a tag in which the page ends is dropped, with what it swallows; spans count up
to the standard's largest ones (1000 columns, 65534 rows), a list's start below 2**31; depth is not limited (no recursion); repeated pages give repeated rows;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, slices

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = frozenset("""script style template noscript head title meta link iframe object
    noembed noframes canvas audio video datalist param area base""".split())
# Of drawings and formulas: not drawn by themselves; where HTML goes on; HTML tags that end them.
FOREIGN_UNSHOWN = frozenset("""desc metadata defs symbol clippath mask pattern marker filter
    lineargradient radialgradient annotation annotation-xml mphantom""".split())
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6
    head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table
    tt u ul var""".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl
    dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main
    menu nav ol optgroup option p pre search section summary table ul caption thead tbody tfoot
    tr td th""".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
# An opening tag ends these open elements, not looking past the listed bounds.
_CELL, _ROW = frozenset(("td", "th")), frozenset(("tr",))
_TABLE = frozenset(("table",))
_LISTS = frozenset("ul ol menu dir".split())
IMPLIED = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELL, _TABLE | _ROW), "th": (_CELL, _TABLE | _ROW),
    "tr": (_CELL | _ROW, _TABLE), "option": (frozenset(("option",)), frozenset(("select",))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "thead": (_CELL | _ROW | {"thead", "tbody", "tfoot"}, _TABLE),
    "tbody": (_CELL | _ROW | {"thead", "tbody", "tfoot"}, _TABLE),
    "tfoot": (_CELL | _ROW | {"thead", "tbody", "tfoot"}, _TABLE),
    "body": (frozenset(("head",)), frozenset()),
}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption",
                    "option", "optgroup", "legend"}
SCOPE = frozenset("table td th caption button html template object".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
# One attribute from a cursor on: quotes count only where a value begins.
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|"
                   r"(?![\"'])([^\s>]*+)|([\"'])))?")
_TAG_END = re.compile(r"[\s/]*+>")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
# The standard's largest spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; ``children`` holds nodes and strings in order.  ``space`` is svg, text
    (below a drawing's text element), math or empty; ``seen`` its visibility."""

    __slots__ = ("tag", "attrs", "children", "space", "seen")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.space = _space(tag, parent) if parent else ""
        self.see(parent is None or parent.seen)

    def see(self, inherited: bool) -> None:
        own = _VISIBILITY.findall(self.attrs["style"]) if "style" in self.attrs else ()
        self.seen = own[-1].lower() in ("visible", "initial") if own else inherited

    def add(self, text: str) -> None:
        """Text directly inside; a drawing shows only that of its text elements."""
        if self.seen and (self.space != "svg" or self.tag == "foreignobject"):
            self.children.append(text)

    def shown(self) -> bool:
        a = self.attrs
        if (self.tag in UNSHOWN or self.space and self.tag in FOREIGN_UNSHOWN
                or self.tag == "dialog" and "open" not in a):
            return False
        if not a:
            return True
        return not ("hidden" in a or self.tag == "input" and a.get("type", "").lower() == "hidden"
                    or "style" in a and _HIDDEN_STYLE.search(a["style"]))


def _space(tag: str, parent: Node) -> str:
    if tag in ("svg", "math"):
        return tag
    if parent.tag in INTEGRATION:
        return ""
    return "text" if parent.space == "svg" and tag == "text" else parent.space


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("html", {})
    open_ = _Open(root)
    at = 0
    while match := _TAG.search(page, at):
        if match.start() > at:
            open_.top.add(html.unescape(page[at:match.start()]))
        at = match.end()
        if not match[2]:
            mark = "-->" if match[3] else ">"
            end = page.find(mark, at)
            at = end + len(mark) if end >= 0 else len(page)
            continue
        tag = match[2].lower()
        attrs, closed, at = _attributes(page, at)
        if at < 0:
            return root                     # the page ends inside this tag
        if match[1]:
            open_.close(tag)
            continue
        if tag == "html" or tag == "body" and open_.has("body"):
            root.attrs.update(attrs if tag == "html" else {})
            root.see(True)
            continue
        if tag in BREAKOUT and open_.top.tag not in INTEGRATION:
            while open_.top.space:
                open_.cut(len(open_.nodes) - 1)
        open_.imply(tag)
        node = Node(tag, attrs, open_.top)
        open_.top.children.append(node)
        if tag in VOID or node.space and closed:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(page, at)
            raw = page[at:end.start()]
            node.add(html.unescape(raw).removeprefix("\n") if tag == "textarea" else raw)
            after = page.find(">", end.end())
            at = after + 1 if after >= 0 else len(page)
            continue
        open_.push(node)
    if at < len(page):
        open_.top.add(html.unescape(page[at:]))
    return root


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes from ``at`` on, whether a slash ends the tag, and where the page goes on
    behind it; -1 if the page ends before the tag does."""
    attrs: dict[str, str] = {}
    while not (end := _TAG_END.match(page, at)):
        one = _ATTR.match(page, at)
        if not one or one[5]:
            return attrs, False, -1
        value = one[2] or one[3] or one[4] or ""
        attrs.setdefault(one[1].lower(), html.unescape(value))
        at = one.end()
    return attrs, page[end.end() - 2] == "/", end.end()


class _Open:
    """The open elements, with the places of each tag: no step looks through them all."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, first: int) -> None:
        """End the elements from a place on."""
        while len(self.nodes) > first:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def close(self, tag: str) -> None:
        place = self._last(tag)
        hidden = tag not in SCOPE and tag not in BLOCK and self.scopes and self.scopes[-1] > place
        if place and not hidden:
            self.cut(place)

    def imply(self, tag: str) -> None:
        if tag in CLOSES_P and (place := self._last("p")) > (self.scopes[-1] if self.scopes else 0):
            self.cut(place)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            bound = max(map(self._last, bounds), default=0)
            found = [places[i] for end in ends if (places := self.places.get(end))
                     and (i := bisect_right(places, bound)) < len(places)]
            if found:
                self.cut(min(found))


class _Out:
    """Lines being written; ``gap`` is the number of line ends owed before more text."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap, self.breaks, self.space, self.indent, self.mark = 0, 0, False, "", ""

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def line(self) -> None:
        """A forced line end; at the end of a block it adds nothing."""
        self.breaks += 1
        self.space = False

    def _start(self) -> None:
        if self.gap or self.breaks or self.mark or not self.parts:
            if self.parts:
                self.parts.append("\n" * max(self.gap, self.breaks, 1))
            self.parts.append(self.indent[:len(self.indent) - len(self.mark)] + self.mark)
            self.gap, self.breaks, self.space, self.mark = 0, 0, False, ""

    def text(self, text: str) -> None:
        """Text in which runs of white space count as one space."""
        plain = _SPACE.sub(" ", text)
        if plain[:1] == " ":
            self.space = True
            plain = plain[1:]
        if not plain:
            return
        self._start()
        if self.space and self.parts and not self.parts[-1].endswith((" ", "\n")):
            self.parts.append(" ")
        self.space = plain[-1] == " "
        self.parts.append(plain.rstrip(" "))

    def verbatim(self, text: str) -> None:
        if text:
            self._start()
            self.parts.append(text.replace("\n", "\n" + self.indent))
            self.space = False

    def result(self) -> str:
        lines = "".join(self.parts).split("\n")
        return "\n".join(line.rstrip() for line in lines).strip("\n")


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else
               2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _whole(text: str, most: int) -> int | None:
    """A whole number written in digits, ``most`` at most; null for other text."""
    text = text.strip(" \t\n\r\f")
    if not text.isascii() or not text.isdigit():
        return None
    digits = text.lstrip("0")
    return most if len(digits) > 10 else min(int(digits or "0"), most)


def _columns(rows: list[list[tuple]]) -> list[list[str]]:
    """Cells (text, colspan, rowspan) of a table's rows on their columns: a cell moves right of
    those that reach down from rows above.  Columns in which no cell begins take no space."""
    placed, reach = [], {}              # column -> rows that a cell still reaches down
    for row in rows:
        line, column, below = [], 0, {}
        for text, wide, deep in row:
            while reach.get(column):
                column += 1
            line.append((column, text))
            if deep > 1:
                below.update(dict.fromkeys(range(column, column + wide), deep - 1))
            column += wide
        reach = {c: n - 1 for c, n in reach.items() if n > 1} | below
        placed.append(line)
    number = {c: i for i, c in enumerate(sorted({c for line in placed for c, _ in line}))}
    out = []
    for line in placed:
        cells: list[str] = []
        for column, text in line:
            cells.extend([""] * (number[column] - len(cells)))
            cells.append(text)
        out.append(cells)
    return out


def _pad(rows: list[list[str]]) -> list[str]:
    """Cells under each other; a cell's further lines take further lines of the row."""
    lines: list[list[str]] = []
    for row in rows:
        cells = [c.split("\n") for c in row]
        for i in range(max(map(len, cells), default=0)):
            lines.append([c[i] if i < len(c) else "" for c in cells])
    widths = [0] * max(map(len, lines), default=0)
    for line in lines:
        for i, cell in enumerate(line[:-1]):
            widths[i] = max(widths[i], _width(cell))
    return ["  ".join(c + " " * (max(0, w - _width(c))) for c, w in zip(line, widths)).rstrip()
            for line in lines]


def render(root: Node) -> str:
    """All visible text of the tree.  Work is kept on a list instead of the call stack:
    entries are nodes or strings to write, or steps to take when an element ends."""
    out = _Out()
    work: list = [(root, out, False)]
    tables: list[list[list[tuple]]] = []    # rows of (cell, colspan, rowspan) of the open tables

    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, to, pre = item
        if isinstance(node, str):
            to.verbatim(node) if pre else to.text(node)
            continue
        if not node.shown():
            continue
        tag = node.tag
        if tag == "br":
            to.line()
        elif tag == "hr":
            to.block(2)
        elif tag == "img":
            if node.seen and (alt := node.attrs.get("alt", "").strip()):
                to.text(alt)
        elif tag == "textarea":
            to.block(1)
            to.verbatim("".join(node.children))
            to.block(1)
        elif tag == "select":
            _select(node, to)
        elif node.space == "math" and tag in ("mfrac", "mtd"):
            parts = [part for child in node.children for part in (" ", child)]
            work.extend((part, to, False) for part in reversed([*parts, " "]))
        elif tag == "table":
            rows: list[list[tuple]] = []

            def end(rows=rows, to=to):
                tables.pop()
                to.block(2)
                for line in _pad(_columns([[(c.result(), *span) for c, *span in row] for row in rows])):
                    if line:
                        to.verbatim(line)
                        to.block(1)
                to.block(2)

            tables.append(rows)
            work.append(end)
            _children(work, node, to, pre)
        elif tag == "tr" and tables:
            tables[-1].append([])
            _children(work, node, to, pre)
        elif tag in _CELL and tables:
            cell = _Out()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, _whole(node.attrs.get("colspan", "1"), MOST_COLUMNS) or 1,
                                   _whole(node.attrs.get("rowspan", "1"), MOST_ROWS) or 1))
            _children(work, node, cell, pre)
        elif tag in BLOCK or tag == node.space == "text" or tag == "mtr":
            _block(work, node, to, pre)
        else:
            _children(work, node, to, pre)
    return out.result()


def _children(work: list, node: Node, to: _Out, pre: bool) -> None:
    work.extend((child, to, pre) for child in reversed(node.children))


def _block(work: list, node: Node, to: _Out, pre: bool) -> None:
    tag = node.tag
    nested = tag in _LISTS and to.indent
    gap = 1 if nested or tag not in APART else 2
    to.block(gap)
    before = to.indent

    def end():
        to.indent = before
        to.mark = ""
        to.block(gap)

    work.append(end)
    if tag in _LISTS:
        start = node.attrs.get("start", "1")
        number = _whole(start, 1 << 31)
        number = 1 if number is None or number == 1 << 31 else number
        entries: list = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                if child.shown():
                    mark = "" if not child.seen else f"{number}. " if tag == "ol" else "- "
                    number += 1
                    entries.append((child, mark))
            else:
                entries.append((child, None))
        for child, mark in reversed(entries):
            if mark is None:
                work.append((child, to, pre))
            else:
                work.extend(reversed(_item(child, mark, to, pre)))
        return
    if tag in ("blockquote", "dd"):
        to.indent = before + "  "
    _children(work, node, to, pre or tag == "pre")


def _select(node: Node, to: _Out) -> None:
    """The chosen option of a selection, the first if none is; all options of one that
    shows a list."""
    options: list[tuple[Node, str, bool, bool]] = []     # node, label, can be chosen, listed
    work = [(child, False, node.shown()) for child in reversed(node.children)]
    while work:
        child, disabled, listed = work.pop()
        if isinstance(child, str):
            continue
        disabled = disabled or "disabled" in child.attrs
        listed = listed and child.shown()
        if child.tag == "option":
            label = child.attrs.get("label") or _SPACE.sub(" ", _inner(child)).strip(" ")
            options.append((child, label if child.seen else "", not disabled, listed))
            continue
        if child.tag == "optgroup" and child.seen:
            options.append((child, child.attrs.get("label", ""), False, listed))
        work.extend((c, disabled, listed) for c in reversed(child.children))
    size = node.attrs.get("size", "")
    if "multiple" in node.attrs or (_whole(size, 2) or 0) > 1:
        for _, label, _, listed in options:
            if listed:
                to.block(1)
                to.text(label)
                to.block(1)
        return
    chosen = [label for n, label, _, _ in options if n.tag == "option" and "selected" in n.attrs]
    first = [label for n, label, can, _ in options if n.tag == "option" and can]
    if node.seen and (label := chosen[-1] if chosen else first[0] if first else ""):
        to.text(f" {label} ")


def _inner(node: Node) -> str:
    """The text inside a node."""
    out, work = [], [node]
    while work:
        item = work.pop()
        if isinstance(item, str):
            out.append(item)
        elif item is node or item.shown():
            work.extend(reversed(item.children))
    return "".join(out)


def _item(node: Node, mark: str, to: _Out, pre: bool) -> list:
    """Steps for one list item: its mark stands before its first text, further lines
    under that text."""

    def enter():
        to.block(1)
        to.indent += " " * len(mark)
        to.mark += mark

    def leave():
        to.indent = to.indent[:len(to.indent) - len(mark)]
        to.mark = to.mark.removesuffix(mark)
        to.block(1)

    return [enter, *((child, to, pre) for child in node.children), leave]


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                   ("n_chars", pa.int64()), ("n_lines", pa.int64()),
                   ("text_sha256", pa.string())])
_TEXT_DDL = ("page_id long, url string, text string, n_chars long, n_lines long, "
             "text_sha256 string")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines, text_sha256."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for page_id, url, page in rows_of(batches, "page_id", "url", "html"):
                text = page_text(page)
                yield (page_id, url, text, len(text), text.count("\n") + 1 if text else 0,
                       hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())

        yield from slices(rows(), _TEXT)

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), extract, _TEXT_DDL)
