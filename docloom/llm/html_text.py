"""Text of web pages as a reader would see it: a tree with implied tags, then a layout of its boxes.

The tree builder closes and opens tags as HTML allows them to be left out (paragraphs before blocks, list
items, rows, cells, options, terms), ignores end tags without a start, and closes what is open at the end.
The renderer leaves out what is not shown (scripts, styles, heads, templates, ``hidden`` elements, inline
``display: none`` and ``visibility: hidden``, hidden inputs, comments; of svg all but the text in ``text``
and ``foreignObject``), shows the options of a list line by line, collapses white space outside
``pre`` and ``textarea``, and sets text in blocks: a blank line around paragraphs, headings, lists, tables
and other spaced blocks, a new line around other blocks, markers and indents for list items, and table
cells padded to their columns' widths, with `` | `` between columns. A cell that spans columns takes their
widths together, empty cells at a row's end are left out, and cells of more than ``WIDEST`` characters
do not widen their column, so that padding follows the number of cells.

Defined results: null, empty and invisible pages give an empty text; unclosed comments, tags and raw
text run to the end of the page; a quote in a tag counts only where a value starts; unknown tags are inline; a page that repeats gives as many rows; other
columns are ignored; an empty table gives an empty table. cells outside a table are blocks; colspan and rowspan
go to ``MOST_COLUMNS`` and ``MOST_ROWS``. Pages are walked without recursion, so depth is not limited;
open elements are found by their tags, so time follows a page's length; memory follows one page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.llm._words import batches
from docloom.session import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style head title template noscript iframe object canvas audio video datalist annotation annotation-xml".split())
#: Within svg: what is not drawn, and what holds text.
SVG_UNSEEN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
SVG_TEXT = frozenset(("text", "foreignobject"))
#: Inputs that show no value as text.
NO_VALUE = frozenset("hidden checkbox radio file color range image password".split())
RAW = frozenset("script style textarea title xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd figcaption details summary center legend caption tr thead tbody tfoot option optgroup textarea".split())
#: A start tag of the key closes an open element of these ...
CLOSES = {
    **{t: {"p"} for t in BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "option", "optgroup", "caption"}},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "p", "caption"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "thead": {"thead", "tbody", "tr", "td", "th", "p", "caption"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p", "caption"},
    "tfoot": {"thead", "tbody", "tr", "td", "th", "p", "caption"},
    "body": {"head", "title"},
}
#: ... unless one of these stands between.
FENCES = {
    "li": {"ul", "ol", "table"},
    "dt": {"dl", "table"},
    "dd": {"dl", "table"},
    "p": {"table", "td", "th", "button", "object"},
    **{t: {"table"} for t in ("tr", "td", "th", "thead", "tbody", "tfoot")},
}
_OTHER_FENCE = frozenset(("table", "td", "th", "button", "object"))
#: A start tag of these closes one element of CLOSES and the paragraphs in it.
_CLOSE_ONE = frozenset("li dt dd td th option".split())
#: End tags that reach out of a cell.
_ROWS = frozenset("tr tbody thead tfoot table".split())
#: Widest cell that others are padded to, greatest colspan and rowspan (as browsers have it).
WIDEST, MOST_COLUMNS, MOST_ROWS = 120, 1000, 65534
_BLANK = r"[ \t\n\r\x0c]"
#: A quote opens a value only directly after "=" and white space; elsewhere it is a character like others.
_VALUE = rf"{_BLANK}*+=(?:{_BLANK}*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^ \t\n\r\x0c>]*+)))?+"
_ATTRIBUTE = re.compile(rf"([^ \t\n\r\x0c/>][^ \t\n\r\x0c/>=]*+)(?:{_VALUE})?+")
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\r\x0c/>]*+)((?:[ \t\n\r\x0c/]++|{re.sub(r'\((?=\[)', '(?:', _ATTRIBUTE.pattern)})*+)(?:>|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\x0c]+")
_INTEGER = re.compile(r"[ \t\n\r\x0c]*([+-]?)([0-9]+)")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The page's tree; text is a str child."""
    root = Node("#root", {})
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # of open elements, by tag

    def text(piece: str) -> None:
        if piece:
            open_[-1].children.append(html.unescape(piece))

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(open_))
        open_.append(node)

    def close_from(place: int) -> None:
        while len(open_) > place:
            places[open_.pop().tag].pop()

    def innermost(tags) -> int:
        """The place of the last open element of these tags; 0 without one."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_for(tag: str) -> None:
        closed = CLOSES.get(tag)
        if not closed:
            return
        while (place := innermost(closed)) > innermost(FENCES.get(tag, _OTHER_FENCE) - closed):
            t = open_[place].tag
            close_from(place)
            if tag in _CLOSE_ONE and t != "p" or t == "p" and len(closed) == 1:
                return

    def start(tag: str, attributes: dict[str, str], closed: bool = False) -> None:
        close_for(tag)
        if tag in ("td", "th") and open_[-1].tag != "tr":  # a cell needs a row about it
            start("tr", {})
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID and not closed:
            push(node)

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            fence = innermost(("table",) if tag in _ROWS else ("table", "td", "th"))
            if (place := innermost((tag,))) and (place >= fence or tag == "table"):
                close_from(place)
            elif tag == "p" and not fence:  # as browsers do, an empty paragraph
                open_[-1].children.append(Node("p", {}))
            elif tag == "br":
                open_[-1].children.append(Node("br", {}))
            continue
        # "/>" closes elements of svg and math only.
        closed = page[m.end() - 2 : m.end()] == "/>" and m[3].endswith("/") and bool(places.get("svg") or places.get("math"))
        start(tag, _attributes(m[3]), closed)
        if tag in RAW and tag not in VOID and not closed:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            body = page[at : end.start()]
            open_[-1].children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            close_from(len(open_) - 1)
            at = end.end()
    text(page[at:])
    return root


def is_hidden(node: Node) -> bool:
    a = node.attributes
    return node.tag in UNSEEN or "hidden" in a or bool(_HIDDEN.search(a.get("style", ""))) or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a


class _Lines:
    """Text in lines; blank lines and new lines are asked for and set before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.blank = False
        self.space = False
        self.marker = ""
        self.indent = 0

    def end_line(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.space = False
        self.blank |= blank

    def _begin(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line = " " * max(0, self.indent - len(self.marker)) + self.marker
            self.marker = ""

    def words(self, piece: str) -> None:
        flat = _SPACE.sub(" ", piece)
        if flat == " " or not flat:
            self.space |= bool(flat) and bool(self.line)
            return
        if flat[0] == " " and self.line:
            self.space = True
        body = flat.strip(" ")
        fresh = not self.line
        self._begin()
        self.line += (" " if self.space and not fresh else "") + body
        self.space = flat[-1] == " "

    def kept(self, piece: str) -> None:
        """Text whose white space stays."""
        for i, part in enumerate(piece.split("\n")):
            if i:
                self._begin()
                self.lines.append(self.line.rstrip())
                self.line = ""
            if part:
                self._begin()
                self.line += part.expandtabs()

    def block(self, lines: list[str]) -> None:
        self.end_line(True)
        for x in lines:
            self._begin()
            self.line += x
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.end_line(True)

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _number(value: str, least: int, most: int, other: int) -> int:
    """A whole number of an attribute, held between bounds; ``other`` if it is none."""
    m = _INTEGER.match(value)
    if not m:
        return other
    digits = m[2].lstrip("0") or "0"
    n = int(digits) if len(digits) <= 10 else 10**10
    return min(most, max(least, -n if m[1] == "-" else n))


def _span(node: Node, name: str, most: int) -> int:
    return _number(node.attributes.get(name, "1"), 1, most, 1)


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table from (text, columns, rows) cells; a cell that spans rows stands at its first."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # first and last column, and rows below, of cells from above
    for row in rows:
        line, below, at, i = [], [(a, b, n - 1) for a, b, n in taken if n > 1], 0, 0
        for text, columns, deep in row:
            while i < len(taken) and taken[i][0] <= at:
                at = max(at, taken[i][1])
                i += 1
            line.append((at, at + columns, text.split("\n")))
            if deep > 1:
                below.append((at, at + columns, deep - 1))
            at += columns
        taken = sorted(below)
        grid.append(line)
    widths: dict[int, int] = {}
    wide = []
    for line in grid:
        for first, end, lines in line:
            size = max((len(x) for x in lines if len(x) <= WIDEST), default=1)
            if end - first == 1:
                widths[first] = max(widths.get(first, 0), size, any(lines))
            elif any(lines):
                wide.append((end - first, first, size))
    for columns, first, size in sorted(wide):
        inside = [c for c in range(first, first + columns) if widths.get(c)]
        missing = size - sum(widths[c] for c in inside) - 3 * (len(inside) - 1)
        if missing > 0 or not inside:
            last = inside[-1] if inside else first
            widths[last] = max(1, widths.get(last, 0) + (missing if inside else size))
    shown = sorted(c for c, n in widths.items() if n)
    out = []
    for line in grid:
        places = [(bisect_left(shown, first), bisect_left(shown, end), lines) for first, end, lines in line]
        for i in range(max((len(x) for _, _, x in line), default=0)):
            cells, done = [], 0
            for a, b, lines in places:
                text = lines[i] if i < len(lines) else ""
                if a == b or not text:
                    continue
                cells += [" " * widths[c] for c in shown[done:a]]
                cells.append(text.ljust(sum(widths[c] for c in shown[a:b]) + 3 * (b - a - 1)))
                done = b
            if cells:
                out.append(" | ".join(cells).rstrip())
    return out


def render(root: Node) -> str:
    """The text of a tree. An explicit stack of steps takes the place of recursion."""
    out = _Lines()
    outs: list[_Lines] = [out]
    tables: list[list] = []
    lists: list[list] = []  # [ordered, number]
    pre = 0
    drawn: list[bool] = []  # for each open svg, text and foreignObject: whether its text is shown
    steps: list[tuple] = [("in", root)]
    while steps:
        what, node = steps.pop()
        out = outs[-1]
        if isinstance(node, str):
            if drawn and not drawn[-1]:
                continue
            (out.kept if pre else out.words)(node)
            continue
        tag = node.tag
        if what == "in":
            if is_hidden(node) or drawn and not drawn[-1] and tag in SVG_UNSEEN:
                continue
            if tag == "svg" or drawn and tag in SVG_TEXT:
                drawn.append(tag != "svg")
                out.words(" ")
            steps.append(("out", node))
            steps.extend(("in", c) for c in reversed(node.children))
            if tag == "br":
                if out.line:
                    out.end_line()
                elif out.lines and not pre:
                    out.blank = True
            elif tag == "hr":
                out.block(["---"])
            elif tag == "input":
                if node.attributes.get("type", "text").lower() not in NO_VALUE:
                    out.words(" " + node.attributes.get("value", "") + " ")
            elif tag == "table":
                out.end_line(True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(_Lines())
            elif tag in ("td", "th"):
                out.end_line()
            elif tag in BLOCK:
                out.end_line(tag in SPACED and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "ol"):
                    lists.append([tag == "ol", _number(node.attributes.get("start", ""), -(2**31), 2**31 - 1, 1)])
                    out.indent += 2
                elif tag == "li":
                    if lists and lists[-1][0]:
                        lists[-1][1] = _number(node.attributes.get("value", ""), -(2**31), 2**31 - 1, lists[-1][1])
                        out.marker = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    else:
                        out.marker = "- "
                    out.indent += 0 if lists else 2
                elif tag in ("dd", "blockquote"):
                    out.indent += 2
                elif tag in ("pre", "textarea"):
                    pre += 1
                elif tag == "optgroup":
                    out.words(node.attributes.get("label", ""))
                    out.end_line()
                elif tag == "option" and not any(c if not isinstance(c, str) else c.strip() for c in node.children):
                    out.words(node.attributes.get("label", ""))
        else:
            if tag == "svg" or drawn and tag in SVG_TEXT:
                drawn.pop()
                out.words(" ")
            if tag == "table":
                lines = _table(tables.pop())
                out.block(lines)
            elif tag in ("td", "th") and tables:
                cell = outs.pop().done()
                tables[-1][-1].append((cell, _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS)))
            elif tag in ("td", "th"):
                out.end_line()
            elif tag == "tr" and tables:
                pass
            elif tag in BLOCK and tag != "hr":
                out.end_line(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
                if tag in ("ul", "ol"):
                    lists.pop()
                    out.indent -= 2
                elif tag == "li":
                    out.marker = ""
                    out.indent -= 0 if lists else 2
                elif tag in ("dd", "blockquote"):
                    out.indent -= 2
                elif tag in ("pre", "textarea"):
                    pre -= 1
    return outs[0].done()


def html_to_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def html_extraction(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, text (what a reader sees)."""
    ship(pages.sparkSession)

    def run(it):
        for b in batches(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    shape = T.StructType([pages.schema["page_id"]]).add("text", "string")
    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(run, shape)
