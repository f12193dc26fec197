"""HTML extraction by layout-aware rendering.

A tokenizer cuts the page at tags, comments and raw-text elements; the tree builder keeps a stack of open elements, closes
those that a new tag implies closed (a paragraph before a block, an item before an item, a cell before a cell, a row before a
row) and those that an end tag leaves open; visibility rules drop what a browser doesn't show (head matter, scripts, styles,
templates, the hidden attribute, display:none and visibility:hidden). What is left is laid out: blocks on lines of their
own, one blank line around paragraphs and headings, items behind bullets or numbers and indented by depth (the indent ends at
64 levels, the text doesn't), preformatted text as it is, and the cells of a table padded to the width of their columns, with
cells over several columns or rows where they stand in the grid. What can't stand in the head ends it.

Cells without a row get one, and what stands in a table, row group or row outside of cells and captions goes before the table,
as in browsers. Formulas and the options of a select are text; of a drawing (svg) only its text elements and foreign objects are
shown, as in browsers. Content that stands in for what can't be shown (object, audio, video, canvas, iframe) and datalists
stay hidden. Elements may nest to any depth: trees are built and laid out without recursion, in linear time.

Edge cases: null and empty pages give an empty text; unclosed tags and stray end tags are tolerated; a comment or raw-text
element that isn't closed ends with the page; every row comes back once, repeated or not; an empty table gives an empty
result; a null key is passed through and other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
_SVG_UNSEEN = frozenset("defs symbol desc metadata clippath mask".split())
_SVG_TEXT = frozenset(("text", "foreignobject"))
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("tr",))
_GROUPS = frozenset(("thead", "tbody", "tfoot"))
_TABLE = frozenset(("table",)) | _ROWS | _GROUPS
#: Inside these, only the elements of _TABLE_PARTS stand in the table.
_NO_TEXT = _TABLE | {"colgroup"}
_TABLE_PARTS = _CELLS | _ROWS | _GROUPS | frozenset("caption colgroup col style script template".split())
_MOST_INDENT = 64
#: What may stand in the head; other tags and text begin the body.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: What a start tag closes, and up to which open element it looks.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (_CELLS, frozenset(("tr", "table", "template"))),
    "th": (_CELLS, frozenset(("tr", "table", "template"))),
    "tr": (_CELLS | _ROWS, frozenset(("table", "template"))),
    "thead": (_CELLS | _ROWS | _GROUPS, frozenset(("table", "template"))),
    "tbody": (_CELLS | _ROWS | _GROUPS, frozenset(("table", "template"))),
    "tfoot": (_CELLS | _ROWS | _GROUPS, frozenset(("table", "template"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "body": (frozenset(("head",)), frozenset()),
}

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTRS = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: The standard's bounds of colspan and rowspan; a rowspan of 0 reaches to the table's end.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534
_WHITE = re.compile(r"[ \t\n\f\r]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, open or close."""
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        rest = _REST.match(page, m.end())
        # A quote that isn't closed: the tag ends at the next angle bracket.
        stop = rest.end() if rest else (page.find(">", m.end()) + 1 or end)
        at = stop
        if not m[2]:
            continue
        name, attrs = m[2].lower(), page[m.end() : stop - 1]
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, attrs
        if name in _RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if (upto := close.start() if close else end) > at:
                yield "text", page[at:upto], "raw"
            at = upto


class _Node:
    """seen: what the element's visibility is set to, if it is."""

    __slots__ = ("across", "down", "hidden", "kids", "name", "seen", "start")

    def __init__(self, name: str, hidden: bool = False, seen: bool | None = None, start: int = 1, across: int = 1, down: int = 1) -> None:
        self.name, self.hidden, self.seen, self.start, self.across, self.down, self.kids = name, hidden, seen, start, across, down, []


def _attributes(attrs: str) -> tuple[bool, bool | None, int, int, int]:
    """Whether the element is hidden, its visibility, the first number of a list, and the columns and rows of a cell."""
    hidden, seen, number = False, None, {"start": 1, "colspan": 1, "rowspan": 1}
    for k, a, b, c in _ATTRS.findall(attrs):
        k, v = k.lower(), a or b or c
        hidden |= k == "hidden"
        if k == "style":
            v = html.unescape(v)
            hidden |= bool(_HIDDEN.search(v))
            if said := _VISIBILITY.findall(v):
                seen = said[-1].lower() == "visible"
        elif k in number and re.fullmatch(r"-?[0-9]{1,6}", v):
            number[k] = int(v)
    down = number["rowspan"] or _MOST_ROWS
    return hidden, seen, number["start"], min(max(number["colspan"], 1), _MOST_COLUMNS), min(max(down, 1), _MOST_ROWS)


class _Open:
    """The open elements, outermost first, with their places by name, so that looking for one doesn't walk the stack."""

    def __init__(self, root: _Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: _Node) -> None:
        at = len(self.stack)
        self.places[node.name].append(at)
        if node.name in _BLOCK:
            self.blocks.append(at)
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.name].pop()
            if node.name in _BLOCK:
                self.blocks.pop()

    def last(self, names) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def first_above(self, names, at: int) -> int:
        """The place of the outermost of these inside the element at this place, 0 if there is none."""
        found = [p[i] for n in names if (p := self.places.get(n)) and (i := bisect_right(p, at)) < len(p)]
        return min(found, default=0)

    def add(self, kid: str | _Node) -> None:
        """Into the innermost element; what can't stand in a table goes before it."""
        top = self.stack[-1]
        if top.name in _NO_TEXT and (kid.strip() if isinstance(kid, str) else kid.name not in _TABLE_PARTS):
            kids = self.stack[self.places["table"][-1] - 1].kids if self.places["table"] else top.kids
            kids.insert(len(kids) - bool(self.places["table"]), kid)
        else:
            top.kids.append(kid)


def tree(page: str) -> _Node:
    """The page's elements with implied ends; hidden and invisible ones are kept, marked."""
    root = _Node("html")
    now, body = _Open(root), False
    for kind, name, attrs in tokens(page):
        stack = now.stack
        if stack[-1].name == "head" and (kind == "open" and name not in _HEAD or kind == "text" and name.strip()):
            now.cut(len(stack) - 1)
        if kind == "text":
            body |= bool(name.strip()) and not now.places.get("head")
            now.add(name if attrs == "raw" and stack[-1].name not in ("title", "textarea") else html.unescape(name))
        elif kind == "open":
            if name == "html" or name == "body" and now.places.get("body") or name == "head" and (body or now.places.get("head")):
                continue
            body |= name != "head" and not now.places.get("head") and name not in _HEAD
            if name in _BLOCK and now.blocks and stack[now.blocks[-1]].name == "p":
                now.cut(now.blocks[-1])  # a block ends an open paragraph, unless a cell or the like holds the block
            if name in _CLOSES:
                ends, upto = _CLOSES[name]
                if at := now.first_above(ends, now.last(upto)):
                    now.cut(at)
            if name in _CELLS | _ROWS | _GROUPS | {"caption", "colgroup"}:
                holds = _TABLE if name in _CELLS else _GROUPS | {"table"} if name in _ROWS else {"table"}
                at = now.last(holds)
                if at > now.last(_CELLS | {"template"}):
                    now.cut(at + 1)
                    if name in _CELLS and stack[-1].name != "tr":
                        row = _Node("tr")
                        now.add(row)
                        now.push(row)
            elif name == "table" and (at := now.last(_TABLE)) > now.last(_CELLS | {"caption", "template"}):
                now.cut(now.places["table"][-1] if now.places["table"] else at)
            node = _Node(name, *_attributes(attrs)) if attrs.strip(" /") else _Node(name)
            loose = name == "form" and stack[-1].name in _NO_TEXT  # a form between rows or cells holds nothing
            now.add(node)
            if name not in _VOID and not attrs.endswith("/") and not loose:
                now.push(node)
        elif places := now.places.get(name):
            walls = {"template"} if name in _GROUPS | {"table", "template"} else {"table", "template"} if name in _CELLS | _ROWS | {"caption"} else _CELLS | {"table", "caption", "template"}
            if name == "template" or places[-1] > now.last(walls - {name}) or name in _GROUPS and places[-1] > now.last(("table",)):
                now.cut(places[-1])
    return root


class _Page:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.space = False

    def flush(self) -> None:
        if line := "".join(self.now).rstrip():
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append(line)
            self.blank = False
        self.now, self.space = [], False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *others = s.split("\n")
            self.now.append(first)
            for x in others:
                if self.blank and self.lines:
                    self.lines.append("")
                self.blank = False
                self.lines.append("".join(self.now).rstrip())
                self.now = [x]
            return
        for i, word in enumerate(_WHITE.split(s)):
            self.space |= i > 0
            if word:
                if self.space and self.now and not self.now[-1].endswith(" "):
                    self.now.append(" ")
                self.now.append(word)
                self.space = False


def _walk(steps: Generator) -> list[str] | None:
    """Run steps that yield the steps inside them, with a list in place of the call stack."""
    running, value = [steps], None
    while running:
        try:
            running.append(running[-1].send(value))
            value = None
        except StopIteration as end:
            running.pop()
            value = end.value
    return value


def _render(node: _Node, page: _Page, depth: int, pre: bool, drawing: bool = False, seen: bool = True) -> Generator:
    number, seen = node.start, seen if node.seen is None else node.seen
    for kid in node.kids:
        if isinstance(kid, str):
            if not drawing and seen:
                page.text(kid, pre)
            continue
        name = kid.name
        if kid.hidden or name in _UNSEEN or drawing and name in _SVG_UNSEEN:
            continue
        if name == "br":
            page.flush()
            continue
        if name in ("svg", "option", "optgroup") or drawing and name in _SVG_TEXT:
            page.space = True  # a word of its own
            yield _render(kid, page, depth, pre, name == "svg" or drawing and name not in _SVG_TEXT, seen)
            page.space = True
            continue
        if name not in _BLOCK:
            yield _render(kid, page, depth, pre, drawing, seen)
            continue
        page.flush()
        page.blank |= name in _SPACED and not (name in ("ul", "ol") and depth)
        if name == "table":
            table = yield _table(kid, seen)
            page.lines += ([""] if page.blank and page.lines else []) + table if table else []
        elif name == "hr":
            pass
        elif name == "li":
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            page.now = ["  " * max(0, min(depth, _MOST_INDENT) - 1) + mark]
            yield _render(kid, page, depth, pre, False, seen)
            if "".join(page.now).strip() == mark.strip():
                page.now = []  # an empty item
        else:
            yield _render(kid, page, depth + (name in ("ul", "ol", "menu")), pre or name == "pre", False, seen)
        page.flush()
        page.blank |= name in _SPACED and not (name in ("ul", "ol") and depth)


def _rows(node: _Node, seen: bool) -> Iterator[tuple[_Node, bool]]:
    """The rows of a table, with their visibility."""
    for kid in node.kids:
        if isinstance(kid, _Node) and not kid.hidden:
            its = seen if kid.seen is None else kid.seen
            if kid.name == "tr":
                yield kid, its
            elif kid.name in _GROUPS:
                yield from ((row, its if row.seen is None else row.seen) for row in kid.kids if isinstance(row, _Node) and not row.hidden and row.name == "tr")


#: Places that a cell takes at most in the alignment of its table, and up to which columns are aligned.
_WIDEST, _FARTHEST = 60, 240


def _aligned(rows: list[list[tuple[int, int, str]]]) -> list[str]:
    """Lines of rows of (column, columns, text): a column begins two places behind what stands before it.

    A cell counts with _WIDEST places at most, and columns are aligned up to place _FARTHEST; a longer cell, or one further right,
    moves what follows in its own row only. So a line has a bounded number of blanks.
    """
    columns = sorted({c for row in rows for c, _, _ in row})
    before: list[list[tuple[int, int]]] = [[] for _ in range(len(columns) + 1)]  # cells that end before a column
    for c, across, width in {(c, across, min(len(text), _WIDEST)) for row in rows for c, across, text in row}:
        before[bisect_left(columns, c + across)].append((c, width))
    at: dict[int, int] = {}
    for i, c in enumerate(columns):
        at[c] = max((at[b] + w + 2 for b, w in before[i]), default=0)
        if i:
            at[c] = max(at[c], at[columns[i - 1]])
    lines = []
    for row in rows:
        line, upto = [], 0
        for c, _, text in row:
            gap = max(at[c] - upto if at[c] <= _FARTHEST else 0, 2 if line else 0)
            line.append(" " * gap + text)
            upto += gap + len(text)
        lines.append("".join(line))
    return lines


def _table(node: _Node, seen: bool = True) -> Generator:
    """Lines of a table, each column as wide as its widest cell; the caption comes first."""
    seen = seen if node.seen is None else node.seen
    loose, rows = _Page(), []
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                loose.text(kid, False)
        elif not kid.hidden and kid.name not in _GROUPS | _ROWS | _UNSEEN:
            yield _render(kid, loose, 0, False, False, seen)
            loose.flush()
    loose.flush()
    taken: dict[int, int] = {}  # the row before which a column is free again
    for at, (row, its) in enumerate(_rows(node, seen)):
        cells, column = [], 0
        for cell in row.kids:
            if isinstance(cell, _Node) and not cell.hidden and cell.name in _CELLS:
                inside = _Page()
                yield _render(cell, inside, 0, False, False, its)
                inside.flush()
                while taken.get(column, 0) > at:
                    column += 1
                if cell.down > 1:
                    taken.update(dict.fromkeys(range(column, column + cell.across), at + cell.down))
                if text := " ".join(x for x in inside.lines if x):
                    cells.append((column, cell.across, text))
                column += cell.across
        if cells:
            rows.append(cells)
    return loose.lines + _aligned(rows)


def visible_text(page: str | None) -> str:
    """The text that a browser would show."""
    out = _Page()
    _walk(_render(tree(page or ""), out, 0, False))
    out.flush()
    return "\n".join(out.lines)


def extract_text(df: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """key and text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x.as_py()) for x in b.column(1)], pa.string())], names=["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(page).cast("string").alias("page")).transform(map_arrow, run, f"key {kind}, text string").withColumnRenamed("key", key)


def op7_html(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(read(spark, sf_dir, "pages"))
