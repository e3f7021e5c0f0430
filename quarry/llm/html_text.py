"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware renderer of all visible text."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, table

# Fixed values of the HTML standard: elements without content, raw text, block display, and what closes what.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"head", "script", "style", "title", "noscript", "iframe", "noembed", "noframes", "template", "datalist", "canvas", "audio", "video", "rp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "ul", "xmp", "caption", "tr", "tbody", "thead", "tfoot"}
#: Blocks with an empty line before and after.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "dir", "menu", "table", "blockquote", "pre", "listing", "xmp", "figure", "fieldset"}
PRE = {"pre", "listing", "xmp"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
P_SCOPE = ("table", "td", "th", "caption", "button", "object")
#: A start tag of the key ends an open element of the value, up to the element in SCOPES.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "body": {"head"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
}
SCOPES = {"li": ("ul", "ol", "menu", "dir", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "option": ("select", "datalist", "table"), "optgroup": ("select", "table")}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = ("table", "td", "th")
IN_TABLE = {"table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head", "html"}
FOREIGN = ("svg", "math")
#: Children of svg whose text is not drawn, and of math that is for machines.
UNDRAWN = {"annotation", "annotation-xml", "clippath", "defs", "desc", "filter", "marker", "mask", "metadata", "pattern", "script", "style", "symbol", "title"}
#: Values of the standard: most columns of a cell; rows are limited by those of the table.
MOST_COLUMNS = 1000
#: Lines of a table are aligned with those before while that makes them at most so many times their own cells, whatever their size.
PADDED_TIMES = 16
#: Levels of lists and quotations that are indented; deeper ones hang where the last of these does.
INDENTED = 40

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|(?P<bogus>[!?/][^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WS = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


class Open:
    """The open elements, from the root on, and the places of each name among them, so that nothing scans them all."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], {"html": [0]}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """End the elements from place k on; the root stays."""
        while len(self.stack) > max(k, 1):
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The highest place of elements of these names; 0 if there is none but the root."""
        return max((at[-1] for x in names if (at := self.places.get(x))), default=0)

    def first_after(self, names, k: int) -> int | None:
        """The lowest place above k of elements of these names."""
        found = [at[i] for x in names if (at := self.places.get(x)) and (i := bisect_right(at, k)) < len(at)]
        return min(found, default=None)

    def imply(self, name: str) -> None:
        """End what a start tag of name ends without an end tag, and open what it needs around it."""
        if name in CLOSES_P and (k := self.last(("p",))) > self.last(P_SCOPE):
            self.cut(k)
        if name in HEADINGS and self.top.name in HEADINGS:
            self.cut(len(self.stack) - 1)
        if name in ENDS and (k := self.first_after(ENDS[name], self.last(SCOPES.get(name, ("table",))))) is not None:
            self.cut(k)
        if name in ("td", "th") and self.top.name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            self.top.children.append(row)
            self.push(row)

    def close(self, name: str) -> None:
        """What an end tag of name does."""
        k = self.last(HEADINGS if name in HEADINGS else (name,))
        if k and (name in IN_TABLE or k >= self.last(CELLS)):
            self.cut(k)
        elif name == "p" and not k:
            self.top.children.append(Node("p"))


def parse(source: str) -> Node:
    """The tree of a document; missing and wrongly nested tags are repaired as the standard's main rules do."""
    root = Node("html")
    tree = Open(root)
    at, n, in_head = 0, len(source), False

    def leave_head() -> None:
        nonlocal in_head
        tree.cut(len(tree.stack) - 1)
        in_head = False

    def text(s: str) -> None:
        if in_head and tree.top.name == "head":
            if not s.strip():
                return
            leave_head()
        if tree.top.name in PRE and not tree.top.children:
            s = s.removeprefix("\r").removeprefix("\n")
        if s:
            tree.top.children.append(html.unescape(s))

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        m = _TAG.match(source, lt)
        if m is None:
            text(source[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            text(source[at:lt])
        at = m.end()
        if m["name"] is None or at == n and source[-1] != ">":  # a tag that the document's end cuts off is none
            continue
        name = m["name"].lower()
        if m["end"]:
            tree.close(name)
            in_head = in_head and name != "head"
            continue
        attrs = {}
        for k, a, b, c in _ATTR.findall(m["attrs"]) if m["attrs"] else ():
            attrs.setdefault(k.lower(), html.unescape(a or b or c or ""))
        if name == "html":
            root.attrs |= attrs
            continue
        if in_head and tree.top.name == "head" and name not in IN_HEAD:
            leave_head()
        inside = tree.last(FOREIGN) > tree.last(("foreignobject",))
        if not inside:
            tree.imply(name)
        node = Node(name, attrs)
        tree.top.children.append(node)
        if name in VOID or (inside or name in FOREIGN) and m["attrs"].endswith("/"):
            continue
        if name in RAW and (not inside or name in ("script", "style")):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = end.end() if end else n
            continue
        tree.push(node)
        in_head = in_head or name == "head"
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a and a["hidden"] != "until-found" or node.name == "dialog" and "open" not in a:
        return False
    if node.name == "object" and a.get("data") or node.name == "input" and not _shown(a):
        return False
    return not (a.get("style") and _INVISIBLE.search(a["style"]))


def _shown(attrs: dict[str, str]) -> str:
    """What an input shows: a value, a button's label, a picture's alt, or the hint of an empty field."""
    kind = attrs.get("type", "text").lower()
    if kind in ("hidden", "checkbox", "radio", "file", "color", "range", "password"):
        return ""
    if kind == "image":
        return attrs.get("alt", "")
    return attrs.get("value") or attrs.get("placeholder") or {"submit": "Submit", "reset": "Reset"}.get(kind, "")


class Lines:
    """Lines of text. They hang on a prefix, for lists and quotations; gap: empty lines wanted before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.depth = 0
        self.prefix = ""
        self.lead: str | None = None

    def inline(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.end(force=True, pre=True)
                self.now.append(line)
            return
        s = _WS.sub(" ", s)
        if s.startswith(" ") and (not self.now or self.now[-1].endswith((" ", "\n"))):
            s = s[1:]
        if s:
            self.now.append(s)

    def end(self, gap: int = 0, force: bool = False, pre: bool = False) -> None:
        """End the line; force: even an empty one."""
        s = "".join(self.now)
        s = s.rstrip() if pre else s.strip(" ")
        self.now.clear()
        if s or force:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines.append((self.prefix if self.lead is None else self.lead) + s if s else "")
            self.lead = None if s else self.lead
            self.gap = 0
        self.gap = max(self.gap, gap)


class Table:
    """Cells by row and column, as they come in the order of the source; a cell of several rows keeps its columns free below.

    Spans that are still open are intervals of columns, and the runs of columns that they cover are kept joined, so a row
    takes time for its own cells, however many spans are open above it.
    """

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.spans: dict[int, tuple[int, int]] = {}  # by first column: the column after the last, and the last row
        self.starts: list[int] = []  # of the spans, ascending
        self.ends: list[tuple[int, int]] = []  # a heap of (last row, first column)
        self.runs: list[list[int]] = []  # covered columns, [from, to) ascending
        self.at = 0

    def row(self) -> None:
        self.rows.append({})
        self.at = 0
        while self.ends and self.ends[0][0] < len(self.rows):
            last, start = heapq.heappop(self.ends)
            if self.spans.get(start, (0, 0))[1] == last:
                self._drop(start)

    def place(self, lines: list[str], across: int, down: int) -> None:
        if len(self.rows) > 1:
            k = bisect_right(self.runs, [self.at, 1 << 62]) - 1
            if k >= 0 and self.runs[k][1] > self.at:
                self.at = self.runs[k][1]
        if lines:
            self.rows[-1][self.at] = lines
        if down > 1:
            self._open(self.at, self.at + across, len(self.rows) + down - 1)
        self.at += across

    def _open(self, start: int, end: int, last: int) -> None:
        """Cover columns down to a row; what covered them before ends there."""
        k = bisect_right(self.starts, start) - 1
        at = [self.starts[k]] if k >= 0 and self.spans[self.starts[k]][0] > start else []
        at += self.starts[k + 1 : bisect_left(self.starts, end)]
        for s in at:
            e, until = self.spans[s]
            self._drop(s)
            for x, y in ((s, start), (end, e)):
                if x < y:
                    self._add(x, y, until)
        self._add(start, end, last)

    def _add(self, start: int, end: int, last: int) -> None:
        self.spans[start] = (end, last)
        insort(self.starts, start)
        heapq.heappush(self.ends, (last, start))
        k = bisect_right(self.runs, [start, 1 << 62])
        if k and self.runs[k - 1][1] == start:
            k -= 1
            self.runs[k][1] = end
        else:
            self.runs.insert(k, [start, end])
        if k + 1 < len(self.runs) and self.runs[k + 1][0] == end:
            self.runs[k][1] = self.runs.pop(k + 1)[1]

    def _drop(self, start: int) -> None:
        end, _ = self.spans.pop(start)
        self.starts.pop(bisect_left(self.starts, start))
        k = bisect_right(self.runs, [start, 1 << 62]) - 1
        low, high = self.runs[k]
        self.runs[k : k + 1] = [x for x in ([low, start], [end, high]) if x[0] < x[1]]

    def lines(self) -> Iterator[str]:
        """Aligned lines; alignment begins anew with a line that has no column in common with those since it last began, or with
        which they would be over PADDED_TIMES their own cells."""
        held: list[dict[int, str]] = []
        widths: dict[int, int] = {}
        own = padded = 0
        for row in self.rows:
            across: list[dict[int, str]] = [{} for _ in range(max(map(len, row.values()), default=0))]
            for c, lines in row.items():
                for line, s in zip(across, lines, strict=False):
                    line[c] = s
            for line in across:
                sizes = {c: _width(s) for c, s in line.items()}
                more = sum(sizes.values()) + 3 * len(sizes)
                wider = sum(max(z - widths[c], 0) if c in widths else z + 3 for c, z in sizes.items())
                if held and (widths.keys().isdisjoint(line) or (len(held) + 1) * (padded + wider) > PADDED_TIMES * (own + more)):
                    yield from _aligned(held, widths)
                    held, widths, own, padded, wider = [], {}, 0, 0, more
                held.append(line)
                own, padded = own + more, padded + wider
                for c, z in sizes.items():
                    widths[c] = max(widths.get(c, 0), z)
        yield from _aligned(held, widths)


def _aligned(lines: list[dict[int, str]], widths: dict[int, int]) -> Iterator[str]:
    used = sorted(widths)
    for line in lines:
        parts = [line.get(c, "") for c in used]
        yield " | ".join(s + " " * (widths[c] - _width(s)) for s, c in zip(parts[:-1], used, strict=False)) + " | " * (len(used) > 1) + parts[-1]


class Renderer:
    """All visible text of a tree. Steps that are still to do are on a stack of their own, so nesting has no limit."""

    def __init__(self) -> None:
        self.out = Lines()
        self.outer: list[Lines] = []
        self.steps: list[tuple] = []

    def run(self, node: Node) -> list[str]:
        self.then((self.node, node, False), (lambda: self.out.end(),))
        while self.steps:
            step, *args = self.steps.pop()
            step(*args)
        return self.out.lines

    def then(self, *steps: tuple) -> None:
        """Do these steps, in this order, before those that are waiting."""
        self.steps.extend(reversed(steps))

    def text(self, s: str, pre: bool = False) -> None:
        self.out.inline(s, pre)

    def children(self, node: Node, pre: bool = False) -> None:
        steps, count = [], _number(node.attrs.get("start"), 1)
        for x in node.children:
            if isinstance(x, str):
                steps.append((self.text, x, pre))
            elif visible(x):
                if x.name == "li":
                    count = _number(x.attrs.get("value"), count)
                    steps.append((self.item, x, f"{count}. " if node.name == "ol" else "- ", pre))
                    count += 1
                else:
                    steps.append((self.node, x, pre))
        self.then(*steps)

    def end(self, gap: int = 0, force: bool = False, pre: bool = False) -> None:
        self.out.end(gap, force, pre)

    def indent(self, mark: str) -> tuple:
        """Indent what follows by mark; the step that takes it back."""
        out, before = self.out, self.out.prefix
        out.depth += 1
        if out.depth <= INDENTED:
            out.prefix += mark

        def back() -> None:
            out.prefix, out.depth = before, out.depth - 1

        return (back,)

    def item(self, node: Node, mark: str, pre: bool) -> None:
        out = self.out
        out.end()
        out.lead = out.prefix + mark
        back = self.indent(" " * len(mark))

        def no_lead() -> None:
            out.lead = None

        self.then((self.children, node, pre), (self.end,), back, (no_lead,))

    def node(self, node: Node, pre: bool) -> None:
        name = node.name
        if name == "br":
            self.end(force=True)
        elif name == "hr":
            self.end()
            self.text("---")
            self.end()
        elif name == "img":
            if alt := node.attrs.get("alt", "").strip():
                self.text(alt)
        elif name == "input":
            self.then((self.text, " "), (self.text, _shown(node.attrs)), (self.text, " "))
        elif name == "table":
            self.table(node)
        elif name == "svg":
            self.drawing(node)
        elif name in UNDRAWN and name not in ("style", "script", "title"):
            pass
        elif name in ("td", "th", "button", "mtd", "mtr"):  # cells outside a table
            self.then((self.text, " "), (self.children, node, pre), (self.text, " "))
        elif name in BLOCK:
            inner, gap = pre or name in PRE, int(name in SPACED and not (name in ("ul", "ol") and self.out.prefix))
            self.end(gap)
            steps = [(self.children, node, inner), (self.end, 0, False, inner)]
            if mark := {"blockquote": "> ", "dd": "    "}.get(name):
                steps.append(self.indent(mark))
            self.then(*steps, (self.end, gap))
        elif name == "textarea":
            self.text("".join(x for x in node.children if isinstance(x, str)), True)
        elif name == "q":
            self.then((self.text, '"'), (self.children, node, pre), (self.text, '"'))
        else:
            self.children(node, pre)

    def drawing(self, node: Node) -> None:
        """Only text elements of an svg show text, and HTML that it embeds."""
        steps = []
        for x in node.children:
            if isinstance(x, Node) and visible(x) and x.name not in UNDRAWN:
                inner = self.children if x.name in ("text", "foreignobject") else self.drawing
                steps += [(self.text, " "), (inner, x), (self.text, " ")] if x.name == "text" else [(inner, x)]
        self.then(*steps)

    def table(self, node: Node) -> None:
        self.end(1)
        steps, grid = [], Table()
        for caption in _rows(node, "caption"):
            steps += [(self.children, caption), (self.end,)]
        for row in _rows(node, "tr"):
            steps.append((grid.row,))
            for cell in row.children:
                if isinstance(cell, str):
                    if cell.strip():
                        steps += self.cell(grid, Node("td", {}, [cell]))
                elif visible(cell):
                    steps += self.cell(grid, cell if cell.name in ("td", "th") else Node("td", {}, [cell]))

        def layout() -> None:
            for line in grid.lines():
                self.out.now.append(line)
                self.end(force=True, pre=True)
            self.out.gap = max(self.out.gap, 1)

        self.then(*steps, (layout,))

    def cell(self, grid: Table, cell: Node) -> list[tuple]:
        across, down = min(max(_number(cell.attrs.get("colspan"), 1), 1), MOST_COLUMNS), _number(cell.attrs.get("rowspan"), 1)

        def begin() -> None:
            self.outer.append(self.out)
            self.out = Lines()

        def finish() -> None:
            self.out.end()
            lines, self.out = self.out.lines, self.outer.pop()
            grid.place(lines, across, down or 1 << 30)  # 0: to the end

        return [(begin,), (self.children, cell), (finish,)]


def _rows(node: Node, name: str) -> list[Node]:
    """Rows or captions of a table; what stands between rows is a row of its own."""
    out, waiting = [], list(reversed(node.children))
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            if name == "tr" and x.strip():
                out.append(Node("tr", {}, [x]))
        elif visible(x):
            if x.name == name:
                out.append(x)
            elif x.name in ("tbody", "thead", "tfoot", "form"):
                waiting += reversed(x.children)
            elif name == "tr" and x.name not in ("caption", "colgroup", "col"):
                out.append(Node("tr", {}, [x]))
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value.strip()) else default


def _width(s: str) -> int:
    """Columns that s takes up: wide East Asian characters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def render(source: str | None) -> str:
    """All visible text of a document."""
    if not source:
        return ""
    lines = Renderer().run(Node("body", {}, parse(source.replace("\0", "")).children))
    return "\n".join(s.replace("\xa0", " ").rstrip() for s in lines).strip("\n")


def title(source: str | None) -> str:
    m = re.search(r"<title[^>]*>(.*?)</title", source or "", re.S | re.I)
    return _WS.sub(" ", html.unescape(m[1])).strip() if m else ""


def _extracted(cols: dict) -> Iterator[dict]:
    yield {"id": cols["id"], "url": cols["url"], "title": [title(x) for x in cols["html"]], "text": [render(x) for x in cols["html"]]}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, title, text, n_chars, n_lines.

    text holds all visible text: blocks on lines of their own, paragraphs, headings, lists and tables with empty lines
    around them, list items behind marks, table cells in columns (alignment begins anew where lines have no column in common,
    or blanks would make those since it last began over PADDED_TIMES as long), labels of buttons and fields, text of drawings and
    formulas. Elements that browsers do not show are left out, as are those that are hidden by attribute or inline style.
    Nesting has no limit; a cell spans 1,000 columns at most, as in the standard; lists and quotations are indented INDENTED levels deep. A null or empty html gives an empty text; broken markup is
    repaired, never refused. Null ids and repeated rows count as rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = map_rows(rows, _extracted, "id long, url string, title string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "title", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
