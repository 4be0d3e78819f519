"""Visible text of HTML pages, laid out as a text browser would.

A tokenizer feeds a tree builder that supplies implied tags (a paragraph ends where a block begins, a
row's cell ends where the next begins, head and body need not be written); visibility rules leave out
what isn't shown; a layout pass over the tree sets lines, block spacing, list markers and aligned
table cells. Every step is linear in the page and none recurses, so depth doesn't matter.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas object meta link base".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())
#: Blocks that start a line of their own; those in APART also stand off by an empty line.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table ul caption".split())
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu hr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What a start tag ends, and the elements that shelter what lies outside them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
SHELTER = frozenset("table td th caption template".split())
CELL_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Cells that others follow in their row are wrapped to so many characters.
CELL = 100
#: A table has so many columns at most; cells beyond them follow unaligned.
COLUMNS = 1000
#: A table whose alignment took more blanks than so many times its text is set unaligned.
FILL = 64
#: Levels of lists and quotations that are indented; deeper ones stand in the last column.
DEEPEST = 32

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*+([^\s=>/][^\s=>/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)?))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)")


def tokens(page: str):
    """``("text", s)``, ``("start", name, attributes)`` and ``("end", name)`` in order."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", entities.unescape(page[at:]), None
            return
        if lt > at:
            yield "text", entities.unescape(page[at:lt]), None
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", None
                at = lt + 1
            continue
        name, at, attrs = m[1].lower(), m.end(), {}
        while (a := _ATTR.match(page, at)) is not None:
            attrs.setdefault(a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
            at = a.end()
        end = page.find(">", at)
        if end < 0:
            return  # an unfinished tag ends the page
        at = end + 1
        if page[lt + 1] == "/":
            yield "end", name, None
            continue
        yield "start", name, attrs
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : close.start() if close else size]
            yield "text", entities.unescape(inner) if name in ("title", "textarea") else inner, None
            at = close.start() if close else size


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def build(page: str) -> Node:
    """The element tree under an ``html`` root."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements by tag, in the stack
    body: Node | None = None

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def close(tags, shelter) -> None:
        """Ends the innermost of ``tags`` and, for rows and cells, all that it lies in of them."""
        while (i := last(tags)) > last(shelter):
            cut(i)
            if len(tags) < 3:
                return

    def opened(tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        return node

    def into_body() -> None:
        nonlocal body
        if body is None:
            cut(1)
            body = opened("body")

    for kind, value, attrs in tokens(page):
        if kind == "text":
            if body is None and stack[-1].tag not in HEAD_ONLY:
                if not value.strip():
                    continue
                into_body()
            stack[-1].children.append(value)
        elif kind == "start":
            if value == "html":
                root.attrs |= attrs
                continue
            if value == "head":
                if body is None and len(stack) == 1:
                    opened("head", attrs)
                continue
            if value == "body":
                if body is None:
                    into_body()
                body.attrs |= attrs
                continue
            if body is None and value not in HEAD_ONLY:
                into_body()
            if body is None and len(stack) == 1:
                opened("head")
            if value in ENDS_P:
                close({"p"}, SHELTER)
            if value in ENDS:
                close(*ENDS[value])
            if value in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                opened("tr")
            opened(value, attrs)
            if value in VOID:
                cut(len(stack) - 1)
        else:
            if value in ("html", "body"):
                continue
            shelter = {"table"} if value in CELL_TAGS and value != "table" else SHELTER if value not in CELL_TAGS else ()
            if (i := last({value})) > last(t for t in shelter if t != value) or i and value == "table":
                cut(i)
    return root


def seen(node: Node) -> bool:
    return not (node.tag in UNSEEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden" or _NONE.search(node.attrs.get("style", "")))


class Flow:
    """Lines of one column of text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.apart = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            if first:
                self._put(first)
            for x in rest:
                self.wrap()
                if x:
                    self._put(x)
            return
        words = [w for w in _GAP.split(s) if w]
        if not words:
            self.gap = self.gap or bool(s and self.line)
            return
        self.gap = self.gap or s[0] in " \t\n\r\f"
        self._put(" ".join(words))
        self.gap = s[-1] in " \t\n\r\f"

    def _put(self, s: str) -> None:
        if not self.line:
            if self.apart and self.lines:
                self.lines.append("")
            self.apart = False
            lead = "".join(self.indent[:DEEPEST])
            if self.marker:
                lead = lead[: -len(self.marker)] + self.marker
                self.marker = ""
            self.line.append(lead)
        elif self.gap:
            self.line.append(" ")
        self.gap = False
        self.line.append(s)

    def wrap(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.gap = [], False

    def fresh(self, apart: bool = False) -> None:
        if self.line:
            self.wrap()
        self.gap = False
        self.apart = self.apart or apart

    def done(self) -> list[str]:
        self.fresh()
        return self.lines


def wrapped(lines: list[str], width: int) -> list[str]:
    """Lines cut at blanks to the width; a longer word is cut too."""
    out = []
    for line in lines:
        while len(line) > width:
            at = line.rfind(" ", 1, width + 1)
            at = at if at > 0 and line[:at].strip() else width
            out.append(line[:at].rstrip(" "))
            line = line[at:].lstrip(" ")
        out.append(line)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (cell's lines, columns and rows it spans), columns aligned and two blanks apart.

    A cell stands in its row's first column that no cell from above covers. What spans several rows is
    written in the first of them; a row's last cell takes no part in the columns' widths.
    """
    covered: dict[int, int] = {}  # the last row in which a cell from above covers the column
    grid = []
    for r, row in enumerate(rows):
        at, placed = 0, []
        for i, (lines, span, down) in enumerate(row):
            while at < COLUMNS and covered.get(at, -1) >= r:
                at += 1
            span = max(1, min(span, COLUMNS - at))
            placed.append((at, span, lines if i == len(row) - 1 else wrapped(lines, CELL)))
            if down > 1:
                covered |= dict.fromkeys(range(at, min(at + span, COLUMNS)), r + down - 1)
            at += span
        grid.append(placed)
    columns = max((row[-1][0] for row in grid if row), default=0) + 1
    width = [0] * columns
    wide = []
    for row in grid:
        for at, span, lines in row[:-1]:
            need = max(map(len, lines), default=0)
            if span == 1:
                width[at] = max(width[at], need)
            else:
                wide.append((at, min(at + span, columns), need))
    for at, end, need in wide:
        width[end - 1] += max(0, need - sum(width[at:end]) - 2 * (end - at - 1))
    starts = [0]
    for w in width:
        starts.append(starts[-1] + w + 2)
    tall = [max((len(c) for _, _, c in row), default=0) for row in grid]
    text = sum(len(x) + 1 for row in grid for _, _, c in row for x in c)
    if sum(n * starts[row[-1][0]] for n, row in zip(tall, grid, strict=True) if row) > FILL * (text + len(grid)):
        starts = [0] * len(starts)
    out = []
    for n, row in zip(tall, grid, strict=True):
        for k in range(n):
            parts, size = [], 0
            for at, _, lines in row:
                gap = max(starts[at] - size, 2 if size else 0)
                own = lines[k] if k < len(lines) else ""
                parts += [" " * gap, own]
                size += gap + len(own)
            out.append("".join(parts).rstrip(" "))
    return out


def render(page: str | None) -> str:
    """The page's visible text; null and empty pages give an empty text."""
    if not page:
        return ""
    flows, keep, lists = [Flow()], 0, []
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    work: list[tuple[Node | str, bool]] = [(build(page), True)]
    while work:
        node, enter = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.text(node, keep > 0)
            continue
        tag = node.tag
        if enter:
            if not seen(node):
                continue
            if tag == "br":
                flow.wrap() if flow.line or flow.lines else None
                continue
            if tag == "wbr":
                continue
            if tag in BLOCK:
                flow.fresh(tag in APART and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "hr":
                flow.text("---", False)
                flow.fresh(True)
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append(None if tag != "ol" else int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1)
            elif tag == "li":
                mark = "- " if not lists or lists[-1] is None else f"{lists[-1]}. "
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                flow.indent.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag == "pre":
                keep += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(Flow())
            work.append((node, False))
            inner = node.children
            if tag == "details" and "open" not in node.attrs:
                inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"][:1]
            work.extend((c, True) for c in reversed(inner))
            continue
        if tag in ("td", "th") and tables:
            cell = flows.pop().done()
            span, down = (int(x) if re.fullmatch(r"\d{1,5}", x := node.attrs.get(k, "1").strip(), re.A) else 1 for k in ("colspan", "rowspan"))
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, max(1, span), down or len(page)))
            continue
        if tag == "table":
            for x in table_lines(tables.pop()):
                flow.text(x, True) if x else None
                flow.wrap()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            if tag == "li" and flow.marker:
                flow.text("", True)
                flow.marker = ""
            flow.fresh()
            flow.indent.pop()
        elif tag == "pre":
            keep -= 1
        if tag in BLOCK:
            flow.fresh(tag in APART and not (tag in ("ul", "ol", "menu") and lists))
    lines = flows[0].done()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def _render(pages: pa.Array) -> pa.Array:
    return pa.array([None if (p := x.as_py()) is None else render(p) for x in pages], pa.string())


def extract_html(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the visible text added. Rows are kept one to one, repeated ones too; an empty table stays empty.

    A null page gives null, an empty one an empty text. Not shown: what the ``hidden`` attribute, an
    inline ``display: none`` or ``visibility: hidden``, a closed ``details`` or ``dialog`` or the element
    itself (scripts, styles, templates, media) hides; style sheets aren't read. Limits: cells that others
    follow in their row are wrapped at ``CELL`` characters, tables align at most ``COLUMNS`` columns and
    none whose alignment would take more than ``FILL`` times their text, lists and quotations are
    indented ``DEEPEST`` levels deep; ``rowspan`` runs on across row groups. An input column of the new
    name is replaced, others may have any name.
    """
    return without(df, out).withColumn(out, F.arrow_udf(_render, "string")(html))


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    text = extract_html(pages).select("page_id", "text")
    return text.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"), "text")
