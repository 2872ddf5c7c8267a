"""HTML extraction: all visible text, laid out.

A tree builder follows HTML's rules for implied and misnested tags; a renderer leaves out what isn't shown and lays out the rest: blocks on
lines of their own, blank lines between paragraphs, indented lists with their marks, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from icuflow.llm.batches import add_columns

TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""", re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
USED = re.compile("hidden|style|span|start|value|type|open|reversed", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head script style template title noscript iframe noembed noframes object audio video canvas datalist param".split())
UNSEEN_INSIDE = {  # not shown within these
    "svg": set("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient".split()), "math": {"annotation", "annotation-xml"},
}
SET_APART = set("text mfrac mtr mtd".split())  # parts of drawings and formulas that stand at places of their own
HEADINGS = {f"h{i}" for i in range(1, 7)}
BLOCKS = HEADINGS | set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table ul xmp caption tr".split()
)
SPACED = HEADINGS | set("blockquote dl fieldset figure menu ol p pre table ul xmp".split())  # a blank line before and after
ENDS_P = (BLOCKS - {"option", "optgroup", "body", "html", "tr", "caption", "legend"})
CELLS, SECTIONS = {"td", "th"}, {"thead", "tbody", "tfoot"}
SCOPES = {"table", "td", "th", "caption", "html", "object", "template"}
CLOSES = {  # an opening tag closes these where they stand open within the given limits
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    **{s: (SECTIONS | {"caption"}, {"table"}) for s in SECTIONS},
}
DEEPEST = 400
WIDEST_CELL = 60
MOST_SPAN = 1000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(text: str) -> dict[str, str]:
    if not USED.search(text):
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """The tree of a page; nesting beyond DEEPEST is flattened, as browsers do."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]

    def close_to(self, tags: set[str], limits: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in limits:
                return

    def start(self, tag: str, attrs: dict, empty: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" or attrs and HIDDEN_STYLE.search(attrs.get("style", "")):
                self.push(Node(tag, attrs))
            elif tag == "body":
                self.close_to({"head"}, set())
            return
        if tag in ENDS_P:
            self.close_to({"p"}, SCOPES)
            if any(n.tag == "head" for n in self.open[1:2]):
                del self.open[1:]
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag in CELLS and self.inside("table", "tr") is False:
            self.start("tr", {}, False)
        if tag == "tr" and self.inside("table", "td", "th"):
            self.close_to(CELLS, {"table"})
        node = Node(tag, attrs)
        if tag in VOID or empty and tag not in BLOCKS | CELLS:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def inside(self, limit: str, *tags: str) -> bool | None:
        """Whether one of ``tags`` is open within the nearest ``limit``; None without a limit."""
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag == limit:
                return False
        return None

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < DEEPEST:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        elif tag in HEADINGS:
            self.close_to(HEADINGS, SCOPES)
        else:
            limits = {"html"} if tag == "table" else {"table"} if tag in CELLS | SECTIONS | {"tr", "caption"} else SCOPES - {tag}
            self.close_to({tag}, limits)


def parse(page: str) -> Node:
    builder, at, last = Builder(), 0, page.rfind(">") + 1  # after the last > no tag can end
    while m := TAG.search(page, at, max(at, last)):
        if m.start() > at:
            builder.open[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            builder.end(tag)
            continue
        rest = m[3] if m[2] else m[6]
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : close.start() if close else len(page)]
            at = close.end() if close else len(page)
            if tag in ("textarea", "xmp"):
                builder.start(tag, attributes(rest), False)
                builder.open[-1].children.append(html.unescape(body) if tag == "textarea" else body)
                builder.end(tag)
            continue
        builder.start(tag, attributes(rest), rest.endswith("/"))
    builder.open[-1].children.append(html.unescape(page[at:].partition("<!--")[0]))
    return builder.root


def hidden(node: Node) -> bool:
    return node.tag in UNSEEN or bool(node.attrs) and (
        "hidden" in node.attrs or bool(HIDDEN_STYLE.search(node.attrs.get("style", "")))
    )


def number(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else default


class Page:
    """Lines of laid-out text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.gap = False
        self.space = False

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.put(first)
            for part in more:
                self.end_line(True)
                self.put(part)
            return
        text = SPACE.sub(" ", text)
        if text in ("", " "):
            self.space |= bool(text)
            return
        body = text.strip(" ")
        if self.line and (self.space or text[0] == " "):
            self.put(" ")
        self.put(body)
        self.space = text[-1] == " "

    def put(self, text: str) -> None:
        if text:
            self.line.append(text)

    def end_line(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = lead[: -len(self.mark)] + self.mark if self.indent else self.mark, ""
            self.lines.append((lead + "".join(self.line)).rstrip(" ").replace("\xa0", " "))
        self.line, self.space = [], False

    def edge(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(node: Node, page: Page, kept: bool = False, depth: int = 0, numbers: list | None = None) -> None:
    for child in node.children:
        if isinstance(child, str):
            page.text(child, kept)
            continue
        tag = child.tag
        if hidden(child) or tag == "input" and child.attrs.get("type", "").lower() == "hidden":
            continue
        if tag == "details" and "open" not in child.attrs:
            shown = Node("div")
            shown.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
            child, tag = shown, "div"
        if tag == "br":
            page.end_line(True)
            continue
        if tag == "input" and child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
            page.text(f" {child.attrs.get('value', '')} ", False)
            continue
        if tag in UNSEEN_INSIDE:
            child = drawing(child, UNSEEN_INSIDE[tag])
        if tag == "table":
            page.edge(True)
            table(child, page, depth)
            page.edge(True)
            continue
        block = tag in BLOCKS
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu") and depth)
        if block:
            page.edge(spaced)
        if tag == "hr":
            page.put("---")
            page.edge(False)
        elif tag in ("ul", "ol", "menu", "dir"):
            count = [number(child.attrs.get("start"), 1)] if tag == "ol" else None
            page.indent.append("  ")
            render(child, page, kept, depth + 1, count if tag == "ol" else [])
            page.edge(spaced)
            page.indent.pop()
        elif tag == "li":
            if numbers:
                numbers[0] = number(child.attrs.get("value"), numbers[0])
                mark = f"{numbers[0]}. "
                numbers[0] += 1
            else:
                mark = "* "
            page.indent.append(" " * len(mark))
            page.mark = mark
            render(child, page, kept, depth, None)
            page.edge(False)
            page.indent.pop()
            page.mark = ""
        elif tag in ("dd", "blockquote"):
            page.indent.append("    ")
            render(child, page, kept, depth)
            page.edge(spaced)
            page.indent.pop()
        else:
            if tag in ("pre", "xmp", "textarea") and child.children and isinstance(child.children[0], str):
                child.children[0] = re.sub(r"\A\r?\n", "", child.children[0])
            if tag == "q":
                page.text('"', kept)
            render(child, page, kept or tag in ("pre", "xmp", "textarea"), depth, numbers if not block else None)
            if tag == "q":
                page.put('"')
        if block:
            page.edge(spaced)


def drawing(node: Node, unseen: set[str]) -> Node:
    """What is shown of a drawing or formula; parts at places of their own are separate words."""
    shown = Node(node.tag, node.attrs)
    for child in node.children:
        if isinstance(child, str):
            shown.children.append(child)
        elif child.tag not in unseen:
            inner = drawing(child, unseen)
            shown.children += [" ", inner, " "] if child.tag in SET_APART or node.tag == "mfrac" else [inner]
    return shown


def parted(node: Node, tags: set[str]) -> tuple[list[Node], Node]:
    """The shown nodes of ``tags`` below a part of a table, at any depth outside inner tables, and all else, as a block."""
    found, rest = [], Node("div")
    for child in node.children:
        if isinstance(child, str):
            rest.children.append(child)
        elif hidden(child):
            continue
        elif child.tag in tags:
            found.append(child)
            rest.children.append(" ")
        elif child.tag in ("table", "details", "caption", "select"):
            rest.children.append(child)
        else:
            below, left = parted(child, tags)
            found += below
            if child.tag not in SECTIONS | {"form"}:
                left.tag, left.attrs = child.tag, child.attrs
            rest.children.append(left if below or left.tag != child.tag else child)
    return found, rest


def table(node: Node, page: Page, depth: int) -> None:
    """Rows of cells in columns of equal width; a table with a cell of several lines or a wide one is stacked cell by cell, a blank line
    between rows.

    Caption and stray content of the table, its sections and its rows come first, as browsers have it. Spanned places stay empty.
    """
    rows, outside = parted(node, {"tr"})
    parts = [parted(row, CELLS) for row in rows]
    for stray in (outside, *(rest for _, rest in parts)):
        render(stray, page, depth=depth)
        page.edge(False)
    grid: list[list[tuple[int, str]]] = []
    taken: dict[int, int] = {}  # column: rows that a cell above still covers
    for found, _ in parts:
        cells, column, below = [], 0, {}
        for cell in found:
            while taken.get(column, 0):
                column += 1
            inner = Page()
            render(cell, inner, depth=depth)
            cells.append((column, inner.done()))
            wide = min(max(number(cell.attrs.get("colspan"), 1), 1), MOST_SPAN)
            tall = min(max(number(cell.attrs.get("rowspan"), 1), 1), 65534)
            below.update({column + i: tall for i in range(wide)} if tall > 1 else {})
            column += wide
        taken = {c: n for c, n in {**taken, **below}.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        if any(text for _, text in cells):
            grid.append(cells)
    if any("\n" in text or len(text) > WIDEST_CELL for cells in grid for _, text in cells):
        for i, cells in enumerate(grid):
            page.gap |= i > 0
            for _, text in cells:
                for line in text.split("\n") if text else []:
                    page.put(line)
                    page.end_line(bool(text))
        return
    width: dict[int, int] = {}
    for cells in grid:
        for column, text in cells:
            width[column] = max(width.get(column, 0), len(text))
    start, at = {}, 0
    for column in sorted(width):
        start[column] = at
        at += width[column] + 2
    for cells in grid:
        line = ""
        for column, text in cells:
            line = f"{line:<{start[column]}}{text}" if text else line
        page.put(line)
        page.end_line()


def visible_text(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null, empty and wholly hidden pages."""
    out = Page()
    render(parse(page or ""), out)
    return out.done()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``visible_text`` of every whole page.

    Null and empty pages have an empty text; pages of any length are read whole, one at a time; repeated rows are extracted each; an
    empty table gives no rows; a column named visible_text is replaced, others stay. Rows aren't shuffled.
    """
    return add_columns(pages, column, lambda c: [pa.array([visible_text(p) for p in c.to_pylist()], pa.string())], "visible_text string")
