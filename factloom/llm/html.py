"""Layout-aware HTML extraction.

A tree builder reads a page tag by tag: end tags that HTML lets a writer leave out are implied, void elements
have no content, and raw-text elements end at their own end tag only. A renderer then walks the tree:
elements that are never shown, or are hidden by their attributes, are skipped, but what is made visible again in
an invisible one; blocks stand on lines of their own, with a blank line where a browser leaves space; list items have
marks and are indented; preformatted text keeps its white space; and the cells of a table are padded to aligned
columns, also where a cell spans several. What stands in a table but in no cell comes before the table, as in
browsers, which find cells inside forms and the like. Tables deeper than DEEP in others are laid out as blocks.

Both walks keep stacks of their own, and each step looks things up by name, so time is linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right as bisect
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg annotation annotation-xml mphantom datalist area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir pre table figure fieldset hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends open elements of these names, but only within the scope that follows.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: End tags don't reach beyond these.
WALLS = frozenset(("table", "td", "th", "caption", "button", "template", "html"))

#: Tables within tables that are aligned; columns and rows that a cell spans at most (fixed values of the standard).
DEEP, MOST_COLUMNS, MOST_ROWS = 8, 1000, 65534

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|$))|<[!?][^>]*(?:>|$)|</[^A-Za-z][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([\"'])|([^\s>]*)))?+)")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)\b", re.I)
_VEILED = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
KEPT = frozenset("hidden style type start value alt display open colspan rowspan".split())


class Node:
    __slots__ = ("name", "attrs", "parts", "grid")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.parts = name, attrs, []
        self.grid: list[str] | None = None  # of a table: its lines


class _Open:
    """The open elements, with the places of each name among them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        for node in self.stack[i:]:
            self.at[node.name].pop()
        del self.stack[i:]

    def last(self, names: Iterable[str]) -> int:
        """The innermost place of some names; 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, name: str) -> None:
        i = self.last((name,))
        if not i and name in ("br", "p"):
            self.stack[-1].parts.append(Node(name, {}))
        elif i and (name in TABLE_ENDS or self.last(WALLS) <= i):
            self.cut(i)

    def imply(self, name: str) -> None:
        """Ends what a start tag ends."""
        if name in CLOSES_P and (i := self.last(("p",))) > self.last(WALLS):
            self.cut(i)
        ended, scope = IMPLIED.get(name, ((), ()))
        if ended:
            inner = self.last(scope)
            places = [at[k] for n in ended if (at := self.at.get(n)) and (k := bisect(at, inner)) < len(at)]
            if places:
                self.cut(min(places))


#: End tags that reach beyond walls.
TABLE_ENDS = frozenset("table tr td th tbody thead tfoot body html".split())


def _attributes(page: str, at: int, wanted: bool) -> tuple[dict[str, str], int]:
    """The attributes of a tag that counts, and where it ends: -1 if the page ends within it."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None or m[5]:  # the end, or a quote that isn't closed
            return out, -1
        at = m.end()
        if m[1]:
            return out, at
        if wanted and (key := m[2].lower()) in KEPT:
            out.setdefault(key, html.unescape(m[3] or m[4] or m[6] or ""))


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are nodes and strings. Any text is a page."""
    root = Node("", {})
    open_, at, end, since = _Open(root), 0, len(page), 0

    def text(to: int) -> None:
        if to > since:
            open_.stack[-1].parts.append(html.unescape(page[since:to]))

    while (at := page.find("<", at)) >= 0:
        m = _TAG.match(page, at)
        if m is None:
            other = _OTHER.match(page, at)
            if other is None:  # a sign like any other
                at += 1
                continue
            text(at)
            at = since = other.end()
            continue
        name, start = m[2].lower(), at
        attrs, at = _attributes(page, m.end(), not m[1])
        if at < 0:  # the page ends in a tag, of which nothing is shown; where no tag can end any more, it is text
            text(end if page.find(">", start) < 0 else start)
            return root
        text(start)
        since = at
        if m[1]:
            open_.close(name)
            continue
        open_.imply(name)
        node = Node(name, attrs)
        open_.stack[-1].parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw, at = (page[at : close.start()], close.end()) if close else (page[at:], end)
            node.parts.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            since = at
        elif name not in VOID:
            open_.push(node)
    text(end)
    return root


def hidden(node: Node) -> bool:
    """Whether nothing in a node is shown."""
    a = node.attrs
    if node.name in UNSEEN or node.name == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a and a["hidden"].lower() != "until-found" or node.name == "input" and a.get("type", "").lower() == "hidden" or bool(_HIDDEN.search(a.get("style", ""))))


def veil(node: Node) -> str:
    """What a node says of its visibility: visible, hidden, or nothing."""
    m = _VEILED.findall(node.attrs.get("style", "")) if node.attrs else ()
    return ("visible" if m[-1].lower() == "visible" else "hidden") if m else ""


def _unveiled(node: Node) -> list[Node]:
    """What is made visible again in an invisible node."""
    out, todo = [], [iter(node.parts)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif not isinstance(part, str) and not hidden(part):
            if veil(part) == "visible":
                out.append(part)
            else:
                todo.append(iter(part.parts))
    return out


class _Page:
    """Lines of text as they are written: one open line, its pending blank, and the space wanted before the next block."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.blank, self.gap, self.indent, self.mark = False, 0, "", ""

    def write(self, text: str) -> None:
        squeezed = _BLANK.sub(" ", text)
        if squeezed[:1] == " ":
            self.blank = True
            squeezed = squeezed[1:]
        if not squeezed:
            return
        last = squeezed[-1] == " "
        if self.open and self.blank:
            self.open.append(" ")
        self.start()
        self.open.append(squeezed[:-1] if last else squeezed)
        self.blank = last

    def start(self) -> None:
        if not self.open:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.open.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""

    def end(self) -> None:
        if self.open:
            self.lines.append("".join(self.open).rstrip())
            self.open = []
        self.blank = False

    def space(self) -> None:
        self.end()
        self.gap = 1

    def full(self, lines: list[str]) -> None:
        for line in lines:
            self.end()
            self.start()
            self.open.append(line)
            self.end()

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.expandtabs(8).split("\n")):
            if i:
                self.start()
                self.end()
            if line:
                self.start()
                self.open.append(line)


def render(root: Node) -> str:
    """The visible text of a tree. Tables are laid out from the inside, so none waits for another."""
    tables, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        depth += node.name == "table"
        if node.name == "table" and depth <= DEEP:
            tables.append(node)
        todo += [(x, depth) for x in node.parts if not isinstance(x, str)]
    for table in reversed(tables):  # those around others come first in the list
        table.grid = _table(_parted(table)[1])
    return _text(root)


def _text(root: Node) -> str:
    page = _Page()
    _render(page, root)
    page.end()
    return "\n".join(page.lines).strip("\n")


def _render(page: _Page, root: Node) -> None:
    # an own stack: trees may be deeper than Python's
    todo: list = [iter(root.parts)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            page.write(part)
        elif callable(part):
            part()
        elif hidden(part):
            if part.name == "table":  # what it has outside its cells isn't hidden with it
                todo.append(iter(_parted(part)[0]))
        elif veil(part) == "hidden":
            edge = [page.end] if part.name in BLOCK else []
            todo.append(iter([*edge, *_unveiled(part), *edge]))
        else:
            todo.append(iter(_shown(page, part)))


def _shown(page: _Page, node: Node) -> list:
    """What a node comes to: strings, nodes, and things to do before, between and after."""
    name = node.name
    if name == "br":
        return [lambda: (page.start(), page.end())]
    if name == "hr":
        return [page.space, lambda: page.write("---"), page.space]
    if name == "img":
        return [node.attrs.get("alt", "")]
    if name == "input":
        return [f" {node.attrs.get('value', '')} "]
    if name == "pre":
        return [page.space, lambda: page.raw(_plain(node).removeprefix("\n")), page.space]
    if name == "table":
        loose, rows = _parted(node)
        if node.grid is None:
            return [*loose, page.space, *(x for kind, cells in rows for x in (page.end, *cells, page.end)), page.space]
        return [*loose, page.space, lambda: page.full(node.grid), page.space]
    if name == "details" and "open" not in node.attrs:
        return [page.end, *(x for x in node.parts if isinstance(x, Node) and x.name == "summary"), page.end]
    if name in ("ul", "ol", "menu", "dir"):
        return _list(page, node)
    if name in ("td", "th", "mtd"):
        return [" ", *node.parts, " "]
    if name == "mfrac":
        return [x for part in node.parts for x in (" ", part)] + [" "]
    if name == "math" and node.attrs.get("display", "").lower() == "block":
        return [page.end, *node.parts, page.end]
    if name in ("blockquote", "dd"):
        before = page.indent

        def into() -> None:
            page.indent = before + "    "

        def back() -> None:
            page.end()
            page.indent = before

        edge = page.space if name == "blockquote" else page.end
        return [edge, into, *node.parts, back, edge]
    if name in BLOCK or name in ("tr", "caption"):
        edge = page.space if name in SPACED else page.end
        return [edge, *node.parts, edge]
    return node.parts


def _list(page: _Page, node: Node) -> list:
    before, inner = page.indent, page.indent != ""
    edge = page.end if inner else page.space
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    out: list = [edge]
    for part in node.parts:
        if isinstance(part, Node) and part.name == "li" and not hidden(part):
            if re.fullmatch(r"-?\d{1,9}", part.attrs.get("value", "")):
                number = int(part.attrs["value"])
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1

            def item(mark: str = mark) -> None:
                page.end()
                page.indent, page.mark = before + " " * len(mark), mark

            def done() -> None:
                page.end()
                page.indent, page.mark = before, ""

            out += [item, *part.parts, done]
        else:
            out.append(part)
    return [*out, edge]


def _plain(node: Node) -> str:
    out, todo = [], [iter(node.parts)]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            out.append(part)
        elif part.name == "br":
            out.append("\n")
        elif not hidden(part):
            todo.append(iter(part.parts))
    return "".join(out)


TABLE_PARTS = frozenset("thead tbody tfoot tr td th caption".split())


def _wrappers(table: Node) -> set[int]:
    """The ids of the nodes between a table and parts of it."""
    found: set[int] = set()
    todo = [(iter(table.parts), table)]
    while todo:
        part = next(todo[-1][0], None)
        if part is None:
            todo.pop()
        elif isinstance(part, Node) and part.name != "table":
            if part.name in TABLE_PARTS:
                for _, node in reversed(todo):
                    if id(node) in found:
                        break
                    found.add(id(node))
            if part.name not in ("td", "th", "caption") and part.name not in UNSEEN:
                todo.append((iter(part.parts), part))
    return found


def _parted(table: Node) -> tuple[list, list[tuple[str, list]]]:
    """What stands in a table outside its cells, and its rows: (row or caption, cells)."""
    loose: list = []
    rows: list[tuple[str, list]] = []
    wrappers, row = _wrappers(table), None
    # iterator, node, whether its cells are hidden, whether its other content is
    todo = [(iter(table.parts), table, False, False)]
    while todo:
        parts, node, dark, veiled = todo[-1]
        part = next(parts, None)
        if part is None:
            todo.pop()
            if node.name in TABLE_PARTS:
                row = None
        elif isinstance(part, str) or part.name not in TABLE_PARTS and id(part) not in wrappers:
            if not veiled and not (isinstance(part, str) and not part.strip(" \t\n\r\f")):
                if node.name in BLOCK and node is not table:
                    around = Node("div", {})
                    around.parts = [part]
                    part = around
                loose.append(part)
        elif part.name in ("td", "th"):
            if row is None:
                row = []
                rows.append(("row", row))
            if not dark and not hidden(part):
                row.append(part)
        elif part.name == "caption":
            if not dark and not hidden(part):
                rows.append(("caption", [part]))
        elif part.name in TABLE_PARTS:
            row = None
            todo.append((iter(part.parts), part, dark or hidden(part), veiled))
        else:  # a form or the like, of which only what isn't part of the table can be hidden
            todo.append((iter(part.parts), part, dark, veiled or part.name != "form" and hidden(part)))
    return loose, rows


def _span(cell: Node, name: str, most: int) -> int:
    found = cell.attrs.get(name, "").strip()
    return min(most, int(found)) if re.fullmatch(r"\d{1,9}", found) else 1


def _table(rows: list[tuple[str, list[Node]]]) -> list[str]:
    """Rows as lines, cells padded to columns; a cell of several lines, and one with a table in it, is joined to one."""
    lines: list[tuple[str, list[tuple[int, int, str]]]] = []  # of a row's cells the first column, how many, and the text
    below: dict[int, int] = {}  # columns that cells of rows above still take, and for how many rows
    for kind, cells in rows:
        placed, at, taken = [], 0, {c: n - 1 for c, n in below.items() if n > 1}
        for cell in cells:
            content = Node("", {})
            content.parts = cell.parts if veil(cell) != "hidden" else _unveiled(cell)
            text = _BLANK.sub(" ", _text(content))
            if kind == "caption":
                placed.append((0, 1, text))
                continue
            while at in below:
                at += 1
            wide, tall = max(1, _span(cell, "colspan", MOST_COLUMNS)), _span(cell, "rowspan", MOST_ROWS) or MOST_ROWS
            placed.append((at, wide, text))
            if tall > 1:
                taken |= dict.fromkeys(range(at, at + wide), tall - 1)
            at += wide
        if kind == "row":
            below = taken
        lines.append((kind, placed))
    ends = sorted({at + wide for kind, cells in lines if kind == "row" for at, wide, _ in cells})
    column = {end: i for i, end in enumerate(ends)}  # columns in which no cell ends have no width of their own
    first = lambda at: bisect(ends, at)
    widths = [0] * len(ends)
    for alone in (True, False):
        for kind, cells in lines:
            for at, wide, text in cells if kind == "row" and (len(cells) > 1 or cells and cells[0][0]) else ():
                i, j = first(at), column[at + wide]
                if (i == j) == alone:
                    widths[j] += max(0, len(text) - sum(widths[i : j + 1]) - 2 * (j - i))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = []
    for kind, cells in lines:
        line = ""
        for at, _, text in cells:
            line = line.ljust(starts[first(at)] if kind == "row" else 0) + text
        if line.strip():
            out.append(line.rstrip())
    return out


def text_of(page: str | None) -> str:
    return render(parse(page)) if page else ""


@F.arrow_udf(StringType())
def visible_text(pages: pa.Array) -> pa.Array:
    return pa.array([text_of(p.as_py()) for p in pages], pa.string())


def extracted(pages: DataFrame, html_column: str = "html", others: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """others, text and n_words for each row of pages: one pass without a shuffle.

    Null and empty pages have empty texts; repeated rows get equal answers; a text without tags is a page; an empty
    table gives none; columns text and n_words of pages are replaced, others but those named left out.
    """
    words: Column = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return pages.select(*others, visible_text(F.col(html_column)).alias("text")).withColumn("n_words", words.cast("long"))
