"""HTML extraction by layout-aware rendering.

A page is cut into tags and text, a tree builder closes and opens the tags
that HTML implies, and a renderer emits all text that a reader would see:

* Block elements begin on a new line; paragraphs, headings, lists, tables and
  the like keep a blank line around them; ``br`` breaks a line; ``pre`` keeps
  its white space, which is folded elsewhere.
* List items get ``-`` or their number, nested lists are indented.
* Table cells are padded to the width of their column (in code points), with
  two spaces between columns; ``colspan`` and ``rowspan`` keep cells aligned;
  a cell of several lines takes several lines of its row.
* Formulas and the labels of drawings (``math``, ``svg``) are text, each label
  on a line; their annotations, titles, descriptions, definitions and metadata
  are not.
* Not visible: ``head``, scripts, styles, templates, comments, embedded
  objects, elements with ``hidden``, ``display:none`` or
  ``visibility:hidden`` (inner ``visibility:visible`` shows again), closed
  ``details`` but for their summary, and closed ``dialog``.

Only inline styles are read. Elements nest to any depth: the tree is rendered
with a stack of its own, and the builder finds open elements by name. Only the
layout has a bound: lists, quotes and tables inside ``DEPTH`` others add no
further indent or columns (their text, marks and visibility stay), as lines
would grow with the square of the depth.

Defined results: a null or empty page has empty text; broken markup never
fails (a ``<`` that opens no tag is text, an unknown end tag is ignored, open
elements end with the page). Rows that share a page_id are rows of their own.
Other columns are never read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revlens.llm.common import bound_batches

DEPTH = 200

# ------------------------------------------------------------------- tokens

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])|\Z", re.I) for n in (
    "script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "noscript")}
_FOLD = re.compile(r"[ \t\n\r\f]+")

# ------------------------------------------------- what HTML says of elements
# fixed values of the HTML standard

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set("head script style template noscript title iframe noembed noframes object canvas audio video "
              "datalist".split())
_MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset menu dir form".split())
_BLOCK = _MARGIN | set(
    "html body div article section nav aside header footer main address center details summary dialog figcaption "
    "hgroup li dt dd legend option optgroup select textarea caption tr td th thead tbody tfoot xmp listing".split())
_CLOSES_P = _BLOCK - set("li dt dd tr td th thead tbody tfoot caption option optgroup select textarea html body "
                         "legend".split()) | {"hr", "li", "dd", "dt"}
#: elements whose end tag leaves blocks within them open
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
#: elements that are no blocks here, whose end tag ends all within them
_SCOPES = set("button object applet marquee template svg math foreignobject".split())
#: start tag: the open elements it ends, and the elements that stop the search
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
_ENDS["thead"] = _ENDS["tfoot"] = _ENDS["tbody"]
#: within svg and math: not shown
_FOREIGN_HIDDEN = set("annotation annotation-xml title desc defs metadata".split())
_HEAD_ONLY = set("base link meta title style script template noscript noframes".split())


class Node:
    __slots__ = ("name", "attrs", "inner", "foreign")

    def __init__(self, name: str, attrs: str = "", foreign: bool = False):
        self.name, self.attrs, self.inner, self.foreign = name, attrs, [], foreign

    def closed(self) -> bool:
        """Whether the tag closes itself, as tags of svg and math may."""
        return self.foreign and self.attrs.endswith("/") and not re.search(r"=\s*[^\s\"'>]+/$", self.attrs)

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(self.attrs)} if self.attrs else {}


def build(page: str) -> Node:
    """Tree of a page; text is plain strings among the nodes."""
    root = Node("html")
    path = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the path elements of a name are open

    def last(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def cut(at: int) -> None:
        for node in path[at:]:
            places[node.name].pop()
        del path[at:]

    def end(names: set[str], stops: set[str]) -> None:
        """End the outermost open element of ``names`` inside of ``stops``."""
        stop, found = last(stops), []
        for own in (places[n] for n in names):
            found += own[(k := bisect_right(own, stop)):k + 1]
        if found:
            cut(min(found))

    def start(name: str, attrs: str) -> None:
        if name in ("html", "body"):  # one of each, which the tree need not show
            end({"head"}, set())
            if attrs and name == "body" and _unseen(Node(name, attrs)):
                root.attrs = attrs
            return
        if name not in _HEAD_ONLY and name != "head":
            end({"head"}, set())
        if name in _CLOSES_P:
            end({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if name in _ENDS:
            end(*_ENDS[name])
        if name in ("td", "th") and path[-1].name in ("table", "tbody", "thead", "tfoot"):
            start("tr", "")
        if name == "form" and path[-1].name in ("table", "tbody", "thead", "tfoot", "tr"):
            return  # an empty element there: rows and cells are not inside of it
        node = Node(name, attrs, last({"svg", "math"}) > last({"foreignobject"}) or name in ("svg", "math"))
        path[-1].inner.append(node)
        if name not in _VOID and not node.closed():
            places[name].append(len(path))
            path.append(node)

    def end_tag(name: str) -> None:
        """An end tag. It reaches out of no inner cell or table. That of a
        formatting element or link ends it alone: blocks within stay open. That
        of another element which is no block reaches out of no block."""
        if name in ("table", "tr", "tbody", "thead", "tfoot"):
            stop = last({"table"} - {name})
        else:
            stop = last({"td", "th", "table"} - {name})
        if not places[name] or places[name][-1] <= stop:
            return
        at = places[name][-1]
        block = next((k for k in range(at + 1, len(path)) if path[k].name in _BLOCK), None)
        if block is None or name in _BLOCK or name in _SCOPES:
            cut(at)
        elif name in _FORMATTING:
            # the blocks go on; those of a hidden element go on beside it
            kept, apart = path[block:], _unseen(path[at])
            cut(at)
            for node in kept:
                if apart:
                    node = Node(node.name, node.attrs, node.foreign)
                    path[-1].inner.append(node)
                places[node.name].append(len(path))
                path.append(node)

    def text(data: str) -> None:
        if path[-1].name == "head" and not data.isspace():
            end({"head"}, set())
        path[-1].inner.append(data)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if found is None:
            if at < len(page):
                text(html.unescape(page[at:]))
            return root
        if found.start() > at:
            text(html.unescape(page[at:found.start()]))
        at = found.end()
        name = found["start"] or found["loose"]
        if name:
            name = name.lower()
            start(name, found["attrs"] or found["rest"] or "")
            raw = _RAW.get(name)
            if raw and path[-1].name == name and not path[-1].inner:
                stop = raw.search(page, at).start()
                path[-1].inner.append(html.unescape(page[at:stop]) if name in ("title", "textarea") else page[at:stop])
                cut(len(path) - 1)
                close = page.find(">", stop)
                at = len(page) if close < 0 else close + 1
        elif found["end"]:
            name = found["end"].lower()
            if name == "br":
                start("br", "")
            elif name == "p" and not places["p"]:
                path[-1].inner.append(Node("p"))
            else:
                end_tag(name)


# ---------------------------------------------------------------- rendering

def _style(attrs: dict[str, str], name: str) -> str:
    value = ""
    for rule in attrs.get("style", "").lower().split(";"):
        key, _, v = rule.partition(":")
        if key.strip() == name:
            value = v.replace("!important", "").strip()
    return value


def _unseen(node: Node) -> bool:
    if node.name in _HIDDEN or node.foreign and node.name in _FOREIGN_HIDDEN:
        return True
    if not node.attrs:
        return node.name == "dialog"
    attrs = node.attributes()
    return ("hidden" in attrs or _style(attrs, "display") == "none" or node.name == "dialog" and "open" not in attrs)


class Page:
    """Lines of one flow of blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []  # pieces of the line that is being written
        self.gap = 0  # blank lines due before the next line
        self.mark = ""  # of the list item whose first text comes next

    def write(self, data: str, pre: bool) -> None:
        if pre:
            if self.mark and not data.isspace():
                data, self.mark = self.mark + data, ""
            first, *rest = data.replace("\r\n", "\n").split("\n")
            if first:
                self.open.append(first)
            for line in rest:
                self.end_line(keep=True)
                if line:
                    self.open.append(line)
            return
        data = _FOLD.sub(" ", data)
        if data[0] == " " and (not self.open or self.open[-1].endswith(" ")):
            data = data[1:]
        if data:
            if self.mark and data != " ":
                data, self.mark = self.mark + data, ""
            self.open.append(data)

    def end_line(self, keep: bool = False, pre: bool = False) -> None:
        line = "".join(self.open)
        self.open = []
        line = line.rstrip(" \n") if not (keep or pre) else line.rstrip()
        if line or keep:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)

    def block(self, margin: bool) -> None:
        self.end_line()
        if margin:
            self.gap = 1

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def run(task: Generator) -> object:
    """Result of a generator that yields the generators it waits for."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _shown(node: Node, seen: bool) -> bool:
    """Whether text right in ``node`` is visible."""
    if node.attrs and "visibility" in node.attrs.lower():
        value = _style(node.attributes(), "visibility")
        return value == "visible" if value in ("visible", "hidden", "collapse") else seen
    return seen


def _flow(nodes: list, page: Page, seen: bool, pre: bool, level: int = 0) -> Generator:
    """``level`` counts the lists, quotes and tables around."""
    for node in nodes:
        if isinstance(node, str):
            if seen and node:
                page.write(node, pre)
            continue
        name = node.name
        if _unseen(node):
            continue
        shown = _shown(node, seen)
        if name == "br":
            page.end_line(keep=True)
        elif name == "hr":
            page.block(True)
        elif name in ("ul", "ol", "menu", "dir"):
            yield _list(node, page, shown, pre, level + 1)
        elif name == "table" and level < DEPTH:
            page.block(True)
            lines = yield _table(node, shown, level + 1)
            if lines:
                page.put(lines)
                page.gap = 1
        elif name == "details" and "open" not in node.attributes():
            page.block(False)
            first = [n for n in node.inner if not isinstance(n, str) and n.name == "summary"][:1]
            yield _flow(first, page, shown, pre, level)
            page.block(False)
        elif name in ("pre", "listing", "xmp", "textarea"):
            page.block(name != "textarea")
            inner = list(node.inner)
            if inner and isinstance(inner[0], str) and inner[0].startswith("\n"):
                inner[0] = inner[0][1:]  # the line end after the tag is not text
            yield _flow(inner, page, shown, True, level)
            page.end_line(pre=True)
            page.block(name != "textarea")
        elif name in ("dd", "blockquote") and level < DEPTH:
            page.block(name == "blockquote")
            sub = Page()
            yield _flow(node.inner, sub, shown, pre, level + 1)
            lines = sub.result()
            if lines:
                page.put(["  " + x if x else x for x in lines])
            page.block(name == "blockquote")
        elif name in _BLOCK or name == "text" and node.foreign:
            page.block(name in _MARGIN)
            yield _flow(node.inner, page, shown, pre, level)
            page.block(name in _MARGIN)
        elif node.inner:
            yield _flow(node.inner, page, shown, pre, level)


def _list(node: Node, page: Page, seen: bool, pre: bool, level: int) -> Generator:
    page.block(True)
    start = node.attributes().get("start", "1") if node.name == "ol" else ""
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    out: list[str] = []
    for item in node.inner:
        own = not isinstance(item, str) and item.name == "li"
        if own and _unseen(item):
            continue
        sub = Page() if level <= DEPTH else page
        mark = "" if not own else f"{number}. " if node.name == "ol" else "- "
        if sub is page:
            page.block(False)
            page.mark += mark
            due = page.mark
        if not own:
            yield _flow([item], sub, seen, pre, level)
        else:
            yield _flow(item.inner, sub, _shown(item, seen), pre, level)
            number += 1
        if sub is page:
            page.end_line()
            if page.mark == due:  # nothing visible came
                page.mark = due[:len(due) - len(mark)]
            continue
        if not own:
            out += ["  " + x if x else x for x in sub.result()]
            continue
        lines = sub.result()
        if lines:
            # a nested list follows its item without a blank line
            lines = [x for k, x in enumerate(lines) if x or not re.match(r" *(-|\d+\.) ", lines[k + 1])]
            out += [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])]
    if out:
        page.put(out)
        page.gap = 1


#: More rows than a row group has.
_REST = 1 << 62


def _span(attrs: dict[str, str], name: str, least: int, most: int) -> int:
    value = re.match(r"\s*\+?([0-9]{1,9})", attrs.get(name, ""))
    return min(most, int(value[1])) if value and int(value[1]) >= least else 1


def _table(node: Node, seen: bool, level: int) -> Generator:
    captions, rows = [], []
    waiting = [(part, seen, 0) for part in node.inner[::-1]]
    other, groups = [], 0
    while waiting:
        part, shown, group = waiting.pop()
        if isinstance(part, str):
            if part.strip():
                other.append((part, shown))
        elif _unseen(part):
            continue
        elif part.name in ("tbody", "thead", "tfoot"):
            groups += 1
            inside = _shown(part, shown)
            waiting += [(p, inside, groups) for p in part.inner[::-1]]
        elif part.name == "tr":
            rows.append((part, _shown(part, shown), group))
        elif part.name == "caption":
            captions.append((part, _shown(part, shown)))
        else:
            other.append((part, shown))
    grid: list[dict[int, tuple[int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows below that a cell still covers
    last_group = 0
    for row, seen_row, group in rows:
        if group != last_group:  # a cell covers rows of its own group only
            taken, last_group = {}, group
        line: dict[int, tuple[int, list[str]]] = {}
        column, below = 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.inner:
            if isinstance(cell, str) or cell.name not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    other.append((cell, seen_row))
                continue
            if _unseen(cell):
                continue
            while taken.get(column):
                column += 1
            attrs = cell.attributes()
            wide, tall = _span(attrs, "colspan", 1, 1000), _span(attrs, "rowspan", 0, 65534) or _REST
            sub = Page()
            yield _flow(cell.inner, sub, _shown(cell, seen_row), False, level)
            line[column] = (wide, sub.result())
            if tall > 1:
                below.update({c: max(below.get(c, 0), tall - 1) for c in range(column, column + wide)})
            column += wide
        taken = below
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for c, (wide, text) in line.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), max(map(len, text), default=0))
    columns = max((c + wide for line in grid for c, (wide, _) in line.items()), default=0)
    for line in grid:  # what a wide cell needs beyond its columns, the last one gets
        for c, (wide, text) in line.items():
            if wide > 1:
                have = sum(width.get(k, 0) for k in range(c, c + wide)) + 2 * (wide - 1)
                width[c + wide - 1] = width.get(c + wide - 1, 0) + max(0, max(map(len, text), default=0) - have)
    used = [c for c in range(columns) if width.get(c)]
    place, at = {}, 0
    for c in range(columns + 1):
        place[c] = at
        if width.get(c):
            at += width[c] + 2
    out: list[str] = []
    sub = Page()
    for part, shown in other:  # text that the table misplaces stands before it
        yield _flow([part], sub, shown, False, level)
    out += sub.result()
    for caption, shown in captions:
        sub = Page()
        yield _flow(caption.inner, sub, shown, False, level)
        out += sub.result()
    if not used:
        return out
    for line in grid:
        for k in range(max((len(text) for _, text in line.values()), default=0)):
            written = ""
            for c in sorted(line):
                text = line[c][1]
                if k < len(text) and text[k]:
                    written = written.ljust(place[c]) + text[k]
            out.append(written)
    return out


def render(page: str | None) -> str:
    """Visible text of one page."""
    if not page:
        return ""
    root, out = build(page), Page()
    if not _unseen(root):
        run(_flow(root.inner, out, True, False))
    return "\n".join(out.result())


# -------------------------------------------------------------------- Spark

def visible_text(pages: DataFrame) -> DataFrame:
    """``(page_id, text)`` for every row."""
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "html")
    schema = T.StructType([rows.schema["page_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [render(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(text, pa.string())], ["page_id", "text"])

    return rows.mapInArrow(run, schema)


def op7_html_text(pages: DataFrame) -> DataFrame:
    """page_id and the page's visible text."""
    return visible_text(pages)
