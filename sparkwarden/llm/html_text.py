"""Layout-aware text of HTML pages: a tree with implied tags, and a rendering of all that a reader would see.

The tree builder closes what the markup leaves open (the head, paragraphs before blocks, list items, table rows and cells,
options), opens the rows that cells lack, and ignores end tags that match nothing. Hidden are scripts, styles, the head, templates, fallbacks for missing features,
elements with the attribute hidden, and those whose style says display: none or visibility: hidden. Blocks stand on lines
of their own, paragraphs, headings, lists, tables and quotes between blank lines; list items have a mark or number and are
indented by depth; cells of a table are padded to the width of their column, up to MAX_PAD characters.

Defined cases: null and empty pages give empty text, an empty table no rows. Text outside any element is shown. A tag, quoted
value or comment that the page never closes swallows the rest, as in browsers. Nested tables are shown as text of their
cell, however deep. What stands in a table but in no cell is shown before the table. Pages are rendered whole, of any
length and depth. Rows that share an id are rendered each on its own; other columns do not take part.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAD = 60
#: Characters that items of nested lists are indented by, at most.
MAX_INDENT = 80
#: Columns that a cell can span in browsers.
MAX_SPAN = 1000

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is text up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas title datalist".split())
#: Does not end an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup hr html legend li main menu nav option section summary tr caption thead tbody tfoot td th".split())
SECTIONS = frozenset("thead tbody tfoot".split())
IN_TABLE = SECTIONS | frozenset("caption colgroup col tr td th".split())
#: A start tag closes open elements of these kinds, up to one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"td", "th", "tr", "option", "html", "body", "thead", "tbody", "tfoot", "caption", "legend"}
#: An open p is not looked for beyond these.
P_SCOPE = frozenset("table td th caption button object html body".split())

#: Quotes delimit a value directly after = only; elsewhere they are letters.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))|(?!\s*+=)))*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for k, v in ATTRIBUTE.findall(self.attrs):
            if k.lower() == name:
                return html.unescape(v.strip("\"'"))
        return None

    def visible(self) -> bool:
        if self.tag in HIDDEN:
            return False
        return not self.attrs or (self.attribute("hidden") is None and not INVISIBLE.search(self.attribute("style") or ""))


class Open(list):
    """The open elements, and how many of each kind there are: most tags need not look for one."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.kinds: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self[-1].children.append(node)
        self.append(node)
        self.kinds[node.tag] += 1

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        for node in self[k:]:
            self.kinds[node.tag] -= 1
        del self[k:]


def _to_table(open_: Open, tag: str) -> None:
    """Closes all in an open table that cannot hold a part of this kind; opens the row of a cell. A table in no cell ends the open one."""
    for k in range(len(open_) - 1, 0, -1):
        kind = open_[k].tag
        if tag == "table":
            if kind in ("td", "th", "caption"):
                return
            if kind == "table":
                open_.cut(k)
                return
        elif tag in ("td", "th") and kind == "tr":
            open_.cut(k + 1)
            return
        elif kind == "table":
            keep = tag in ("tr", "td", "th") and k + 1 < len(open_) and open_[k + 1].tag in SECTIONS
            open_.cut(k + 1 + keep)
            if tag in ("td", "th"):
                open_.push(Node("tr"))
            return


def build(page: str) -> Node:
    root = Node("#root")
    open_ = Open(root)

    def say(text: str) -> None:
        while open_[-1].tag == "head" and BLANKS.sub("", text):
            open_.cut(len(open_) - 1)
        open_[-1].children.append(text)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(html.unescape(page[at:]))
            break
        if lt > at:
            say(html.unescape(page[at:lt]))
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        if not (nxt.isalpha() or (nxt == "/" and page[lt + 2 : lt + 3].isalpha())):
            say("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            break
        at = m.end()
        tag = m[1].lower()
        if nxt == "/":
            for k in range(len(open_) - 1, 0, -1) if open_.kinds[tag] > 0 else ():
                if open_[k].tag == tag:
                    open_.cut(k)
                    break
                if open_[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        while open_[-1].tag == "head" and tag not in IN_HEAD:
            open_.cut(len(open_) - 1)
        if tag in CLOSES_P and open_.kinds["p"] > 0:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    open_.cut(k)
                    break
                if open_[k].tag in P_SCOPE:
                    break
        if tag in IMPLIED:
            close, stop = IMPLIED[tag]
            last = 0
            for k in range(len(open_) - 1, 0, -1) if any(open_.kinds[x] > 0 for x in close) else ():
                if open_[k].tag in stop:
                    break
                if open_[k].tag in close:
                    last = k
            if last:
                open_.cut(last)
        if open_.kinds["table"] > 0 and (tag == "table" or (tag in IN_TABLE and tag != "col")):
            _to_table(open_, tag)
        node = Node(tag, m[2])
        if tag not in RAW and tag not in VOID:
            open_.push(node)
            continue
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag == "textarea":
                node.children.append(html.unescape(page[at : end.start() if end else n]))
            elif tag == "xmp":
                node.children.append(page[at : end.start() if end else n])
            at = end.start() if end else n
            if end:
                close_at = page.find(">", at)
                at = close_at + 1 if close_at >= 0 else n
    return root


class Writer:
    """Lines of text; knows how many line ends must come before the next word."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks, self.space, self.prefix, self.empty = 0, False, "", True

    def need(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.space = False

    def _begin(self) -> None:
        if self.breaks:
            if not self.empty:
                self.out.append("\n" * self.breaks)
            self.out.append(self.prefix)
            self.breaks, self.space = 0, False
        elif self.empty:
            self.out.append(self.prefix)
        self.empty = False

    def text(self, s: str) -> None:
        words = BLANKS.sub(" ", s)
        if words in ("", " "):
            self.space = self.space or (words == " " and not self.breaks and not self.empty)
            return
        lead = (words[0] == " " or self.space) and not self.breaks and not self.empty
        self._begin()
        if lead:
            self.out.append(" ")
        self.space = words[-1] == " "
        self.out.append(words.strip(" "))

    def lines(self, lines: list[str]) -> None:
        for i, line in enumerate(lines):
            if i:
                self.need(1)
                self.breaks = 1
            self._begin()
            self.out.append(line)

    def done(self) -> str:
        return "\n".join(x.rstrip(" \t") for x in "".join(self.out).split("\n"))


def _marked(node: Node) -> Iterator[tuple[Node, str]]:
    """Items of a list with their marks."""
    start = node.attribute("start") if node.tag == "ol" else None
    number = int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            own = child.attribute("value")
            if own and re.fullmatch(r"-?\d{1,9}", own):
                number = int(own)
            yield child, f"{number}. " if node.tag == "ol" else "- "
            number += 1


def _table(node: Node, stats: dict) -> tuple[list[str], list]:
    """Lines of a table, and what stands in it but in no cell."""
    rows: list[list[str]] = []
    strays: list = []
    todo = list(reversed(node.children))
    caption: list[str] = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            strays += [x] * bool(BLANKS.sub("", x))
            continue
        if not x.visible():
            continue
        if x.tag == "tr":
            cells: list[str] = []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th") and c.visible():
                    inner = Writer()
                    render(c, inner, stats)
                    cells.append(" ".join(inner.done().split()))
                    span = c.attribute("colspan")
                    cells += [""] * (max(0, min(int(span), MAX_SPAN) - 1) if span and re.fullmatch(r"\d{1,9}", span) else 0)
                elif isinstance(c, str):
                    strays += [c] * bool(BLANKS.sub("", c))
                elif c.tag not in ("td", "th"):
                    strays.append(c)
            if any(cells):
                rows.append(cells)
        elif x.tag == "caption":
            inner = Writer()
            render(x, inner, stats)
            caption.append(" ".join(inner.done().split()))
        elif x.tag in IN_TABLE and x.tag not in ("td", "th"):
            todo += reversed(x.children)
        else:
            strays.append(x)
    stats["rows"] += len(rows)
    width = [0] * max(map(len, rows), default=0)
    for r in rows:
        for k, c in enumerate(r):
            width[k] = max(width[k], min(len(c), MAX_PAD))
    return [c for c in caption if c] + ["  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows], strays


def render(root: Node, w: Writer, stats: dict) -> None:
    todo: list = list(reversed(root.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            w.text(x)
        elif isinstance(x, tuple):
            kind, value = x
            if kind == "need":
                w.need(value)
            elif kind == "prefix":
                w.prefix = value
            elif kind == "table":
                w.need(2)
                if value:
                    stats["blocks"] += 1
                    w.lines(value)
                w.need(2)
            else:  # an item's mark: its first line has it, the others are indented
                deep, mark = value
                deep = deep[:MAX_INDENT]
                w.need(1)
                w.prefix = deep + mark
                w._begin()
                w.prefix = deep + " " * len(mark)
        elif not x.visible():
            continue
        elif x.tag == "br":
            if w.breaks:
                w.need(min(w.breaks + 1, 2))
            else:
                w.need(1)
        elif x.tag in ("pre", "xmp"):
            w.need(2)
            inner: list[str] = []
            stack = list(reversed(x.children))
            while stack:
                y = stack.pop()
                if isinstance(y, str):
                    inner.append(y)
                elif y.tag == "br":
                    inner.append("\n")
                elif y.visible():
                    stack += reversed(y.children)
            lines = "".join(inner).replace("\r\n", "\n").strip("\n").split("\n")
            if any(map(str.strip, lines)):
                stats["blocks"] += 1
                w.lines(lines)
            w.need(2)
        elif x.tag == "table":
            lines, strays = _table(x, stats)
            todo += reversed([*strays, ("table", lines)])
        elif x.tag in ("ul", "ol", "menu"):
            before = w.prefix
            edge = 1 if before else 2
            w.need(edge)
            own: list = []
            marks = dict(_marked(x))
            for c in x.children:
                if isinstance(c, Node) and c in marks:
                    if c.visible():
                        stats["items"] += 1
                        own += [("item", (before, marks[c])), *c.children, ("prefix", before), ("need", 1)]
                else:
                    own.append(c)
            todo += reversed([*own, ("prefix", before), ("need", edge)])
        elif x.tag in BLOCK:
            gap = 2 if x.tag in SPACED else 1
            w.need(gap)
            if x.tag in SPACED or x.tag == "div":
                stats["blocks"] += 1
            todo.append(("need", gap))
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)


def page_text(page: str | None) -> tuple[str, int, int, int]:
    """Text, number of blocks, of list items and of table rows."""
    stats = {"blocks": 0, "items": 0, "rows": 0}
    w = Writer()
    render(build(page or ""), w, stats)
    return w.done(), stats["blocks"], stats["items"], stats["rows"]


def _rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # a table within a cell takes two calls
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [page_text(x.as_py()) for x in part.column("_html")]
            text, blocks, items, rows = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(blocks, pa.int64()), pa.array(items, pa.int64()), pa.array(rows, pa.int64())], ["page_id", "text", "n_chars", "n_blocks", "n_list_items", "n_table_rows"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars, n_blocks, n_list_items, n_table_rows."""
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(_rendered, "page_id long, text string, n_chars long, n_blocks long, n_list_items long, n_table_rows long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the visible text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
