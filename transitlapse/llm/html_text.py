"""HTML to text as a reader sees it: a tree with implied tags, visibility rules, and a layout of blocks.

Pages are parsed into a tree (tags that HTML leaves out are implied: a new paragraph, list item, cell or row ends the
open one), hidden subtrees are left out, and the rest is laid out: blocks on lines of their own, paragraphs apart,
list items with their mark and depth, preformatted text as it is, table cells padded to columns. A cell of several
lines is a block of lines beside its neighbours; cells may span columns and rows. Columns are aligned within a page
width: cells that start beyond PAGE characters, or after a text of more than WIDEST, follow two blanks behind, and
cells of rows above hold their place in the first MOST_COLUMNS columns. So space stays in proportion to a page's length.

Every page is worked on by itself, in time proportional to its length. Null pages and pages without visible text
give an empty text; broken markup never fails: what cannot be a tag is text. Repeated rows get equal texts, an empty
table an empty result; a kept column named like a result is replaced by it.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from transitlapse.llm import scan

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = set("head script style title template noscript iframe object audio video canvas svg math datalist "
             "noembed noframes meta link base".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
LINES = set("html body div section article aside nav header footer main address form li dt dd tr td th caption "
            "details summary figcaption legend center dir menu hr thead tbody tfoot option dialog search hgroup".split())
#: What a start tag ends when it is open, and the elements that stop the search for it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, {"td", "th", "table"}), "body": ({"head"}, set()),
}

#: Contents of a head; any other element, or text, ends a head that is open.
HEAD = set("title meta link base script style noscript template noframes basefont bgsound".split())
BUTTONS = ("submit", "button", "reset")
# The largest spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
WIDEST, PAGE = 80, 400

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CONCEALED = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: ``hidden`` takes out all that is inside, ``shown`` is inherited and can be set anew inside."""

    __slots__ = ("tag", "children", "attributes", "hidden", "shown")

    def __init__(self, tag: str, attributes: dict[str, str], shown: bool = True):
        self.tag, self.children, self.attributes = tag, [], attributes
        told = _VISIBILITY.findall(attributes.get("style", ""))
        self.shown = told[-1].lower() == "visible" if told else shown
        self.hidden = (tag in HIDDEN or "hidden" in attributes or bool(_CONCEALED.search(attributes.get("style", "")))
                       or (tag == "dialog" and "open" not in attributes))


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" | "start" | "end", name or text, attributes) from left to right."""
    at, last, quotes = 0, page.rfind(">"), True
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, lt)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end = _QUOTED.match(page, name.end()) if quotes else None
        if end is None:  # a quote that never closes: from here on tags end at the next bracket
            quotes = False
        at = end.end() if end else page.find(">", name.end()) + 1
        tag = name[1].lower()
        if page[lt + 1] == "/":
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end() : at - 1]
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else len(page)
            yield "text", page[at:stop], ""
            yield "end", tag, ""
            at = page.find(">", stop) + 1 if close else len(page)


def parse(page: str) -> Node:
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each name, so that no search walks the stack

    def close(tags: set[str], stop: set[str]) -> None:
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        at = last(tags)
        if at and at >= last(stop):
            for node in stack[at:]:
                places[node.tag].pop()
            del stack[at:]

    def imply(tag: str) -> None:
        """End what the tag ends, and open the row that a cell lies in."""
        if stack[-1].tag == "head" and tag not in HEAD:
            close({"head"}, set())
        if tag in PARAGRAPHS or tag in LINES:
            close({"p"}, {"td", "th", "table", "li", "button", "div", "section", "article"} if tag != "p" else {"td", "th", "table", "button"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr", {}, stack[-1].shown))

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    for kind, value, source in _tokens(page):
        if kind == "text":
            if stack[-1].tag == "head" and value.strip():
                close({"head"}, set())
            stack[-1].children.append(html.unescape(value) if "&" in value and stack[-1].tag not in ("script", "style") else value)
        elif kind == "end":
            if value == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", {}, stack[-1].shown))
            elif value not in ("html", "body"):
                close({value}, {"table"} if value not in ("table", "html") else set())
        elif value == "html":
            continue
        else:
            imply(value)
            node = Node(value, _attributes(source) if source.strip(" /\n\t") else {}, stack[-1].shown)
            if value in VOID:
                stack[-1].children.append(node)
            else:
                push(node)
    return root


class Layout:
    """Lines of text so far. Blocks ask for line ends before them; text brings its own spaces."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.due = 0  # line ends before the next text
        self.space = False
        self.indent: list[str] = []
        self.mark = ""

    def block(self, lines: int) -> None:
        self.due = max(self.due, lines)
        self.space = False

    def _put(self, text: str) -> None:
        if self.due or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.due)
            margin = "".join(self.indent)
            self.parts.append(margin[: -len(self.mark)] + self.mark if self.mark else margin)
            self.due, self.mark = 0, ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def text(self, raw: str) -> None:
        flat = _BLANKS.sub(" ", raw)
        body = flat.strip(" ")
        if flat.startswith(" "):
            self.space = not self.due
        if body:
            self._put(body)
            self.space = flat.endswith(" ")

    def preformatted(self, raw: str) -> None:
        for i, line in enumerate(raw.split("\n")):
            if i:
                self.due += 1
            if line.strip():
                self._put(line.rstrip())

    def result(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.parts).replace("\xa0", " ").split("\n"))


#: A step of the layout: asks for the text inside of nodes, one after the other.
Steps = Generator[Node, str, None]


def _span(cell: Node, name: str, most: int) -> int:
    told = cell.attributes.get(name, "").strip()
    return min(max(int(told), 1), most) if told.isascii() and told.isdigit() and len(told) < 10 else 1


def _table(node: Node, layout: Layout) -> Steps:
    rows: list = []
    for child in node.children:
        if isinstance(child, Node) and child.tag in ("thead", "tbody", "tfoot") and not child.hidden:
            rows += [c for c in child.children if child.shown or isinstance(c, Node)]
        elif isinstance(child, Node) or node.shown:
            rows.append(child)
    grid: list[list[tuple[int, int, list[str]]]] = []  # first column, columns and lines of each cell
    taken: dict[int, int] = {}  # the last row that a cell of a row above holds this column in
    number = 0
    for row in rows:
        if isinstance(row, str):
            if row.strip():
                grid.append([(0, 1, [_BLANKS.sub(" ", row).strip()])])
        elif not row.hidden and row.tag not in ("col", "colgroup"):
            cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] if row.tag == "tr" else []
            whole = not cells or any((c.strip() and row.shown if isinstance(c, str) else c not in cells and not c.hidden)
                                     for c in row.children)
            line, at = [], 0
            below: dict[int, int] = {}
            for c in [row] if whole else [c for c in cells if not c.hidden]:
                while taken.get(at, -1) >= number and not whole:
                    at += 1
                columns, down = (1, 1) if whole else (_span(c, "colspan", MOST_COLUMNS), _span(c, "rowspan", MOST_ROWS))
                text = yield c
                line.append((at, columns, text.split("\n")))
                if down > 1:
                    below.update(dict.fromkeys(range(at, min(at + columns, MOST_COLUMNS)), number + down - 1))
                at += columns
            taken.update(below)
            number += row.tag == "tr"
            grid.append(line)
    # Only columns at which some cell starts are laid out; cells alone in their row do not widen them.
    starts = sorted({at for line in grid for at, _, _ in line})
    place = {at: i for i, at in enumerate(starts)}
    width = [0] * len(starts)
    wide = []
    for line in grid:
        for at, columns, text in line if len(line) > 1 or any(c[0] for c in line) else []:
            first, last = place[at], bisect.bisect_left(starts, at + columns) - 1
            long = max(map(len, text))
            if long <= WIDEST:
                wide.append((last - first, first, last, long))
    for _, first, last, long in sorted(wide):
        width[last] = max(width[last], long - sum(w + 2 for w in width[first:last] if w))
    left = [0]
    for w in width:
        left.append(left[-1] + w + 2 if w else left[-1])
    for line in grid:
        for k in range(max((len(text) for _, _, text in line), default=0)):
            layout.block(1)
            shown = ""
            for at, _, text in line:
                if k < len(text) and text[k]:
                    x = left[place[at]]
                    fits = x <= PAGE and (not shown or len(shown) + 2 <= x)
                    shown = (shown.ljust(x) if fits else shown and shown + "  ") + text[k]
            if shown.strip():
                layout._put(shown.rstrip())


def _inside(node: Node) -> str:
    """The laid-out text inside of ``node``; a stack of unfinished layouts takes the place of recursion."""
    layout = Layout()
    open_ones, answer = [(_render(node, layout), layout)], None
    while open_ones:
        steps, layout = open_ones[-1]
        try:
            wanted = steps.send(answer)
        except StopIteration:
            open_ones.pop()
            answer = layout.result()
        else:
            inner = Layout()
            open_ones.append((_render(wanted, inner), inner))
            answer = None
    return answer


def _options(select: Node) -> list[Node]:
    """The options of a list, also those in groups that are shown."""
    out, todo = [], [select]
    while todo:
        node = todo.pop()
        if node.tag == "option":
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not (c.tag != "option" and c.hidden)]
    return out


def _render(root: Node, layout: Layout) -> Steps:
    """Lay out the children of ``root``; a stack of open elements takes the place of recursion."""
    lists: list[list] = []  # for each open list: its numbering, or None for bullets
    todo: list = [iter(root.children)]
    leave: list = [None]
    open_pre = 0
    owners = [root]

    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            owners.pop()
            if done := leave.pop():
                open_pre -= done is _pre_end
                done()
            continue
        if isinstance(child, str):
            if owners[-1].shown:
                (layout.preformatted if open_pre else layout.text)(child)
            continue
        tag = child.tag
        if child.hidden or (tag == "input" and child.attributes.get("type", "").lower() == "hidden"):
            continue
        if tag == "br":
            layout.due, layout.space = layout.due + 1, False
            continue
        if tag == "select":
            options = _options(child)
            chosen = next((o for o in options if "selected" in o.attributes), options[0] if options else None)
            if chosen and child.shown:
                layout.text((yield chosen))
            continue
        if tag == "input":
            if child.shown and child.attributes.get("type", "").lower() in BUTTONS and child.attributes.get("value"):
                layout.text(f" {child.attributes['value']} ")
            continue
        lines = 2 if tag in PARAGRAPHS else 1 if tag in LINES else 0
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lines = 1
        if lines:
            layout.block(lines)
        if tag == "table":
            yield from _table(child, layout)
            layout.block(lines)
            continue
        done = None
        if tag == "pre":
            done = _pre_end
        elif tag in ("ul", "ol", "menu", "dir"):
            start = child.attributes.get("start", "1")
            lists.append([int(start) if start.isascii() and start.isdigit() else 1] if tag == "ol" else [None])
            done = lists.pop
        elif tag == "li":
            if lists and lists[-1][0] is not None:
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            else:
                mark = "- "
            layout.indent.append(" " * len(mark))
            layout.mark = mark
            done = lambda: (layout.indent.pop(), setattr(layout, "mark", ""))
        elif tag in ("blockquote", "dd"):
            layout.indent.append("  ")
            done = layout.indent.pop
        elif tag == "q" and child.shown:
            layout.text("“")
            done = lambda: layout.text("”")
        todo.append(iter(child.children))
        owners.append(child)
        leave.append((lambda done=done, lines=lines: (done and done(), layout.block(lines))) if lines and done is not _pre_end
                     else done)
        if done is _pre_end:
            open_pre += 1
            layout.block(2)


def _pre_end() -> None:
    """Marks an open preformatted element."""


def visible_text(page: str | None) -> tuple[str, str]:
    """Title and laid-out visible text of a page."""
    root = parse(page or "")
    title, todo = "", [root]
    while todo and not title:
        node = todo.pop()
        if node.tag == "title":
            title = _BLANKS.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return title, _inside(root)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, title and text of each page (column ``html``)."""
    scan.ship(pages.sparkSession)
    fields = [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]
    kept = [c for c in dict.fromkeys(keep) if c not in ("title", "text")]
    given = pages.select(*kept, *(["html"] if "html" not in kept else []))
    schema = T.StructType([given.schema[c] for c in kept] + fields)

    def run(batches):
        for batch in batches:
            found = [visible_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)],
                names=[*kept, "title", "text"])

    return given.mapInArrow(run, schema)
