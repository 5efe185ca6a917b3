"""Visible text of web pages by layout-aware rendering.

A tree builder reads the page: end tags may be missing (an item ends the item before it, a block ends a paragraph, a
cell ends a cell, anything that may not stand in a head ends the head) and stray ones are passed over. The renderer walks the tree and writes what a reader would see:
blocks on lines of their own, paragraphs and headings set off by a blank line, list items with their mark and indent,
table cells in aligned columns, preformatted text as it is; each option of a choice, each text element of a drawing and
the lines of a text field on lines of their own, formulas as their text. Not visible are scripts, styles, the head,
titles, comments, templates, noscript, what stands in for embedded things (iframe, object, audio, video, canvas), the
entries of a datalist, annotations of formulas, what a drawing only defines or says outside its text elements, elements
with the attribute hidden, a dialog that is not open, and elements styled display:none; nor is text whose nearest styled
element has visibility:hidden (within one, visibility:visible shows again). What a details element folds away is shown.

A page is read once from its start to its end, open elements are found by their names, and the tree is walked with a
stack, so neither long broken pages nor deep ones are a matter of their own. Indents grow to INDENT columns. Cells of a
table within NESTED tables stand on lines of their own, and those of a table that would be blanks above all (LOOSE, ROOM)
two blanks apart. A cell that spans columns reaches to where the next one begins, one that spans rows
leaves its place free below. Wide characters count as two when cells are aligned, combining ones as none.

Defined results: null or empty html gives the empty text. Rows that repeat are rendered each for itself; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of the HTML standard by their part in layout and parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
BLOCK = APART | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html hr legend li main menu nav section summary tr".split())
#: Lines of their own that end no paragraph.
LINES = frozenset("option optgroup textarea text".split())
#: What a drawing or a formula does not show, and the start tags that end an open one.
UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern symbol".split())
OUTSIDE = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements of a drawing or a formula whose content is read as HTML again.
ISLANDS = frozenset("foreignobject mtext mi mo mn ms".split())
#: What a start tag ends, and the elements beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= {x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
ENDS |= {"option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"})}
#: What may stand in a head; any other start tag, text, and the end of body or html end an open head.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FENCES = frozenset({"td", "th", "li", "dd", "dt", "table", "caption", "body", "html", "div", "section", "article", "blockquote"})

#: Indents end here, so that deep lists cost no more than their text; tables within so many tables, and tables that would
#: hold more than LOOSE times their text and ROOM in blanks, are not aligned.
INDENT, NESTED, LOOSE, ROOM = 64, 8, 16, 1 << 16

#: A tag up to its name; what is no tag.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
_TEXT = re.compile(r"[^<]++|<[^<]*+")
_OUTSIDE_QUOTES = re.compile(r"""[^'">]*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
_COMMENT = re.compile(r"<!--(?:-?>|(?=[^>-]|-[^>]|-?$))")
_COMMENT_END = re.compile("--!?>")
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign", "shows")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = "", shows: bool = True):
        """foreign: svg or math where the content is read by the rules of a drawing or a formula. shows: whether text within
        is visible where the element itself says nothing of it."""
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign
        said = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else ()
        said = said[-1].lower() if said else attrs.get("visibility", "") if foreign else ""
        self.shows = said == "visible" if said in ("visible", "hidden", "collapse") else shows

    def seen(self) -> bool:
        if self.tag in UNSEEN or "hidden" in self.attrs or self.tag == "dialog" and "open" not in self.attrs:
            return False
        return not ("style" in self.attrs and _GONE.search(self.attrs["style"]))

    def add(self, text: str) -> None:
        """Text that does not show is left out at once."""
        if self.shows:
            self.children.append(text)


class Open:
    """The open elements, the root first, and where those of each name stand among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close(self, tags: set[str], fences) -> None:
        """Ends the innermost open element of `tags` that no fence stands in, and those of `tags` right around it."""
        first = self._last(tags)
        if not first or first < self._last(fences):
            return
        while first > 1 and self.nodes[first - 1].tag in tags:
            first -= 1
        while len(self.nodes) > first:
            self.pop()


def _attributes(text: str) -> tuple[dict[str, str], bool]:
    """The attributes of a tag and whether it closes itself; the slash of an unquoted value belongs to the value."""
    attrs, end, value = {}, 0, ""
    for m in _ATTRIBUTE.finditer(text):
        end, value = m.end(), m[2] or ""
        attrs[m[1].lower()] = value[1:-1] if value[:1] in "\"'" and value else value
    return attrs, text.endswith("/") and not (end == len(text) and value.endswith("/"))


class _Tags:
    """Finds where the tags of a page end. What was scanned without success is remembered, so that a page full of
    unclosed tags is still read in linear time."""

    def __init__(self, page: str):
        self.page, self.dead, self.closers, self.run = page, set(), {}, (0, -1)

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`, quotes being passed over, or -1."""
        path = []
        while at not in self.dead:
            path.append(at)
            if not self.run[0] <= at <= self.run[1]:
                self.run = (at, _OUTSIDE_QUOTES.match(self.page, at).end())
            stop = self.run[1]
            mark = self.page[stop : stop + 1]
            if mark == ">":
                return stop
            if mark and stop not in self.closers:
                self.closers[stop] = self.page.find(mark, stop + 1)
            if not mark or self.closers[stop] < 0:
                break
            at = self.closers[stop] + 1
        self.dead.update(path)
        return -1


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root, tags = Node("html", {}), _Tags(page)
    stack, at = Open(root), 0
    nodes = stack.nodes
    while at < len(page):
        top = nodes[-1]
        if top.foreign and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            top.add(page[at + 9 : end if end >= 0 else len(page)])
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), at):
            m = _COMMENT.match(page, at)
            if m is None or m[0] != "<!--":
                end = page.find(">", at + 2) if m is None else m.end() - 1
            else:
                m = _COMMENT_END.search(page, at + 4)
                end = m.end() - 1 if m else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        plain = _PLAIN.match(page, at)
        m = None if plain else _TAG.match(page, at)
        end = plain.end() - 1 if plain else tags.end(m.end()) if m else -1
        if end < 0:
            m = _TEXT.match(page, at)
            at = m.end()
            if top.tag == "head" and _BLANK.sub("", m[0]):
                stack.pop()
            nodes[-1].add(html.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        if plain:
            at, closes, inner, tag = end + 1, plain[1], "", plain[2].lower()
        else:
            at, closes, inner, tag = end + 1, page[at + 1] == "/", page[m.end() : end], m[1].lower()
        if top.tag == "head" and len(nodes) > 1 and (tag in ("body", "html", "br") if closes else tag not in HEAD):
            stack.pop()
        if closes:
            if tag not in VOID:
                stack.close({tag}, {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {tag})
            continue
        if nodes[-1].foreign and tag in OUTSIDE:
            while nodes[-1].foreign:
                stack.pop()
        attrs, closed = ({}, False) if not inner else _attributes(inner) if inner.strip(" \t\n\r\f/") else ({}, inner.endswith("/"))
        foreign = nodes[-1].foreign or (tag if tag in ("svg", "math") else "")
        if foreign:
            if tag in UNDRAWN or attrs.get("display") == "none":
                attrs["hidden"] = ""
            node = Node(tag, attrs, foreign, nodes[-1].shows)
            node.foreign = "" if tag in ISLANDS else foreign
            nodes[-1].children.append(node)
            if not closed:
                stack.push(node)
            continue
        if tag in BLOCK:
            stack.close({"p"}, FENCES)
        if tag in ENDS:
            stack.close(*ENDS[tag])
        node = Node(tag, attrs, "", nodes[-1].shows)
        nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at) if page.rfind(">", at) >= 0 else None
            if tag == "textarea":
                field = page[at : end.start() if end else len(page)].replace("\r\n", "\n")
                node.add(html.unescape(field.removeprefix("\n")))
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.push(node)
    return root


class Canvas:
    """Lines being written: words are joined by single spaces, blocks begin new lines, gaps become one blank line. Within
    an indent the first line gets its mark, the others as many blanks; an indent's first and last gaps are dropped."""

    def __init__(self, depth: int = 0):
        """depth: tables around this canvas."""
        self.depth = depth
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent, self.lead, self.fresh, self.outer = "", None, True, []

    def text(self, words: str) -> None:
        collapsed = _BLANK.sub(" ", words)
        body = collapsed.strip(" ")
        if not body:
            self.space |= bool(collapsed)
            return
        if (self.space or collapsed[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(body)
        self.space = collapsed[-1] == " "

    def end_line(self, gap: bool = False) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False
        self.gap |= gap and not self.fresh

    def put(self, line: str) -> None:
        if self.gap:
            self.lines.append("")
        self.gap = self.fresh = False
        self.lines.append((self.indent if self.lead is None else self.lead) + line if line else line)
        self.lead = None if line else self.lead

    def enter(self, mark: str) -> None:
        self.end_line()
        self.outer.append((self.indent, self.lead, self.fresh, self.gap))
        lead = self.indent if self.lead is None else self.lead
        if len(lead) < INDENT:
            self.lead, self.indent = lead + mark, self.indent + " " * len(mark)
        self.fresh = True

    def leave(self) -> None:
        self.end_line()
        indent, lead, fresh, gap = self.outer.pop()
        self.indent = indent
        if self.fresh:  # nothing was written
            self.lead, self.fresh, self.gap = lead, fresh, gap
        else:
            self.lead, self.gap = None, False


def _walk(task):
    """Runs a generator that yields generators, each in place of a call, without depth; the result of the first."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _inside(node: Node, depth: int = 0):
    canvas = Canvas(depth)
    for child in node.children:
        yield _draw(child, canvas, False)
    canvas.end_line()
    return canvas.lines


def _indented(node: Node, mark: str, canvas: Canvas):
    canvas.enter(mark)
    for child in node.children:
        yield _draw(child, canvas, False)
    canvas.leave()


def _seen_below(node: Node, wanted: frozenset, through):
    """The visible elements of `wanted` under a node, in order, looked for inside those that `through` allows."""
    left = list(reversed(node.children))
    while left:
        child = left.pop()
        if isinstance(child, Node) and child.seen():
            if child.tag in wanted:
                yield child
            elif through(child):
                left += reversed(child.children)


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    return min(most, int(value)) if re.fullmatch("[0-9]{1,9}", value) and int(value) else 1


def _wide(text: str) -> int:
    """The columns that a text takes on a screen of equally wide characters."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _grid(rows: list[Node], depth: int):
    """For each row its cells as (first column, column after the last, lines)."""
    grid, held = [], []  # held: places that cells from above still fill, as (first column, end, last row)
    for r, row in enumerate(rows):
        line, column, i, new = [], 0, 0, []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and cell.seen():
                while i < len(held) and held[i][0] <= column:
                    column = max(column, held[i][1])
                    i += 1
                width, last = _span(cell, "colspan", 1000), min(r - 1 + _span(cell, "rowspan", 65534), len(rows) - 1)
                line.append((column, column + width, (yield _inside(cell, depth))))
                if last > r:
                    new.append((column, column + width, last))
                column += width
        grid.append(line)
        left = [h for h in held if h[2] > r]
        if new or len(left) < len(held):
            held = []
            for first, end, last in sorted([*left, *new]):
                if held and held[-1][1] >= first and held[-1][2] == last:  # cells that end in one row fill one place
                    held[-1] = (held[-1][0], max(held[-1][1], end), last)
                else:
                    held.append((first, end, last))
    return grid


def _table(node: Node, canvas: Canvas):
    for child in node.children:  # what stands in a table outside its rows is shown before it
        if isinstance(child, str) or child.tag not in ("tr", "thead", "tbody", "tfoot"):
            yield _draw(child, canvas, False)
    rows = list(_seen_below(node, frozenset({"tr"}), lambda x: x.tag in ("thead", "tbody", "tfoot")))
    if canvas.depth >= NESTED:
        for row in rows:
            for cell in row.children:
                canvas.end_line()
                yield _draw(cell, canvas, False)
        return
    grid = yield _grid(rows, canvas.depth + 1)
    # only columns in which a cell begins count; a span goes on to the last of them that it covers
    begins = sorted({first for line in grid for first, _, _ in line})
    number = {c: i for i, c in enumerate(begins)}
    grid = [[(number[first], bisect_left(begins, end) - 1, cell, [_wide(x) for x in cell]) for first, end, cell in line] for line in grid]
    widths = [0] * len(begins)
    for line in grid:
        for first, last, _, wide in line:
            if first == last:
                widths[first] = max(widths[first], *wide, 0)
    sums = [0, *accumulate(w + 2 for w in widths)]
    grown = [0] * len(begins)
    for line in grid:
        for first, last, _, wide in line:
            if last > first:  # what its columns lack for it, the last of them gets
                grown[last] = max(grown[last], max(wide, default=0) - (sums[last + 1] - sums[first] - 2))
    starts = [0, *accumulate(w + g + 2 for w, g in zip(widths, grown, strict=True))]
    canvas.end_line()
    full = sum(map(sum, (wide for line in grid for *_, wide in line)))
    if sum(starts[first] for line in grid for first in _ends(line)) > LOOSE * full + ROOM:
        starts = [0] * len(starts)
    for row, line in zip(rows, grid, strict=True):
        for other in row.children:
            if isinstance(other, str) and other.strip() or isinstance(other, Node) and other.tag not in ("td", "th"):
                yield _draw(other, canvas, False)
        lines: list[tuple[list[str], list[int]]] = [([], [0]) for _ in range(max((len(cell) for _, _, cell, _ in line), default=0))]
        for first, _, cell, wide in line:
            for (parts, at), text, size in zip(lines, cell, wide, strict=False):
                gap = max(starts[first] - at[0], 2 if parts else 0)
                parts += (" " * gap, text)
                at[0] += gap + size
        canvas.end_line()
        for parts, _ in lines:
            canvas.put("".join(parts).rstrip())


def _ends(line: list[tuple]) -> Iterator[int]:
    """For each line of text of a row the column of its last cell."""
    reached = 0
    for first, _, cell, _ in reversed(line):
        yield from (first for _ in range(len(cell) - reached))
        reached = max(reached, len(cell))


def _draw(node, canvas: Canvas, pre: bool):
    if isinstance(node, str):
        if pre:
            first, *rest = node.split("\n")
            canvas.line.append(first)
            for line in rest:
                canvas.put("".join(canvas.line))
                canvas.line = [line]
        else:
            canvas.text(node)
        return
    if not node.seen():
        return
    tag = node.tag
    if tag == "br":
        canvas.end_line()
        return
    if tag == "svg":  # a drawing shows its text elements, and pages within it
        for child in _seen_below(node, frozenset({"text", "foreignobject"}), lambda _: True):
            canvas.end_line()
            yield _draw(child, canvas, False)
            canvas.end_line()
        return
    if tag in LINES and (tag != "text" or node.foreign == "svg"):
        canvas.end_line()
        label = node.attrs.get("label", "") if node.shows and tag in ("option", "optgroup") else ""
        if label:
            canvas.text(html.unescape(label))
            canvas.end_line()
        for child in node.children if tag != "option" or not label else ():
            yield _draw(child, canvas, pre or tag == "textarea")
        canvas.end_line()
        return
    if tag not in BLOCK:
        for child in node.children:
            yield _draw(child, canvas, pre)
        return
    canvas.end_line(gap=tag in APART)
    if tag in ("ul", "ol", "menu"):
        start = node.attrs.get("start", "")
        number = int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and child.seen():
                yield _indented(child, f"{number}. " if tag == "ol" else "- ", canvas)
                number += 1
            else:
                yield _draw(child, canvas, False)
    elif tag == "table":
        yield _table(node, canvas)
    elif tag in ("dd", "blockquote"):
        yield _indented(node, "  ", canvas)
    elif tag == "li":
        yield _indented(node, "- ", canvas)
    else:
        for child in node.children:
            yield _draw(child, canvas, pre or tag == "pre")
    canvas.end_line(gap=tag in APART)


def render(page: str | None) -> str:
    """The visible text of a page, lines joined by line feeds."""
    return "\n".join(_walk(_inside(parse(page)))) if page else ""


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of each row of pages (page_id, html)."""

    def run(batches):
        for batch in batches:
            texts = [render(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return page.mapInArrow(run, "page_id long, text string")
