"""Layout-aware text of HTML pages.

A tree builder closes elements that a start tag implies closed, opens the table
parts it implies, and keeps stray end tags from doing harm. Elements that are not
shown are left out: by their kind, the attribute ``hidden``, an inline style, or a
rule of the page's own style sheets whose selector is a tag, a class, an id or a
tag with one of these. The rest is set out as text: white space collapses in
lines, paragraphs and headings stand apart, list items carry their marks and
indents, preformatted text keeps its lines, and the cells of a table stand in
aligned columns.

A null page is an empty text. Elements may be nested to any depth: neither the tree
builder nor the renderer recurses. Indents beyond WIDEST columns are drawn as WIDEST,
which keeps the text of nested lists in proportion to the page. Rows may repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import others

#: Columns of the widest indent.
WIDEST = 160
# The most columns and rows that a table cell may span in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Stands for a line break while a line is gathered.
BREAK = "\u2028"

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes param source track audio video canvas object map area".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu dir".split())
CLOSES_P = BLOCKS - frozenset("li dt dd legend option optgroup body html".split())
#: Start tags that close an open element of these kinds, up to the nearest of the elements behind the bar.
CLOSERS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr td th thead tbody tfoot caption colgroup", "table"),
    "tbody": ("tr td th thead tbody tfoot caption colgroup", "table"), "tfoot": ("tr td th thead tbody tfoot caption colgroup", "table"),
    "body": ("head", "html"), "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby"),
}
_CLOSERS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSERS.items()}
_TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<closed>>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Open(list):
    """The open elements, outermost first, with a count of each tag."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.tags = Counter([root.tag])

    def put(self, element: Element) -> None:
        self.append(element)
        self.tags[element.tag] += 1

    def cut(self, k: int) -> None:
        """Close the element at place k and all inside it."""
        for e in self[k:]:
            self.tags[e.tag] -= 1
        del self[k:]


class Element:
    """A tag with its attributes and children, which are elements or strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(html: str) -> tuple[Element, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    root = Element("html")
    stack, sheets, at = Open(root), [], 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        if (cdata := m["cdata"]) is not None:
            stack[-1].children.append(cdata)
        elif m["end"]:
            _end(stack, m["end"].lower())
        elif m["start"]:
            tag, attrs = m["start"].lower(), m["attrs"]
            values = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip(" /\n\t") else {}
            if tag in ("html", "body") and stack.tags[tag]:
                continue
            element = Element(tag, values)
            _start(stack, tag)
            stack[-1].children.append(element)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                body = html[at : close.start() if close else len(html)]
                at = close.end() if close else len(html)
                element.children.append(unescape(body) if tag in ("textarea", "title") else body)
                if tag == "style":
                    sheets.append(body)
            elif tag not in VOID:
                stack.put(element)
    return root, sheets


def _start(stack: Open, tag: str) -> None:
    """Close what a start tag implies closed, open what it implies open."""
    if tag in CLOSES_P and stack.tags["p"]:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                stack.cut(k)
                break
            if stack[k].tag in ("table", "td", "th", "button", "caption"):
                break
    if tag in _CLOSERS:
        ends, scope = _CLOSERS[tag]
        cut = None
        for k in range(len(stack) - 1, 0, -1) if any(stack.tags[t] for t in ends) else ():
            if stack[k].tag in scope:
                break
            if stack[k].tag in ends:
                cut = k
        if cut is not None:
            stack.cut(cut)
    elif tag in CLOSES_P or tag == "a":
        if tag == "a" and stack.tags["a"]:
            _end(stack, "a")
        if stack[-1].tag == "head" and tag != "head":
            stack.cut(len(stack) - 1)
    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
        row = Element("tr")
        stack[-1].children.append(row)
        stack.put(row)


def _end(stack: Open, tag: str) -> None:
    if tag == "p" and not stack.tags["p"]:
        stack[-1].children.append(Element("p"))
        return
    if tag == "br":
        stack[-1].children.append(Element("br"))
        return
    for k in range(len(stack) - 1, 0, -1) if stack.tags[tag] else ():
        if stack[k].tag == tag:
            stack.cut(k)
            return
        if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html"):
            return


def hidden_by(sheets: list[str]) -> set[tuple[str, str]]:
    """(tag or empty, #id or .class or empty) of the simple selectors that hide elements."""
    out = set()
    for sheet in sheets:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if _GONE.search(body):
                for s in selectors.split(","):
                    if m := re.fullmatch(r"\s*([a-zA-Z][\w-]*)?([.#][\w-]+)?\s*", s):
                        if m[1] or m[2]:
                            out.add(((m[1] or "").lower(), m[2] or ""))
    return out


def visible(e: Element, hidden: set[tuple[str, str]]) -> bool:
    """Whether an element is shown, its parents aside."""
    if e.tag in UNSEEN:
        return False
    a = e.attrs
    if not a and not hidden:
        return True
    if "hidden" in a or (e.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and _GONE.search(a["style"])):
        return False
    if hidden:
        marks = ["", *("." + c for c in a.get("class", "").split())]
        if "id" in a:
            marks.append("#" + a["id"])
        return not any((t, m) in hidden for m in marks for t in ("", e.tag) if t or m)
    return True


def drive(task: Iterator) -> None:
    """Run a task that yields the tasks to be run before it goes on."""
    stack = [task]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


class Page:
    """Sets out a tree as lines. Methods that may go deeper are tasks for ``drive``."""

    def __init__(self, hidden: set[tuple[str, str]]):
        self.hidden = hidden
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False  # a blank line is due before the next line
        self.indent = ""
        self.mark = ""  # of a list item, before its first line

    def flush(self) -> None:
        """End the line at hand."""
        text = _SPACE.sub(" ", "".join(self.inline)).replace(" " + BREAK, BREAK).replace(BREAK + " ", BREAK).strip(" ").removesuffix(BREAK)
        self.inline = []
        if text.strip(BREAK):
            for line in text.split(BREAK):
                self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.indent[-WIDEST:]
        if self.mark:
            lead = self.indent[: len(self.indent) - len(self.mark)][-WIDEST:] + self.mark
            self.mark = ""
        self.lines.append((lead + line).rstrip())

    def block(self, tag: str) -> None:
        """Edge of a block."""
        self.flush()
        if tag in SPACED and not self.mark:
            self.gap = True

    def show(self, e: Element) -> Iterator:
        """Set out an element."""
        tag = e.tag
        if not visible(e, self.hidden):
            return
        if tag == "br":
            self.inline.append(BREAK)
        elif tag == "hr":
            self.block("hr")
            self.put("---")
            self.gap = True
        elif tag == "pre":
            self.block(tag)
            body = self.plain(e)
            for line in body.removeprefix("\n").rstrip("\n").split("\n"):
                self.put(line)
            self.gap = True
        elif tag == "table":
            self.block(tag)
            yield self.table(e)
            self.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = bool(self.indent)
            self.flush()
            if not nested and not self.mark:
                self.gap = True
            number = int(e.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", e.attrs.get("start", "")) else 1
            for c in e.children:
                if isinstance(c, Element) and c.tag == "li" and visible(c, self.hidden):
                    self.flush()
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    outer = self.indent
                    self.indent, self.mark = outer + " " * len(mark), mark
                    yield self.fill(c)
                    self.flush()
                    if self.mark:
                        self.put("")
                    self.indent = outer
                elif isinstance(c, str):
                    self.inline.append(c.replace(BREAK, " "))
                else:
                    yield self.show(c)
            self.flush()
            if not nested:
                self.gap = True
        elif tag in ("dd", "blockquote"):
            self.block(tag)
            outer, self.indent = self.indent, self.indent + "    "
            yield self.fill(e)
            self.block(tag)
            self.indent = outer
        elif tag in BLOCKS:
            self.block(tag)
            yield self.fill(e)
            self.block(tag)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self.flush()
            yield self.fill(e)
            self.flush()
        else:
            yield self.fill(e)

    def fill(self, e: Element) -> Iterator:
        for c in e.children:
            if isinstance(c, str):
                self.inline.append(c.replace(BREAK, " "))
            else:
                yield self.show(c)

    def plain(self, e: Element) -> str:
        """The text of an element with its white space."""
        out, due = [], [e]
        while due:
            c = due.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c is e or visible(c, self.hidden):
                due += reversed(c.children)
        return "".join(out)

    def cell(self, e: Element, lines: list[str]) -> Iterator:
        """Set out a cell in lines of its own."""
        inner = Page(self.hidden)
        yield inner.fill(e)
        inner.flush()
        lines += inner.lines

    def table(self, e: Element) -> Iterator:
        """Rows with their cells in aligned columns, two blanks apart."""
        rows: list[list[tuple[list[str], int]]] = []
        below: dict[int, int] = {}  # column: rows that a cell above still reaches over

        def gather(parent: Element) -> Iterator:
            for c in parent.children:
                if isinstance(c, str):
                    if c.strip():
                        self.inline.append(c.replace(BREAK, " "))
                        self.flush()
                elif not visible(c, self.hidden):
                    continue
                elif c.tag == "tr":
                    row: list[tuple[list[str], int]] = []
                    place = 0

                    def skip() -> None:
                        nonlocal place
                        while below.get(place, 0) > 0:
                            below[place] -= 1
                            row.append(([], 1))
                            place += 1

                    for d in c.children:
                        if isinstance(d, Element) and d.tag in ("td", "th") and visible(d, self.hidden):
                            skip()
                            span = min(MOST_COLUMNS, _count(d.attrs.get("colspan")))
                            row.append(([], span))
                            yield self.cell(d, row[-1][0])
                            if (tall := min(MOST_ROWS, _count(d.attrs.get("rowspan")))) > 1:
                                for k in range(place, place + span):
                                    below[k] = tall - 1
                            place += span
                        elif isinstance(d, Element) or d.strip():
                            skip()
                            holder = Element("td")
                            holder.children.append(d)
                            row.append(([], 1))
                            yield self.cell(holder, row[-1][0])
                            place += 1
                    skip()
                    rows.append(row)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    yield gather(c)
                else:
                    yield self.show(c)
                    self.flush()

        yield gather(e)
        widths: list[int] = []
        for row in rows:
            at = 0
            for lines, span in row:
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max([widths[at], *map(len, lines)])
                at += span
        for row in rows:
            if any(lines for lines, _ in row):
                for k in range(max(1, *(len(lines) for lines, _ in row))):
                    out, at = [], 0
                    for lines, span in row:
                        width = sum(widths[at : at + span]) + 2 * (span - 1)
                        out.append((lines[k] if k < len(lines) else "").ljust(width))
                        at += span
                    self.put("  ".join(out).rstrip())


def _count(value: str | None) -> int:
    return max(1, int(value)) if value and re.fullmatch(r"\d{1,6}", value.strip()) else 1


def render(html: str) -> str:
    """All visible text of a page, set out in lines."""
    root, sheets = parse(html)
    page = Page(hidden_by(sheets))
    drive(page.fill(root))
    page.flush()
    return "\n".join(page.lines)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Replace the column ``html`` by ``into``: the visible text. A column of that name is replaced."""
    kept = others(pages, html, into)
    pages = pages.select(*(F.col(f"`{c}`") for c in [*kept, html]))
    at = len(kept)
    frame = pages.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias(into))
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                made = pa.array([render(x or "") for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != at), made], names=names)

    return pages.mapInArrow(run, frame.schema)
