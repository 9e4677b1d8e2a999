"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

A number of more than nine digits counts as none, a span of more than 1,000 as 1,000, a character reference beyond all
characters as U+FFFD.  Text, like any tag that can't stand there, ends the head.  Hidden is what ``hidden``,
declarations of ``display``, ``visibility`` and ``content-visibility`` in ``style``, or rules of style sheets for plain
tags, classes and ids say, the last and strongest declaration counting; ``visibility`` is inherited and may be taken
back inside.  Other selectors and at-rules are not looked at.

All visible text comes out, in reading order: block elements on lines of their own, paragraphs, headings, lists and
tables set off by an empty line, list items with markers and indentation, preformatted text as it stands, table cells
in aligned columns.  Hidden elements, scripts, styles, comments and the head are left out.
"""
from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: element kinds and which start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style noscript template title meta link base datalist iframe object audio video canvas noembed noframes annotation annotation-xml mphantom".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre xmp figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary tbody td tfoot th thead tr caption".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "tbody": frozenset(["tbody", "thead", "tfoot"]), "thead": frozenset(["tbody", "thead", "tfoot"]), "tfoot": frozenset(["tbody", "thead", "tfoot"]), "caption": frozenset(["tr", "tbody", "thead", "tfoot", "td", "th"]),
    "p": (BLOCKS - frozenset(["option", "optgroup", "body", "html"])),
}
SCOPES = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "p": frozenset(["td", "th", "caption", "button"])}
TABLE_SCOPE = frozenset(["table"])
SECTIONS = frozenset(["tbody", "thead", "tfoot"])
TABLE_PARTS = {**dict.fromkeys(["td", "th"], SECTIONS | {"table", "tr"}), "tr": SECTIONS | {"table"},   # what they may stand in
               **dict.fromkeys(["tbody", "thead", "tfoot", "caption", "colgroup", "col"], TABLE_SCOPE)}
NO_TEXT = SECTIONS | {"table", "tr", "colgroup"}           # what else stands in these comes before the table
STAYS = frozenset(["script", "style", "template", "form"])
SVG_TEXT = frozenset(["text", "foreignobject"])
SVG_UNSEEN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
MATH_APART = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtr mlabeledtr".split())
DEPTH = 400                    # deeper elements become siblings, as in browsers; their text stays
PAD = 80                       # a wider cell is not padded for

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_ENDERS = frozenset().union(*CLOSED_BY.values())
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_ZEROS, _LONG = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
HIDES = ("display", "visibility", "content-visibility")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Element:
    """A tag, its attributes, and its children: elements and strings."""

    __slots__ = ("tag", "attrs", "children", "styles")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.styles = tag, attrs or {}, [], []

    def visible(self) -> bool:
        return self.tag not in INVISIBLE and self.tag != "input"


def _unescape(text: str) -> str:
    """Character references by their characters; one of more digits than any character has stands for none."""
    if "&#" in text:
        text = _LONG.sub("&#9999999", _ZEROS.sub("&#", text))
    return html.unescape(text)


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """What a list of declarations says of ``HIDES``: (important, value); the last one counts."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", style).split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in HIDES and value:
            important = value.endswith("important") and "!" in value
            if important or not out.get(name, (False,))[0]:
                out[name] = important, value.split("!")[0].strip()
    return out


def _rules(sheet: str) -> list[tuple[tuple, str, frozenset, frozenset, dict]]:
    """(specificity, tag, classes, ids, declarations) of the rules for one plain element, in order; rules with other
    selectors, and what stands in at-rules, are left out."""
    out, depth, head, at = [], 0, 0, 0
    sheet = _COMMENT.sub("", sheet)
    for m in re.finditer(r"[{};]", sheet):
        if m.group() == "{":
            depth += 1
            if depth == 1:
                at = m.end()
        elif m.group() == "}" and depth:
            depth -= 1
            if not depth:
                selectors, said = sheet[head:at - 1].strip(), None
                head = m.end()
                if selectors.startswith("@"):
                    continue
                for selector in selectors.split(","):
                    found = _SIMPLE.fullmatch(selector.strip())
                    if found and found.group():
                        said = _declared(sheet[at:m.start()]) if said is None else said
                        marks = re.findall(r"[.#][\w-]+", found[2])
                        classes, ids = (frozenset(x[1:] for x in marks if x[0] == c) for c in ".#")
                        tag = (found[1] or "*").lower()
                        if said:
                            out.append(((len(ids), len(classes), tag != "*"), tag, classes, ids, said))
        elif not depth:
            head = m.end()
    return out


def _prune(root: Element) -> bool:
    """Takes out what style rules, attributes and inherited visibility hide; whether the page is seen at all."""
    rules = [rule for sheet in root.styles for rule in _rules(sheet)]

    def said(node: Element) -> dict[str, str]:
        found: dict[str, tuple] = {}
        if rules:
            own, name = frozenset(node.attrs.get("class", "").split()), node.attrs.get("id")
            tags = ("*", node.tag, "body" if node is root else "*")      # the root stands for the body, too
            for turn, (weight, tag, classes, ids, values) in enumerate(rules):
                if tag in tags and classes <= own and ids <= {name}:
                    for k, (important, v) in values.items():
                        found[k] = max(found.get(k, ((False,), "")), ((important, 0, weight, turn), v))
        for k, (important, v) in _declared(node.attrs["style"]).items() if "style" in node.attrs else ():
            found[k] = max(found.get(k, ((False,), "")), ((important, 1), v))
        return {k: v for k, (_, v) in found.items()}

    def gone(node: Element, own: dict[str, str]) -> bool:
        closed = "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in node.attrs
        return own.get("display") == "none" or closed and "display" not in own or own.get("content-visibility") == "hidden"

    own = said(root)
    if gone(root, own):
        return False
    todo = [(root, own.get("visibility") in ("hidden", "collapse"))]
    while todo:
        node, unseen = todo.pop()
        left = []
        for child in node.children:
            if isinstance(child, str):
                if not unseen:
                    left.append(child)
                continue
            own = said(child)
            if not gone(child, own):
                left.append(child)
                seen = own.get("visibility", "inherit")
                todo.append((child, seen in ("hidden", "collapse") or unseen and seen in ("inherit", "unset")))
        node.children = left
    return True


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        out.setdefault(name.lower(), _unescape(value.strip("\"'")))
    return out


def parse(source: str) -> Element:
    """The tree of a page; nothing in a page makes it fail."""
    root = Element("html")
    stack = [root]

    def implied_ends(tag: str) -> None:
        """End the open elements that a start tag ends, up to the element that bounds them."""
        if tag not in _ENDERS:
            return
        for k in range(len(stack) - 1, 0, -1):
            own = stack[k].tag
            if own in CLOSED_BY and tag in CLOSED_BY[own]:
                del stack[k:]
                if own == "p" or own == tag:
                    if own != "p":
                        return
                    continue
            elif own in TABLE_SCOPE or own in SCOPES.get(tag, ()) or tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd") and own in BLOCKS:
                return

    def table_mode() -> int:
        """The place of the open table whose cells and caption are closed, else 0."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ("td", "th", "caption"):
                return 0
            if stack[k].tag == "table":
                return k
        return 0

    def table_part(tag: str) -> None:
        """Open a table part where it may stand: ends what is open in between, begins a row for a cell."""
        for k in range(len(stack) - 1, table_mode() - 1, -1):
            if stack[k].tag in TABLE_PARTS[tag]:
                del stack[k + 1:]
                break
        if tag in ("td", "th") and stack[-1].tag != "tr" and len(stack) < DEPTH:
            row = Element("tr")
            stack[-1].children.append(row)
            stack.append(row)

    def add(node: Element | str) -> None:
        """Append to the open element; what may not stand in a table goes before it."""
        nonlocal moved
        if stack[-1].tag == "head" and isinstance(node, str) and node.strip(" \t\n\r\f"):
            stack.pop()                    # text is of the body, which begins with it
        own = stack[-1].children
        k = table_mode() if stack[-1].tag in NO_TEXT and (isinstance(node, str) or node.tag not in TABLE_PARTS and node.tag not in STAYS) else 0
        if k:
            around = stack[k - 1].children
            place = next((i for i in range(len(around) - 1, -1, -1) if around[i] is stack[k]), len(around))
            if not isinstance(node, str) or node.strip(" \t\n\r\f") or place and around[place - 1] is moved:
                around.insert(place, node)
                moved = node
                return
        own.append(node)

    moved: Element | str | None = None
    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            add(_unescape(source[at:m.start()]))
        at = m.end()
        if m["cdata"]:
            add(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break              # an end tag does not leave the table cell it stands in
            else:
                if tag == "br":
                    add(Element("br"))
        elif m["start"]:
            tag = m["start"].lower()
            if tag in ("html", "body"):
                if tag == "body" and stack[-1].tag == "head":
                    stack.pop()
                stack[0].attrs.update(_attributes(m["attrs"]) if tag == "body" and m["attrs"] else {})
                continue
            if stack[-1].tag == "head" and tag not in RAW and tag not in ("meta", "link", "base", "noscript", "template"):
                stack.pop()
            implied_ends(tag)
            in_table = table_mode() if tag in TABLE_PARTS or tag in ("form", "table") else 0
            if in_table and tag in TABLE_PARTS:
                table_part(tag)
            elif in_table and tag == "table" and stack[-1].tag in NO_TEXT:
                del stack[in_table:]
            node = Element(tag, _attributes(m["attrs"]) if m["attrs"] else None)
            add(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                inner = source[at:end.start() if end else len(source)]
                if tag == "textarea" or tag == "xmp":
                    node.children.append(_unescape(inner) if tag == "textarea" else inner)
                elif tag == "style":
                    root.styles.append(inner)
                at = end.end() if end else len(source)
            elif tag not in VOID and not (m["attrs"] or "").endswith("/") and len(stack) < DEPTH and not (tag == "form" and in_table):
                stack.append(node)
    if at < len(source):
        add(_unescape(source[at:]))
    return root


class Layout:
    """Lines of text; white space collapses, blocks begin lines, paragraphs keep one empty line between them."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False

    def inline(self, text: str) -> None:
        flat = _BLANKS.sub(" ", text)
        if flat.startswith(" "):
            self.space, flat = True, flat[1:]
        if not flat:
            return
        if self.line and self.space:
            self.line.append(" ")
        self.space = flat.endswith(" ")
        self.line.append(flat.rstrip(" "))

    def newline(self, forced: bool = False) -> None:
        text = "".join(self.line)
        if text or forced and self.line:
            self._add(text)
        elif forced and self.lines:
            self.lines.append("")
        self.line, self.space = [], False

    def _add(self, text: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append(text)

    def paragraph(self) -> None:
        self.newline()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        self.newline()
        for text in lines:
            if text or self.lines:
                self._add(text)

    def finished(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _inside(node: Element) -> list[str]:
    layout = Layout()
    render(node, layout)
    return layout.finished()


def _items(node: Element, layout: Layout) -> None:
    number = int(node.attrs["start"]) if re.fullmatch(r"-?[0-9]{1,9}", node.attrs.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, Element) and child.tag == "li":
            if child.visible():
                mark = f"{number}. " if node.tag == "ol" else "- "
                lines = _inside(child)
                layout.block([mark + lines[0], *((" " * len(mark) + x if x else x) for x in lines[1:])] if lines else [])
            number += 1
        else:
            _child(child, layout)


def _rows(node: Element) -> list[Element]:
    out = []
    for child in node.children:
        if isinstance(child, Element) and child.visible():
            if child.tag == "tr":
                out.append(child)
            elif child.tag in ("tbody", "thead", "tfoot"):
                out += _rows(child)
    return out


def _outside_rows(node: Element, layout: Layout) -> None:
    for child in node.children:
        if isinstance(child, Element) and child.tag in SECTIONS:
            if child.visible():
                _outside_rows(child, layout)
        elif not isinstance(child, Element) or child.tag != "tr":
            _child(child, layout)


def _svg(node: Element, layout: Layout) -> None:
    """The text elements of a drawing, a blank apart."""
    for child in node.children:
        if isinstance(child, Element) and child.visible() and child.tag not in SVG_UNSEEN:
            if child.tag in SVG_TEXT:
                layout.inline(" ")
                render(child, layout)
                layout.inline(" ")
            else:
                _svg(child, layout)


def _span(cell: Element, name: str) -> int:
    digits = re.fullmatch(r"0*([0-9]*)", cell.attrs.get(name, ""))
    return max(1, min(int(digits[1][:5] or 0), 1000)) if digits else 1


def _table(node: Element, layout: Layout) -> None:
    """Text outside cells first, then rows with cells in aligned columns, two blanks apart."""
    _outside_rows(node, layout)
    grid: list[dict[int, list[str]]] = []
    taken: list[tuple[int, int, int]] = []               # first column, last one and rows that cells above still cover
    for row in _rows(node):
        cells, column, ahead = {}, 0, iter(taken)
        below, cover = [(a, b, n - 1) for a, b, n in taken if n > 1], next(ahead, None)
        for cell in row.children:
            if not isinstance(cell, Element) or cell.tag not in ("td", "th"):
                if isinstance(cell, Element) or cell.strip():
                    _child(cell, layout)
                continue
            while cover and cover[0] <= column:
                column, cover = max(column, cover[1] + 1), next(ahead, None)
            if cell.visible():
                cells[column] = _inside(cell)
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            if high > 1:
                below.append((column, column + wide - 1, high - 1))
            column += wide
        taken = sorted(below)
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, lines in cells.items():
            width[c] = max([width.get(c, 0), *(min(len(x), PAD) for x in lines)])
    columns = sorted(width)
    out = []
    for cells in grid:
        for k in range(max(map(len, cells.values()), default=0)):
            parts = [(cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(width[c]) for c in columns]
            out.append("  ".join(parts).rstrip())
    layout.block(out)


def _child(child: Element | str, layout: Layout) -> None:
    if isinstance(child, str):
        layout.inline(child)
        return
    if not child.visible():
        return
    tag = child.tag
    if tag == "br":
        layout.newline(forced=True)
        return
    if tag == "svg":
        _svg(child, layout)
        return
    if tag in MATH_APART:                                # parts that stand above or beside each other
        for part in child.children:
            layout.inline(" ")
            _child(part, layout)
        layout.inline(" ")
        return
    if tag not in BLOCKS:
        render(child, layout)
        return
    edge = layout.paragraph if tag in PARAGRAPHS else layout.newline
    edge()
    if tag in ("ul", "ol", "menu", "dir"):
        _items(child, layout)
    elif tag == "table":
        _table(child, layout)
    elif tag in ("pre", "xmp"):
        layout.block("".join(_strings(child)).strip("\n").split("\n"))
    elif tag in ("blockquote", "dd"):
        layout.block([f"  {x}" if x else x for x in _inside(child)])
    elif tag == "details" and "open" not in child.attrs:
        for x in child.children:
            if isinstance(x, Element) and x.tag == "summary":
                _child(x, layout)
                break
    else:
        render(child, layout)
    edge()


def _strings(node: Element) -> list[str]:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif child.visible():
            out += _strings(child)
    return out


def render(node: Element, layout: Layout) -> None:
    for child in node.children:
        _child(child, layout)


def visible_text(source: str | None) -> str:
    """The text of a page as laid out; empty for a page that is null, empty, or hidden as a whole."""
    if not source:
        return ""
    root = parse(source)
    return "\n".join(_inside(root)) if _prune(root) else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars, n_lines) for every row of ``pages``; a null or empty page has an empty text and 0 lines.
    Repeated rows give equal rows; other columns are ignored; an empty table gives an empty result."""
    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
        for batch in batches:
            texts = [visible_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], ["id", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, text string, n_chars long, n_lines long").withColumnRenamed("id", id_col)
