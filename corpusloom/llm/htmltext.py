"""HTML extraction: a tree builder with implied tags, visibility rules, and rendering that keeps the layout.

All visible text is given, nothing is guessed to be boilerplate. Blocks stand on lines of their own, with a blank line
around paragraphs, headings, lists and tables; list items have bullets or numbers, indented by depth; table cells are
aligned in columns, with spans taken into account; preformatted text keeps its white space.

Not visible are head, script, style, template, noscript and the like, comments, elements with `hidden`, those that an inline
style or a rule of a style element on a tag, class or id gives display:none, and text under visibility:hidden or collapse,
which an element inside may lift again. Rules of the page within @media count where the query names neither print nor a
feature.

The text of a page is at most a small multiple of its html: only a page's outermost tables are padded, cells of more than
_WIDEST characters widen no column, and a table whose padding would exceed _PADDING times its text is not aligned.

Cases: null or empty html, or markup without visible text, gives the empty text; unclosed and stray tags, broken
attributes, numbers of any length and entities never fail; depth of nesting is not limited (tables nested more than 40 deep
are rendered as plain blocks); a page is parsed as a whole, in memory in proportion to it; repeated rows are rendered alike;
an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectext import pieces

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist iframe noembed noframes object audio video canvas".split())
#: Not shown inside svg and math.
UNSEEN_THERE = frozenset("desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr caption ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure hr fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An open element that a new tag closes, and where the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: End tags do not reach beyond these.
SCOPES = frozenset("table td th caption html body template button".split())

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:\"[^\"]{0,65536}\"|'[^']{0,65536}'|[^>\"'])*)[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_LONG_NUMBER = re.compile(r"&#(?:([xX])([0-9a-fA-F]{7,})|([0-9]{8,}));?")
_SHOWS = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_WIDEST, _PADDING = 80, 4


def _short_number(m: re.Match) -> str:
    digits = (m[2] or m[3]).lstrip("0")
    return "\ufffd" if len(digits) > 7 else f"&#{m[1] or ''}{digits or '0'};"


def unescape(text: str) -> str:
    """Entities decoded; numbers beyond any code point are U+FFFD."""
    if "&" not in text:
        return text
    return _html.unescape(_LONG_NUMBER.sub(_short_number, text) if "&#" in text else text)


def _number(text: str, least: int, most: int, otherwise: int) -> int:
    """A whole number of an attribute, between two bounds."""
    text = text.strip()
    if not (text.isascii() and text.isdecimal()):
        return otherwise
    text = text.lstrip("0") or "0"
    return max(least, min(int(text[:9]) if len(text) < 10 else most, most))


def _shows(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a declaration list: (important, value); the last of equals counts."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _SHOWS.finditer(style):
        name, important = m[1].lower(), m[3] is not None
        if m.start() and (style[m.start() - 1].isalnum() or style[m.start() - 1] == "-"):
            continue
        if name not in out or important or not out[name][0]:
            out[name] = important, m[2].lower()
    return out


class Rules:
    """What style elements say of display and visibility, by tag, class or id."""

    def __init__(self):
        self.by: dict[str, list[tuple[tuple, str, frozenset[str], str, str]]] = {}
        self.n = 0

    def read(self, css: str) -> None:
        if "display" not in css and "visibility" not in css:
            return
        css, at, skip = _CSS_NOISE.sub(" ", css), 0, 0
        for m in re.finditer(r"[{}]", css):
            head = css[at : m.start()].rsplit(";", 1)[-1].strip()
            if m[0] == "{":
                if skip or (head.startswith("@") and not self._applies(head)):
                    skip += 1
                elif not head.startswith("@"):
                    end = css.find("}", m.end())
                    self._rule(head, css[m.end() : end if end >= 0 else len(css)])
            elif skip:
                skip -= 1
            at = m.end()

    @staticmethod
    def _applies(head: str) -> bool:
        return head.lower().startswith(("@media", "@layer")) and not re.search(r"print|\(|speech|not\b", head, re.I)

    def _rule(self, head: str, body: str) -> None:
        shows = _shows(body)
        for selector in head.split(",") if shows else ():
            m = _SELECTOR.match(selector.strip())
            if not m or not m[0]:
                continue
            tag, rest = (m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))
            key = min(rest) if rest else tag
            for name, (important, value) in shows.items():
                self.n += 1
                rank = (important, sum(x[0] == "#" for x in rest), sum(x[0] == "." for x in rest), tag != "*", self.n)
                self.by.setdefault(key, []).append((rank, tag, rest, name, value))

    def of(self, node: Node, attrs: dict[str, str]) -> dict[str, tuple[tuple, str]]:
        marks = {f".{c}" for c in attrs.get("class", "").split()}
        if attrs.get("id"):
            marks.add(f"#{attrs['id']}")
        out: dict[str, tuple[tuple, str]] = {}
        for key in (*marks, node.tag, "*"):
            for rank, tag, rest, name, value in self.by.get(key, ()):
                if tag in ("*", node.tag) and rest <= marks and (name not in out or rank > out[name][0]):
                    out[name] = rank, value
        return out


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)}


def _style(node: Node, rules: Rules) -> tuple[bool, str]:
    """Whether an element is displayed, and its own visibility or nothing."""
    if node.tag in UNSEEN:
        return False, ""
    bare = not node.attrs or node.attrs.isspace()
    if bare and not rules.n:
        return True, ""
    a = {} if bare else node.attributes()
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, ""
    said = {name: (rank[0], value) for name, (rank, value) in rules.of(node, a).items()} if rules.n else {}
    for name, (important, value) in _shows(a.get("style", "")).items():
        if important or not said.get(name, (False, ""))[0]:
            said[name] = important, value
    return said.get("display", (False, ""))[1] != "none", said.get("visibility", (False, ""))[1]


def prune(root: Node) -> Node:
    """Only what is visible: elements not displayed go with all in them, of invisible ones the text goes."""
    rules, todo = Rules(), [root]
    while todo:
        x = todo.pop()
        for y in x.children:
            if isinstance(y, Node):
                todo.append(y)
                if y.tag == "style":
                    rules.read("".join(z for z in y.children if isinstance(z, str)))
    walk = [(root, True)]
    while walk:
        x, shown = walk.pop()
        kept: list = []
        for y in x.children:
            if isinstance(y, str):
                if shown:
                    kept.append(y)
                continue
            displayed, visibility = _style(y, rules)
            if not displayed:
                continue
            seen = shown if visibility in ("", "inherit", "unset") else visibility not in ("hidden", "collapse")
            if seen or y.tag not in ("img", "input", "hr"):
                kept.append(y)
                walk.append((y, seen))
        x.children = kept
    return root


def build(source: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    stack, at, n = _Stack(root), 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            stack[-1].children.append(unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        foreign = stack.open["svg"] > 0 or stack.open["math"] > 0
        _imply(stack, tag)
        node = Node(tag, m[3] + " hidden" if foreign and tag in UNSEEN_THERE else m[3])
        if foreign and tag == "text":
            stack[-1].children.append(" ")
        stack[-1].children.append(node)
        if tag in VOID or foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
            text = source[at : end.start() if end else n]
            node.children.append(unescape(text) if tag == "textarea" else text)
            at = end.end() if end else n
            continue
        stack.push(node)
        if tag == "pre" and source.startswith("\n", at):
            at += 1
    return root


class _Stack(list):
    """Open elements, with the number of each tag, so that deep nesting costs no search for what isn't there."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, i: int) -> None:
        self.open.subtract(x.tag for x in self[i:])
        del self[i:]


def _pop_to(stack: _Stack, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
    """Close the outermost open element of `tags` inside the nearest of `stop`, with all in it."""
    if not any(stack.open[t] > 0 for t in tags):
        return
    cut = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stop:
            break
        if stack[i].tag in tags:
            cut = i
    if cut:
        stack.cut(cut)


def _imply(stack: _Stack, tag: str) -> None:
    if tag in ENDS_P:
        _pop_to(stack, {"p"}, SCOPES)
    if tag in IMPLIED:
        _pop_to(stack, *IMPLIED[tag])
    if tag in BLOCK and tag not in ("html", "body", "head") and any(x.tag == "head" for x in stack[-2:]):
        _pop_to(stack, {"head"}, {"html"})
    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.push(row)


def _close(stack: _Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    if tag in ("html", "body") or stack.open[tag] <= 0:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if stack[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "caption"):
            return


class _Page:
    """Lines of text so far; margins collapse as in a layout."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = False
        self.indent, self.mark = "", ""

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.words and self.words[-1].endswith(" "):
            text = text.removeprefix(" ")
        if not self.words:
            text = text.removeprefix(" ")
        if text:
            self.words.append(text)

    def flush(self, always: bool = False) -> None:
        text = "".join(self.words).strip(" \t\n\f\r")
        self.words = []
        if text or always:
            self.put(text)

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.mark + line).rstrip(" \t\n\f\r"))
        if self.mark:
            self.mark = " " * len(self.mark)

    def edge(self, spaced: bool) -> None:
        self.flush()
        self.gap |= spaced


def _parts(table: Node) -> tuple[list[Node | str], list[Node]]:
    """What stands in a table outside its rows, and the rows: those of row groups and of other elements around rows."""
    around, todo = set(), [(x, ()) for x in table.children]
    while todo:
        x, path = todo.pop()
        if isinstance(x, str) or x.tag == "table":
            continue
        if x.tag == "tr":
            while path and id(path[0]) not in around:
                around.add(id(path[0]))
                path = path[1]
        else:
            todo.extend((y, (x, path)) for y in x.children)
    stray, rows, todo = [], [], list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            stray.append(x)
        elif x.tag == "tr":
            rows.append(x)
        elif x.tag in ("tbody", "thead", "tfoot", "colgroup") or id(x) in around:
            todo.extend(reversed(x.children))
        else:
            stray.append(x)
    return stray, rows


def _alone(x: Node, depth: int) -> list[str]:
    """Lines of an element that stands in a table but in no cell."""
    around = Node("#stray")
    around.children.append(x)
    return render(around, depth + 1)


def _table(page: _Page, table: Node, depth: int) -> None:
    """Captions and stray content first, then the rows with their cells padded to the widest of each column."""
    stray, rows = _parts(table)
    for x in stray:
        if isinstance(x, str):
            page.inline(x)
        else:
            page.flush()
            for line in _alone(x, depth):
                page.put(line)
    page.flush()
    grid, rest = [], []
    until: dict[int, int] = {}  # the row up to which a cell above reaches down into a column
    for i, row in enumerate(rows):
        cells, c = [], 0
        for x in row.children:
            if isinstance(x, Node) and x.tag in ("td", "th"):
                a = x.attributes() if x.attrs else {}
                while until.get(c, 0) > i:
                    c += 1
                cells.append((c, " ".join(line.strip() for line in render(x, depth + 1) if line)))
                span, down = (_number(a.get(n, "1"), 0, 1000, 1) for n in ("colspan", "rowspan"))
                if down != 1:
                    until.update(dict.fromkeys(range(c, c + max(1, span)), len(rows) if down == 0 else i + down))
                c += max(1, span)
            elif isinstance(x, str):
                rest.append(x)
            else:
                rest.extend(_alone(x, depth))
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, text in cells:
            if len(text) <= _WIDEST:
                width[c] = max(width.get(c, 0), len(text))
    columns = sorted(width)
    place, at = {}, 0
    for c in columns:  # columns without text take no room
        place[c] = at
        at += width[c] + 2 if width[c] else 0
    size = sum(len(text) + 2 for cells in grid for _, text in cells)
    padded = sum(place.get(cells[-1][0], 0) for cells in grid if cells)
    aligned = depth == 0 and padded <= _PADDING * size + 1000
    for cells in grid:
        if any(text for _, text in cells):
            if aligned:
                line = ""
                for c, text in cells:
                    if text:
                        gap = place.get(c, 0) - len(line)
                        line += " " * max(gap, 2 if line else 0) + text
                page.put(line)
            else:
                page.put("  ".join(text for _, text in cells if text))
    for x in rest:
        page.inline(x + " ")
    page.flush()


def render(root: Node, depth: int = 0) -> list[str]:
    """Lines of the visible text below a node."""
    page = _Page()
    lists: list[list] = []
    # entries: a node or text to render, or a function to call on leaving an element
    todo: list = list(reversed(root.children))
    pre = 1 if root.tag == "pre" else 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if pre:
                parts = x.split("\n")
                for k, part in enumerate(parts):
                    page.words.append(part.rstrip("\r"))
                    if k < len(parts) - 1:
                        page.put("".join(page.words))
                        page.words = []
            else:
                page.inline(x)
            continue
        if callable(x):
            pre += x() or 0
            continue
        tag = x.tag
        if tag == "br":
            page.flush(always=True)
        elif tag == "img":
            page.inline(x.attributes().get("alt", "")) if x.attrs else None
        elif tag == "input":
            a = x.attributes()
            if a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search"):
                page.inline(a.get("value", ""))
        elif tag == "hr":
            page.edge(True)
        elif tag == "table" and depth < 40:
            page.edge(True)
            _table(page, x, depth)
            page.edge(True)
        else:
            block = tag in BLOCK
            if block:
                page.edge(tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")))
            before = page.indent, page.mark
            delta = 0
            if tag in ("ul", "ol", "menu", "dir"):
                start = x.attributes().get("start", "") if tag == "ol" and x.attrs else ""
                lists.append([tag, _number(start, 0, 10**9, 1)])
                if len(lists) > 1:
                    page.indent, page.mark = page.indent + " " * len(page.mark), ""
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    page.indent, page.mark = page.indent + " " * len(page.mark), f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    page.indent, page.mark = page.indent + " " * len(page.mark), "- "
            elif tag in ("dd", "blockquote"):
                page.indent = page.indent + "  "
            elif tag == "pre":
                delta = 1
            if block or tag == "q":

                def leave(tag=tag, before=before, delta=delta):
                    if delta and page.words:
                        page.put("".join(page.words))
                        page.words = []
                    page.edge(tag in SPACED and not (len(lists) > 1 and tag in ("ul", "ol", "menu", "dir")))
                    if tag in ("ul", "ol", "menu", "dir"):
                        lists.pop()
                    page.indent, page.mark = before
                    return -delta

                todo.append(leave)
            pre += delta
            todo.extend(reversed(x.children))
    page.flush()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def text_of(source: str | None) -> str:
    return "\n".join(render(prune(build(source.replace("\x00", "�"))))).strip("\n") if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in pieces(batches, "html"):
        texts = [text_of(x) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def html_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, text), a row for each page."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, text string")
