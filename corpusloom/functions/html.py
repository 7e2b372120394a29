"""HTML to Markdown: noise stripped, main content chosen, headings, lists, links, code fences and pipe tables kept."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from . import fixed

NOISE = frozenset(fixed.NOISE_ELEMENTS)
_DEEPEST = 150  # elements further down are taken as plain text
_LONG_NUMBER = re.compile(r"&#(?:([xX])([0-9a-fA-F]{7,})|([0-9]{8,}));?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self):
        """This element and all below it, in order."""
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(c for c in reversed(x.children) if isinstance(c, Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "tr", "td", "th"):
            same = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}[tag]
            while self.stack[-1].tag in same:
                self.stack.pop()
        self.stack[-1].children.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _code_point(m: re.Match) -> str:
    digits = (m[2] or m[3]).lstrip("0")
    return "\ufffd" if len(digits) > 7 else f"&#{m[1] or ''}{digits or '0'};"


def parse(source: str) -> Element:
    """The tree of a page; character numbers beyond any code point are U+FFFD, whatever their length."""
    b = _Builder()
    b.feed(_LONG_NUMBER.sub(_code_point, source))
    b.close()
    return b.root


def strip_noise(root: Element) -> None:
    for e in root.walk():
        e.children = [c for c in e.children if isinstance(c, str) or c.tag not in NOISE]


def main_content(root: Element) -> Element:
    for test in (lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.attrs.get("role") == "main", lambda e: e.tag == "body"):
        if (hit := next((e for e in root.walk() if test(e)), None)) is not None:
            return hit
    return root


def code_language(e: Element) -> str:
    """Of the classes of the element and those below it, the first that names a language."""
    for x in e.walk():
        for name in x.attrs.get("class", "").lower().split():
            if m := re.search(fixed.CODE_CLASS, name):
                return m[1]
            if name in fixed.CODE_LANGUAGES:
                return name
    return ""


def table_markdown(table: Element, most: int = 30) -> str:
    rows = [[c for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return re.sub(r"\s+", " ", table.text()).strip()
    grid = [[re.sub(r"\s+", " ", c.text()).strip().replace("|", "\\|") for c in r] for r in rows[:most]]
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    head, body = (grid[0], grid[1:]) if any(c.tag == "th" for c in rows[0]) else ([f"col_{i + 1}" for i in range(width)], grid)
    lines = ["| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *body]]
    if len(rows) > most:
        lines.append(f"\n*(table truncated to {most} rows)*")
    return "\n".join(lines)


def _inline(e: Element | str, depth: int = 0) -> str:
    if isinstance(e, str):
        return re.sub(r"\s+", " ", e)
    if depth > _DEEPEST:
        return re.sub(r"\s+", " ", e.text())
    inner = "".join(_inline(c, depth + 1) for c in e.children)
    if e.tag in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if e.tag in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    if e.tag == "code":
        return f"`{e.text()}`"
    if e.tag == "a" and e.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({e.attrs['href']})"
    return "\n" if e.tag == "br" else inner


_BLOCKS = frozenset("#root html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li pre table blockquote dl dt dd figure figcaption hr".split())


def to_markdown(e: Element, depth: int = 0) -> list[str]:
    """Markdown blocks of an element."""
    out: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(words)).strip()
        words.clear()
        if text:
            out.append(text)

    for c in e.children:
        if isinstance(c, str) or c.tag not in _BLOCKS:
            words.append(_inline(c, depth))
            continue
        flush()
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if text := re.sub(r"\s+", " ", c.text()).strip():
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "pre":
            out.append(f"```{code_language(c)}\n{c.text().strip(chr(10))}\n```")
        elif c.tag == "table":
            out.append(table_markdown(c))
        elif c.tag in ("ul", "ol") and depth < _DEEPEST:
            items = [x for x in c.children if isinstance(x, Element) and x.tag == "li"]
            lines = [f"{'1.' if c.tag == 'ol' else '-'} " + "\n".join(to_markdown(x, depth + 1)).replace("\n", "\n  ") for x in items]
            out.append("\n".join(lines))
        elif depth < _DEEPEST:
            out.extend(to_markdown(c, depth + 1))
        else:
            words.append(re.sub(r"\s+", " ", c.text()))
    flush()
    return out


def html_markdown(source: str) -> str:
    root = parse(source)
    strip_noise(root)
    return "\n\n".join(to_markdown(main_content(root)))
