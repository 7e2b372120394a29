"""Markdown: normalizing outside fences, sections, blocks and child chunks. Pure functions; Spark calls them in Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from . import fixed

_FENCE = re.compile(fixed.FENCE)
_HEADING = re.compile(fixed.HEADING, re.M)
_ANCHOR = re.compile(fixed.ANCHOR)
_SECTION_NUMBER = re.compile(fixed.SECTION_NUMBER)
_TABLE_ROW = re.compile(fixed.TABLE_ROW)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def plain_text(text: str) -> str:
    """normalize_text of one string, with NFKC."""
    t = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = t.translate({0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0xAD: None})
    t = re.sub(r"([0-9A-Za-z])-\n[ \t]*([0-9A-Za-z])", r"\1\2", t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in t.split("\n"))).strip()


def fenced(md: str) -> Iterator[tuple[bool, str]]:
    """(is code, text) of runs; a fence closes only on its own kind and runs to the end if it never does."""
    run: list[str] = []
    mark = ""
    for line in md.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = _FENCE.match(line)
        if not mark and m:
            if run:
                yield False, "\n".join(run)
            run, mark = [line], m[1]
        elif mark and m and m[1] == mark:
            yield True, "\n".join([*run, line])
            run, mark = [], ""
        else:
            run.append(line)
    if run:
        yield bool(mark), "\n".join(run)


def normalize_markdown(md: str) -> str:
    """Text outside fences normalized, parts joined by a blank line; blank runs collapse in code as well."""
    parts = [text if code else plain_text(text) for code, text in fenced(md)]
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(p for p in parts if p.strip())).strip()


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def _masked(content: str) -> str:
    """The same length with the lines inside fences blanked, so that no heading is seen in code."""
    out, mark = [], ""
    for line in content.split("\n"):
        m = _FENCE.match(line)
        inside = bool(mark)
        if m and not mark:
            mark = m[1]
        elif m and m[1] == mark:
            mark = ""
        out.append(" " * len(line) if inside or m else line)
    return "\n".join(out)


def headings(content: str) -> list[tuple[int, int, int, str]]:
    """(begin, end, level, text), but for headings that are an anchor alone.

    Where all of more than three are H1, section numbers give the levels; a heading without one has that of the last number.
    """
    found = [(m.start(), m.end(), len(m[1]), text) for m in _HEADING.finditer(_masked(content)) if (text := _ANCHOR.sub("", m[2]).strip())]
    if len(found) > 3 and all(h[2] == 1 for h in found):
        out, level = [], 1
        for begin, end, _, text in found:
            if m := _SECTION_NUMBER.match(text):
                level = min(m[1].count(".") + 1, 4)
            out.append((begin, end, level, text))
        return out
    return found


def _stripped(content: str, begin: int, end: int) -> tuple[int, int]:
    """The span without the white space at its ends."""
    text = content[begin:end]
    return begin + len(text) - len(text.lstrip()), begin + len(text.rstrip()) if text.strip() else begin + len(text) - len(text.lstrip())


def sections(content: str) -> list[dict]:
    """Heading, level, path ("A > B") and body of each section, with the spans of section and body; text before the first is "Document"."""
    marks, out = headings(content), []
    before = marks[0][0] if marks else len(content)
    if content[:before].strip():
        out.append({"heading": "Document", "level": 0, "path": "Document", "span": (0, before), "at": _stripped(content, 0, before)})
    stack: list[tuple[int, str]] = []
    for k, (begin, end, level, text) in enumerate(marks):
        stop = marks[k + 1][0] if k + 1 < len(marks) else len(content)
        stack = [s for s in stack if s[0] < level] + [(level, text)]
        out.append({"heading": text, "level": level, "path": " > ".join(t for _, t in stack), "span": (begin, stop), "at": _stripped(content, end, stop)})
    return [s | {"body": content[s["at"][0] : s["at"][1]]} for s in out]


def blocks(content: str, begin: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of what stands between two places: fenced code and runs of table rows whole, all else as paragraphs."""
    end = len(content) if end is None else end
    out: list[tuple[str, int, int]] = []
    kind, start, at, mark = "", begin, begin, ""

    def close(stop: int) -> None:
        a, b = (start, min(stop, end)) if kind == "code" else _stripped(content, start, min(stop, end))
        if kind and a < b:
            out.append((kind, a, b))

    while at <= end:
        stop = content.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = content[at:stop]
        fence = _FENCE.match(line)
        if mark:
            if fence and fence[1] == mark:
                close(stop)
                kind, mark = "", ""
        else:
            now = "code" if fence else "table" if _TABLE_ROW.match(line) else "paragraph"
            if now != kind or now == "code":
                close(max(start, at - 1))
                kind, start, mark = now, at, fence[1] if fence else ""
        if not kind:
            start = stop + 1
        at = stop + 1
    close(end)
    return out


def windows(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of token windows over a paragraph; the whole of it if it is short enough."""
    at = [m.span() for m in _TOKEN.finditer(text)]
    if len(at) <= most:
        return [(0, len(text))] if text.strip() else []
    out, pos, step = [], 0, max(1, most - overlap)
    while True:
        some = at[pos : pos + most]
        out.append((some[0][0], some[-1][1]))
        if pos + most >= len(at):
            return out
        pos += step


def _id(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def chunk_document(doc_id: str, content: str, most: int = 400, overlap: int = 50, parent_most: int = 1500) -> tuple[list[dict], list[dict]]:
    """(parents, children) of a document; ids depend on the document and the place alone.

    char_start and char_end of a child are the place of its text in the document, those of a parent that of its section
    with the heading.
    """
    parents, children = [], []
    for k, s in enumerate(sections(content)):
        if not s["body"]:
            continue
        parent = _id(doc_id, k)
        a, b = (windows(s["body"], parent_most, 0) or [(0, len(s["body"]))])[0]
        text = s["body"][a:b]
        parents.append({"parent_id": parent, "doc_id": doc_id, "parent_idx": k, "section": s["path"], "heading_level": s["level"], "text": text, "token_count": count_tokens(text), "char_start": s["span"][0], "char_end": s["span"][1]})
        n = 0
        for kind, begin, end in blocks(content, *s["at"]):
            for a, b in [(0, end - begin)] if kind != "paragraph" else windows(content[begin:end], most, overlap):
                piece = content[begin + a : begin + b]
                children.append(
                    {"chunk_id": _id(doc_id, k, n), "parent_id": parent, "doc_id": doc_id, "section": s["path"], "text": piece, "token_count": count_tokens(piece)}
                    | {"chunk_index": n, "parent_idx": k, "is_table": kind == "table", "is_code": kind == "code", "char_start": begin + a, "char_end": begin + b}
                )
                n += 1
    return parents, children


def code_fence(path: str, text: str) -> str:
    """A file of a repository as Markdown: its own if it is Markdown, else fenced with its language."""
    suffix = re.search(r"(\.[^./]+)$", path)
    lang = fixed.LANGUAGES.get(suffix[1].lower() if suffix else "", "text")
    return text if lang == "markdown" else f"```{lang}\n{text.rstrip()}\n```"
