"""Text functions as Column expressions; Python's meaning of a pattern is kept by (?U) or ASCII classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def dehyphenated(t: Column) -> Column:
    return F.regexp_replace(t, "([0-9A-Za-z])-\n[ \t]*([0-9A-Za-z])", "$1$2")


def collapsed(t: Column, keep: int = 2) -> Column:
    """No white space at line ends, at most `keep` newlines in a row."""
    return F.regexp_replace(F.regexp_replace(t, "(?U)[^\\S\n]+(?=\n|\\z)", ""), "\n{%d,}" % (keep + 1), "\n" * keep)


def normalized(t: Column, nfkc: Column | None = None) -> Column:
    """newlines, NFKC (if given as a column), invisible characters, ligatures, hyphenation, line ends, blank lines, trim."""
    t = newlines(t) if nfkc is None else nfkc
    t = F.translate(t, "​‌‍﻿­", "")
    for ligature, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = F.replace(t, F.lit(ligature), F.lit(plain))
    return F.regexp_replace(collapsed(dehyphenated(t)), "(?U)^\\s+|\\s+\\z", "")


def slug(t: Column, size: int = 60) -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(size))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("doc"))


def docs_id(url: Column, version: Column) -> Column:
    return F.concat(F.lit("docs_"), slug(F.parse_url(url, F.lit("HOST"))), F.lit("_"), F.left(F.sha1(F.concat_ws("|", url, F.coalesce(version, F.lit("")))), F.lit(12)))


def github_id(owner: Column, name: Column, commit: Column, path: Column) -> Column:
    return F.concat(F.lit("gh_"), slug(owner), F.lit("_"), slug(name), F.lit("_"), F.left(F.sha1(F.concat(owner, F.lit("/"), name, F.lit("@"), commit, F.lit(":"), path)), F.lit(12)))


def arxiv_id(paper: Column, version: Column) -> Column:
    return F.concat(F.lit("arxiv_"), paper, F.lit("v"), version.cast("string"))


def pick(json: Column, *paths: str) -> Column:
    """The first string at one of the paths that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths])


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))), F.lit("text"))


def terms(t: Column) -> Column:
    """Distinct index tokens in first-seen order: technical tokens, then words of two and more letters."""
    noise_free = F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), "(?s)" + fixed.MARKDOWN_NOISE, " $1$2$3 "))

    def of(x: Column) -> Column:
        rest = F.regexp_replace(x, fixed.TECH_TOKEN, " ")
        return F.concat(F.regexp_extract_all(x, F.lit(fixed.TECH_TOKEN), F.lit(0)), F.regexp_extract_all(rest, F.lit(fixed.WORD), F.lit(0)))

    # a lambda over a single element computes its argument once, however often the body reads it
    return F.array_distinct(F.get(F.transform(F.array(noise_free), of), 0))


def sub_tokens(ts: Column) -> Column:
    """Tokens as the index stores them: split once more at hyphens, underscores and dots."""
    return F.flatten(F.transform(ts, lambda x: F.split(x, "[-_.]")))


def counted_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(fixed.COUNTED_TOKEN), F.lit(0))


def sentences(t: Column) -> Column:
    return F.split(t, "(?<=[.!?])\\s+")


def citation_ids(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(fixed.CITATION), F.lit(1)))


def without_citations(t: Column) -> Column:
    return F.regexp_replace(t, fixed.CITATION, "")


def numbers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?i)" + fixed.NUMBER), F.lit(1))


def number_core(n: Column) -> Column:
    return F.trim(F.regexp_replace(n, "(?i)" + fixed.UNIT, ""))


def preview(t: Column, size: int = 200, mark: str = "...") -> Column:
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit(mark))).otherwise(t)


def parent_cut(t: Column, size: int = 6000) -> Column:
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("\n…[truncated]"))).otherwise(t)


def grounded(claim: Column, source: Column, threshold: Column) -> Column:
    """Whether enough of the claim's content words occur in the source; true without content words."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    words = F.filter(F.split(F.trim(F.regexp_replace(without_citations(claim), "\\s+", " ")), " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)))
    words = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^[.,;:!?()]+|[.,;:!?()]+$", "")))
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(source), w)))
    return F.when(F.size(words) == 0, F.lit(True)).otherwise(found / F.size(words) >= threshold)


def heading_line(s: Column) -> Column:
    """Whether a trimmed line of page text is a heading: a known word, numbered, or in capitals."""
    known = F.regexp_replace(F.lower(s), ":+$", "").isin(*fixed.HEADINGS)
    numbered = s.rlike(fixed.NUMBERED_HEADING) & ~s.endswith(".")
    letters, upper = F.length(F.regexp_replace(s, "[^\\p{L}]", "")), F.length(F.regexp_replace(s, "[^\\p{Lu}]", ""))
    capitals = (letters >= 6) & (upper / F.greatest(letters, F.lit(1)) > 0.85) & (F.size(F.split(F.trim(s), "\\s+")) <= 10)
    return (s != "") & (F.length(s) <= 120) & (known | numbered | capitals)


def heading_level(s: Column) -> Column:
    number = F.regexp_extract(s, "^\\s*([0-9]+(?:\\.[0-9]+)*)\\s+.+$", 1)
    return F.when(number == "", F.lit(2)).otherwise(F.least(F.lit(1) + F.size(F.split(number, "\\.")), F.lit(4)))
