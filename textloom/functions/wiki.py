"""Wiki markup as plain text with links: one pass over balanced brackets, then line-wise cleaning.

Templates, tables, comments, footnotes, formulas, tags and categories go; links become their anchors, with offsets in
the cleaned text; captions of files stand at the end. Unbalanced openings stay as they are. Null gives null.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMMENT = regex.compile(r"<!--.*?-->", regex.S)
_DROPPED = regex.compile(r"<(ref|nowiki|math)\b(?:[^>]*/>|.*?</\1\s*>)", regex.S | regex.I)
_TAG = regex.compile(r"<[^<>\n]*>")
_URL = regex.compile(r"\[\w+://[^\s\]]*\s*([^\]]*)\]")
_LINK = regex.compile(r"\[\[:?([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_CATEGORY = regex.compile(r"\[\[Category:([^\[\]|]*)[^\[\]]*\]\]")
_SECTION = regex.compile(r"(==+)[ \t]*([^=\n]*?)[ \t]*\1")
_ENTITY = regex.compile(r"&#?\w+;")
_EMPTY = regex.compile(r" \(\s*\)|（\s*）")


def without_balanced(text: str, opening: str, closing: str) -> str:
    """The text without its outermost balanced stretches (ST5)."""
    out, depth, start, i, kept = [], 0, 0, 0, 0
    while i < len(text):
        if text.startswith(opening, i):
            if not depth:
                start = i
            depth += 1
            i += len(opening)
        elif depth and text.startswith(closing, i):
            depth -= 1
            i += len(closing)
            if not depth:
                out.append(text[kept:start])
                kept = i
        else:
            i += 1
    out.append(text[kept:])
    return "".join(out)


def file_captions(text: str) -> tuple[str, list[str]]:
    """The text without [[File:...]] and [[Image:...]], and their captions (ST6)."""
    out, captions, i = [], [], 0
    for m in regex.finditer(r"\[\[(?:file|image):", text, regex.I):
        if m.start() < i:
            continue
        depth, j = 0, m.start()
        while j < len(text):
            if text.startswith("[[", j):
                depth, j = depth + 1, j + 2
            elif text.startswith("]]", j):
                depth, j = depth - 1, j + 2
                if not depth:
                    break
            else:
                j += 1
        if depth:
            break
        inner = text[m.end() : j - 2]
        level, cut = 0, 0
        for k, c in enumerate(inner):
            level += c == "["
            level -= c == "]"
            if c == "|" and level <= 0:
                cut = k + 1
        if cut and inner[cut:].strip():
            captions.append(inner[cut:].strip())
        out.append(text[i : m.start()])
        i = j
    out.append(text[i:])
    return "".join(out), captions


def unescape(text: str) -> str:
    """Named, decimal and hexadecimal entities; unknown ones stay (ST7)."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text)


def categories(text: str) -> list[str]:
    """Names of [[Category:...]] links (ST10)."""
    return [m.group(1).strip() for m in _CATEGORY.finditer(text)]


def sections(text: str) -> list[tuple[str, int, int]]:
    """Headings with their places (ST10)."""
    return [(m.group(), m.start(), m.end()) for m in _SECTION.finditer(text)]


def title_of(target: str) -> str:
    """A link target as a title (ST8)."""
    t = target.replace("_", " ").strip()
    return t[:1].upper() + t[1:]


def plain_links(text: str) -> tuple[str, list[dict]]:
    """The text with links as their anchors, and title, text, begin, end of each (ST9)."""
    out, links, size, at = [], [], 0, 0
    for m in _LINK.finditer(text):
        title = title_of(m.group(1))
        anchor = (m.group(2) or "").strip() or title
        lead = text[at : m.start()]
        out += [lead, anchor]
        begin = size + len(lead)
        size = begin + len(anchor)
        at = m.end()
        if title:
            links.append({"title": title, "text": anchor, "begin": begin, "end": size})
    out.append(text[at:])
    return "".join(out), links


def clean(text: str) -> str:
    """Markup removed but for links (ST4)."""
    t = without_balanced(without_balanced(_COMMENT.sub("", text), "{{", "}}"), "{|", "|}")
    t, captions = file_captions(t)
    if captions:
        t += "\n" + "\n".join(captions)
    t = _CATEGORY.sub("", _DROPPED.sub("", t))
    t = _URL.sub(r"\1", _TAG.sub("", t))
    t = regex.sub(r"'{2,5}", "", t).replace("[]", "")
    t = regex.sub(r"(?m)^[|!].*?(?=[^|!]*$)", "", t) if regex.search(r"(?m)^[|!]", t) else t
    return unescape(_EMPTY.sub("", t).strip())


def read_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, article, links, categories, sections of each page's markup; one Arrow pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    span = "array<struct<text:string,begin:int,end:int>>"
    link = "array<struct<title:string,text:string,begin:int,end:int>>"
    types = [pa.string(), pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.struct([("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                article, links = plain_links(clean(t))
                rows.append((article, links, categories(t), [{"text": x, "begin": a, "end": e} for x, a, e in sections(article)]))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], names=[key, "article", "links", "categories", "sections"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, article string, links {link}, categories array<string>, sections {span}")
