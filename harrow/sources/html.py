"""HTML as rows: one Arrow pass turns a page into its text and its elements; everything after is DataFrame work.

An element says where its text begins and ends in the page's text and where it begins and ends in the source, which
elements are above it, which is the last below and which stands before it, so that a page's elements take little more
room than the page. ``selectors`` finds them.

Supported: tags in any case, void elements, unquoted attributes, entities, script and style as raw text; an end
tag closes up to its start tag and is dropped if there is none. Browser repair (tables, formatting) is not.

Browsers take a character reference without its semicolon (``&amp`` at a cut) for one; ``whole_refs`` leaves it as text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import small_batches
from .selectors import select  # noqa: F401

#: pos, last, parent and before are places in the page's array of elements (-1: none); nth of of siblings, nth_type of
#: of_type siblings of its tag; start and end in the text, from and to in the source.
NUMBERS = ["pos", "last", "parent", "before", "nth", "of", "nth_type", "of_type", "start", "end", "from", "to"]
ELEMENT = "struct<" + ",".join(f"`{n}`:int" for n in NUMBERS) + ",above:array<int>,tag:string,attrs:map<string,string>>"
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    def __init__(self, html: str, mark: str | None = None) -> None:
        """mark: a character that stands for the & of text that is no reference."""
        super().__init__(convert_charrefs=True)
        self.html = html
        self.plain = (lambda s: s.replace(mark, "&")) if mark else (lambda s: s)
        self.lines = [0, *[m.end() for m in re.finditer("\n", html)]]
        self.out: list[dict] = []
        self.open: list[int] = []
        self.below: dict[int, list[int]] = {}
        self.pieces: list[str] = []
        self.length = 0

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = self.plain(tag)
        pos, at = len(self.out), self.place()
        own = {self.plain(k): self.plain(v or "") for k, v in reversed(attrs)}
        parent = self.open[-1] if self.open else -1
        siblings = self.below.setdefault(parent, [])
        self.out.append({"pos": pos, "last": pos, "parent": parent, "before": siblings[-1] if siblings else -1, "above": list(self.open), "tag": tag, "attrs": own, "start": self.length, "end": self.length, "from": at, "to": at + len(self.get_starttag_text() or "")})
        siblings.append(pos)
        if tag not in VOID:
            self.open.append(pos)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        tag = self.plain(tag)
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.out[self.open[i]]["tag"] == tag), None)
        if at is not None:
            start = self.place()
            self.leave(at + 1, start)
            self.leave(at, self.html.find(">", start) + 1 or len(self.html))

    def leave(self, at: int, place: int) -> None:
        """Closes what is open from there on, at a place in the source."""
        for p in self.open[at:]:
            self.out[p] |= {"last": len(self.out) - 1, "end": self.length, "to": place}
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.pieces.append(self.plain(data))
        self.length += len(data)

    def ranked(self) -> list[dict]:
        """The elements with their places among their siblings."""
        for siblings in self.below.values():
            tags = Counter(self.out[p]["tag"] for p in siblings)
            met: Counter = Counter()
            for k, p in enumerate(siblings):
                e = self.out[p]
                met[e["tag"]] += 1
                e |= {"nth": k + 1, "of": len(siblings), "nth_type": met[e["tag"]], "of_type": tags[e["tag"]]}
        return self.out


def _marked(html: str) -> tuple[str, str | None]:
    """html with a mark, a character that it lacks, for each & that begins no whole reference; lengths stay."""
    bare = lambda m: not m[1] or (m[1][0] != "#" and m[1] not in html5)
    if not any(map(bare, _REFERENCE.finditer(html))):
        return html, None
    held = set(html)
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in held)
    return _REFERENCE.sub(lambda m: mark + (m[1] or "") if bare(m) else m[0], html), mark


def parse(html: str | None, whole_refs: bool = False) -> tuple[str, list[dict]]:
    """The page's text, and its elements in document order (see NUMBERS); above: the positions of all ancestors."""
    shown, mark = _marked(html or "") if whole_refs else (html or "", None)
    t = _Tree(html or "", mark)
    t.feed(shown)
    t.close()
    t.leave(0, len(t.html))
    return "".join(t.pieces), t.ranked()


def _arrow(pages: list[str | None], whole_refs: bool = False) -> pa.StructArray:
    """Text and elements of pages, column by column."""
    parsed = [parse(p, whole_refs) for p in pages]
    flat = [e for _, elements in parsed for e in elements]
    edges = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))]).astype(np.int32))
    strings = lambda values: pa.array(list(values), pa.string())
    above = pa.ListArray.from_arrays(edges(len(e["above"]) for e in flat), pa.array([p for e in flat for p in e["above"]], pa.int32()))
    attrs = pa.MapArray.from_arrays(edges(len(e["attrs"]) for e in flat), strings(k for e in flat for k in e["attrs"]), strings(v for e in flat for v in e["attrs"].values()))
    columns = {n: pa.array([e[n] for e in flat], pa.int32()) for n in NUMBERS} | {"above": above, "tag": strings(e["tag"] for e in flat), "attrs": attrs}
    lists = pa.ListArray.from_arrays(edges(len(elements) for _, elements in parsed), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
    return pa.StructArray.from_arrays([strings(text for text, _ in parsed), lists], ["text", "elements"])


def _parts(pages: pa.Array, most: int = 64, chars: int = 1 << 18) -> Iterator[list[str | None]]:
    """The pages in order, so many and about so long at a time: what a worker holds follows neither the batch nor the file."""
    part, held = [], 0
    for page in (x.as_py() for x in pages):
        part.append(page)
        held += len(page or "")
        if len(part) >= most or held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def with_elements(df: DataFrame, html: str, name: str = "elements", whole_refs: bool = False) -> DataFrame:
    """df with the page's elements as an array, and its text as <name>_text."""

    @F.arrow_udf(f"struct<text:string,elements:array<{ELEMENT}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in _parts(b):
                yield _arrow(part, whole_refs)

    small_batches(df.sparkSession)
    page = f"{name}_page"
    return df.withColumn(page, run(F.col(html))).withColumns({name: F.col(page)["elements"], f"{name}_text": F.col(page)["text"]}).drop(page)


def text(e: Column, name: str = "elements") -> Column:
    """The text of an element and all below it."""
    return F.substring(F.col(f"{name}_text"), e["start"] + 1, e["end"] - e["start"])


def source(e: Column, html: str) -> Column:
    """An element's own source, from its start tag to the end of its end tag; an element without one ends where the
    next end tag outside it begins."""
    return F.substring(F.col(html), e["from"] + 1, e["to"] - e["from"])


def inside(elements: Column, box: Column, test) -> Column:
    """The first element under box that passes test."""
    return F.get(F.filter(elements, lambda e: (e["pos"] > box["pos"]) & (e["pos"] <= box["last"]) & F.coalesce(test(e), F.lit(False))), 0)
