"""Records from directory pages by declared rules: elements chosen step by step in a parsed page.

A site's rule says which elements are records and where each field of a record
stands, as steps (tag, classes, attributes; inside, child, next sibling, later
siblings), with an attribute or the text, and a pattern for a part of it. Sites
differ in data, not in code. Pages are parsed by the standard library's reader
with the ends that HTML leaves out; each page is read in a task, by itself.

A null or empty page and one that no rule fits give no record; a field that is
not found is null. A page cut off in the middle gives what stands before the
cut. Pages of any depth are walked without recursion. Text is what is shown:
scripts and styles are left out, character references decoded and white space
inside a piece made one blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element of these ends where one of the others begins.
ENDS = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
HIDDEN = frozenset(["script", "style", "noscript", "template"])


class Node:
    """An element: its tag, attributes, place in the page and what it holds (elements and texts)."""

    __slots__ = ("tag", "attrs", "parent", "held", "at")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, at: int):
        self.tag, self.attrs, self.parent, self.at, self.held = tag, attrs, parent, at, []

    def children(self) -> list[Node]:
        return [c for c in self.held if isinstance(c, Node)]

    def inside(self) -> list[Node]:
        """All elements below, in page order."""
        out, stack = [], self.children()[::-1]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += node.children()[::-1]
        return out

    def later(self) -> list[Node]:
        """Sibling elements after this one."""
        beside = self.parent.children() if self.parent else []
        return [n for n in beside if n.at > self.at]

    def text(self, between: str = " ") -> str:
        """Pieces of text, each trimmed, joined by `between`."""
        pieces, stack = [], self.held[::-1]
        while stack:
            piece = stack.pop()
            if isinstance(piece, str):
                if piece := " ".join(piece.split()):
                    pieces.append(piece)
            elif piece.tag not in HIDDEN:
                stack += piece.held[::-1]
        return between.join(pieces)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None, 0)
        self.n = 0

    def handle_starttag(self, tag, attrs):
        while self.here.parent is not None and tag in ENDS.get(self.here.tag, ()):
            self.here = self.here.parent
        self.n += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here, self.n)
        self.here.held.append(node)
        if tag not in VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.held.append(data)


#: An ampersand that begins no closed reference (`&amp;`, `&#38;`).
UNCLOSED = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


def parsed(html: str, closed: bool = False) -> Node:
    """The page's root; with `closed`, references without their semicolon (as in a text cut off) stay as they stand."""
    builder = _Builder()
    builder.feed(UNCLOSED.sub("&amp;", html) if closed else html)
    builder.close()
    return builder.root


@dataclass(frozen=True)
class Step:
    """One choice: elements `inside`, `child`, `next` (the sibling that follows) or `later` (all that follow) of those before."""

    tag: str = "*"
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str], ...] = ()
    axis: str = "inside"

    def fits(self, node: Node) -> bool:
        held = node.attrs.get("class", "").split()
        return (self.tag in ("*", node.tag)) and all(c in held for c in self.classes) and all(k in node.attrs and re.search(p, node.attrs[k]) for k, p in self.attrs)

    def of(self, node: Node) -> list[Node]:
        found = {"inside": node.inside, "child": node.children, "next": lambda: node.later()[:1], "later": node.later}[self.axis]()
        return [n for n in found if self.fits(n)]


def chosen(root: Node, steps: Sequence[Step]) -> list[Node]:
    """Elements that all steps lead to, each once, in page order."""
    nodes = [root]
    for step in steps:
        nodes = sorted({n.at: n for m in nodes for n in step.of(m)}.values(), key=lambda n: n.at)
    return nodes


@dataclass(frozen=True)
class Field:
    """The first element of `steps` (none: the record itself): its text, or an attribute, or the part of it that a pattern's first group takes."""

    steps: tuple[Step, ...] = ()
    attribute: str | None = None
    pattern: str | None = None
    between: str = " "

    def of(self, record: Node) -> str | None:
        for node in chosen(record, self.steps):
            value = node.text(self.between) if self.attribute is None else node.attrs.get(self.attribute)
            if value is not None and self.pattern:
                hit = re.search(self.pattern, value)
                value = hit[1] if hit else None
            if value:
                return value
        return None


@dataclass(frozen=True)
class Site:
    """A rule of pages whose address fits `url`; records without any of `needed` fields are left out; `closed` as in `parsed`."""

    url: str
    records: tuple[Step, ...]
    fields: Mapping[str, Field]
    needed: tuple[str, ...] = ()
    closed: bool = False


def records(html: str, site: Site) -> list[dict[str, str | None]]:
    found = [{name: f.of(node) for name, f in site.fields.items()} for node in chosen(parsed(html, site.closed), site.records)]
    return [r for r in found if all(r[n] for n in site.needed)]


def read_pages(pages: DataFrame, sites: Sequence[Site], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, position (from 1) and the fields of all sites (text): records by the first site whose pattern fits the page's address."""
    names = list(dict.fromkeys(n for s in sites for n in s.fields))
    rows = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, values = [], [], [[] for _ in names]
            for k, (address, page) in enumerate(zip(batch["_url"].to_pylist(), batch["_html"].to_pylist())):
                site = next((s for s in sites if re.search(s.url, address)), None)
                for i, record in enumerate(records(page, site) if site else [], 1):
                    owners.append(k)
                    places.append(i)
                    for column, name in zip(values, names):
                        column.append(record.get(name))
            arrays = [batch["_key"].take(pa.array(owners, pa.int32())), pa.array(places, pa.int32()), *[pa.array(v, pa.string()) for v in values]]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "position", *names])

    schema = T.StructType([rows.schema["_key"], T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
