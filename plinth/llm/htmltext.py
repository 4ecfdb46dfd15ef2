"""Main text of web pages by site style trees.

Pages of a host are merged into one style tree: a style node is a path of
element styles (tag, classes, id and role with digits folded) from the root.
For a node seen on m pages

* presentation importance is the entropy, to base m, of the sequences of
  child styles found there;
* content importance is one minus the mean, over the texts found in its whole
  branch, of the text's entropy over pages, log n / log m for a text on n pages;
* the importance is (1 - GAMMA^l) * presentation + GAMMA^l * content, with l
  the number of different child sequences.

Branches of importance under LEAST are removed, if the node is on at least
MIN_PAGES pages: fewer pages tell nothing, and two copies of one article would
look like a template. Names of classes and ids only settle what the tree
leaves open: a branch named as boilerplate goes if its node is on too few
pages, or unless the tree puts it over NAMED, which takes texts and layouts
that differ from page to page, as an article's do. What holds the article or most of a
page's text is never removed for its name.

The markup itself decides two things, whatever the tree says. Elements that
HTML defines as something else than the content (nav, footer, aside, form, a
page's header, ...) go, and so do hidden ones and those named as comments; a
form around the whole page is no such element. Where a page marks its article or main part, only that is
kept, and plain headings, paragraphs and lists in it are never judged by
repetition, since an article may be published many times. If removal by
importance leaves nothing of a page, its other text stands.

Pages are parsed once, into a table in the shared folder: tree, flags and text
blocks. Importance is aggregated from it, and removal reads it again.

Blocks are texts between block-level tags, their white space runs made one
space; they are joined by two line breaks in page order. Missing head, body
and end tags are allowed. A null or empty html gives an empty text; a null or
odd url has a host of its own without a tree; repeated rows are judged alike;
very long pages and deep nesting are gone through whole; columns of `pages`
named text or n_chars are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StringType

from plinth.llm.common import cut, with_fields, write_and_read

GAMMA, LEAST, NAMED, MIN_PAGES = 0.9, 0.5, 0.95, 5
#: Elements by their role in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe svg canvas object audio video math title textarea select button".split())
DECLARED_TAGS = frozenset("nav footer aside dialog menu".split())
DECLARED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names that break ties.
BOILERPLATE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs cookie cookies footer header masthead menu nav navbar navigation newsletter notice pager pagination popup promo related search share sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Names that always count: readers' comments differ from page to page as the content does.
COMMENT_NAMES = frozenset(["comment", "comments"])
PLAIN = frozenset("article main section div p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tbody thead tr td th dl dt dd figure figcaption".split())
#: An open element of the first kind ends at the start of one of the second.
CLOSED_BY = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Flags of a node: what the markup or a name says of it, and what it is.
DECLARED, NAME, WRAPS, IS_PLAIN, ARTICLE, MAIN = (1 << i for i in range(6))


@lru_cache(1 << 16)
def _hash(above: int, own: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{above}/{own}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 14)
def _is_named(tag: str, named: str, in_main: bool) -> tuple[bool, bool]:
    """Whether a class or id names the element as boilerplate, as comments."""
    if not named or tag in ("html", "body", "main"):
        return False, False
    words = set(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", named).lower().replace("_", "-").replace("-", " ").split())
    return bool(words & BOILERPLATE_NAMES - ({"header"} if in_main else set())), bool(words & COMMENT_NAMES)


class Page(HTMLParser):
    """The tree of a page's block elements (parents, style paths, child sequences, flags) and its text blocks."""

    def __init__(self, html: str, seen: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.shown = html, seen
        self.parents, self.tags, self.paths, self.flags = [-1], ["#root"], [0], [IS_PLAIN]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self.at, self.unseen, self.text = 0, [], []
        self.feed(html)
        self.close()
        self._flush()
        self._settle()

    def _flush(self) -> None:
        if self.text:
            if block := " ".join("".join(self.text).split()):
                self.blocks.append((self.at, block))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag == self.unseen[-1] and tag not in ("script", "style"):
                self.unseen.append(tag)
            return
        if tag in UNSEEN and tag not in self.shown:
            self.unseen.append(tag)
            return
        if tag == "br":
            self.text.append(" ")
        if tag not in BLOCK:
            return
        self._flush()
        if tag in VOID:
            return
        while tag in CLOSED_BY.get(self.tags[self.at], ()):
            self.at = self.parents[self.at]
        got = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style")}
        named = " ".join((got.get("class", ""), got.get("id", ""))).strip()
        role = got.get("role", "").lower()
        style = f"{tag}.{re.sub('[0-9]+', '#', named)}.{role}" if got else tag
        in_main = bool(self.flags[self.at] & (ARTICLE | MAIN))
        is_named, is_comment = _is_named(tag, named, in_main)
        declared = (
            tag in DECLARED_TAGS
            or is_comment
            or (tag == "header" and not in_main)
            or role in DECLARED_ROLES
            or "hidden" in got
            or "display:none" in got.get("style", "").replace(" ", "").lower()
        )
        flags = self.flags[self.at] & (ARTICLE | MAIN | DECLARED)  # what holds for all below
        flags |= DECLARED * declared | NAME * (tag == "form" or is_named) | IS_PLAIN * (tag in PLAIN and not named)
        flags |= ARTICLE * (tag == "article") | MAIN * (tag == "main")
        self.children[self.at].append(style)
        self.parents.append(self.at)
        self.tags.append(tag)
        self.paths.append(_hash(self.paths[self.at], style))
        self.flags.append(flags)
        self.children.append([])
        self.at = len(self.tags) - 1

    def _settle(self) -> None:
        """What wraps an article or main part, or most of the text in several blocks; forms that don't are declared."""
        n = len(self.tags)
        size, count, holds = [0] * n, [0] * n, [t in ("article", "main") and not f & DECLARED for t, f in zip(self.tags, self.flags)]
        for node, text in self.blocks:
            if not self.flags[node] & DECLARED:
                size[node] += len(text)
                count[node] += 1
        for node in range(n - 1, 0, -1):  # children come after their parents
            above = self.parents[node]
            size[above] += size[node]
            count[above] += count[node]
            holds[above] |= holds[node]
        for node in range(1, n):
            if holds[node] and self.tags[node] != "article" or (size[node] > 0.6 * size[0] and count[node] >= 3):
                self.flags[node] |= WRAPS
            above = self.flags[self.parents[node]] & DECLARED
            self.flags[node] |= above or DECLARED * (self.tags[node] == "form" and not self.flags[node] & WRAPS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # `<div/>` is a start tag in HTML; only void elements end at once.
        self.handle_starttag(tag, attrs)
        if self.unseen and self.unseen[-1] == tag and tag in ("svg", "math", "object", "iframe", "canvas"):
            self.unseen.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            return
        if tag not in BLOCK:
            return
        self._flush()
        node = self.at
        while node > 0 and self.tags[node] != tag:
            node = self.parents[node]
        if node > 0:
            self.at = self.parents[node]

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)

    def sequences(self) -> list[int]:
        """A hash of each node's child styles; runs of one style are one, as an article's length is not its layout."""
        return [_hash(1, "|".join(x for i, x in enumerate(styles) if i == 0 or x != styles[i - 1])) for styles in self.children]


def parse(html: str) -> Page:
    """A page's tree; an unseen element that never ends hides nothing (but for code, which ends with the page)."""
    shown: frozenset[str] = frozenset()
    while True:
        page = Page(html, shown)
        left_open = frozenset(page.unseen) - {"script", "style"}
        if not left_open:
            return page
        shown |= left_open


def main_text(parents: list[int], paths: list[int], flags: list[int], nodes: list[int], texts: list[str], low: frozenset[int], by_name: frozenset[int] | None) -> str:
    """The text without declared branches, branches at `low` paths, and named ones at `by_name` paths (None: all named)."""
    seen = [(n, t) for n, t in zip(nodes, texts) if not flags[n] & DECLARED]
    main = 0
    for kind in (ARTICLE, MAIN):
        if inner := [(n, t) for n, t in seen if flags[n] & kind]:
            seen, main = inner, kind
            break
    # Parents come before their children: each node asks its parent once. The part that is kept is never low itself.
    gone = [False] * len(parents)
    for node in range(1, len(parents)):
        own, above = flags[node], parents[node]
        if main and own & main and not flags[above] & main:
            continue
        is_low = paths[node] in low and not (main and own & IS_PLAIN)
        is_named = own & NAME and not own & WRAPS and (by_name is None or paths[node] in by_name)
        gone[node] = gone[above] or is_low or bool(is_named)
    return "\n\n".join([t for n, t in seen if not gone[n]] or [t for _, t in seen])


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


_PARSED = {"_parents": ArrayType(IntegerType()), "_paths": ArrayType(LongType()), "_sequences": ArrayType(LongType()), "_flags": ArrayType(ByteType()), "_nodes": ArrayType(IntegerType()), "_texts": ArrayType(StringType())}


def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` without html, plus host and the parsed tree and blocks, written once."""
    kept = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    rows = pages.select(*kept, _host(url_col).alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    n = len(kept) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                found = [parse(h) for h in part.column(n).to_pylist()]
                made = {
                    "_parents": [p.parents for p in found],
                    "_paths": [p.paths for p in found],
                    "_sequences": [p.sequences() for p in found],
                    "_flags": [p.flags for p in found],
                    "_nodes": [[b[0] for b in p.blocks] for p in found],
                    "_texts": [[b[1] for b in p.blocks] for p in found],
                }
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *[pa.array(made[k], pa.list_(t)) for k, t in zip(_PARSED, kinds)]], names=[*kept, "_host", *_PARSED])

    return write_and_read(rows.mapInArrow(run, with_fields(rows.drop("_html"), **_PARSED)), "pages")


def importance(trees: DataFrame) -> DataFrame:
    """host, path, pages, is_named and importance of each style node of parsed pages."""
    known = trees.where("_host <> ''").select(F.col("_host").alias("host"), "_parents", "_paths", "_sequences", "_flags", "_nodes", "_texts")
    # Each path, and each text at its path, counts once for a page.
    styles = F.transform(F.col("_paths"), lambda p, i: F.struct(p.alias("path"), F.get("_sequences", i).alias("value"), F.get("_flags", i).bitwiseAND(F.lit(NAME)).alias("name"), F.get("_paths", F.get("_parents", i)).alias("above")))
    seen = known.select("host", F.explode(F.array_distinct(F.slice(styles, 2, F.size("_paths")))).alias("s")).select("host", "s.*")
    by_style = seen.groupBy("host", "path", "value").agg(F.count("*").alias("n"), F.max("name").alias("name"), F.first("above").alias("above"))
    nodes = cut(
        by_style.groupBy("host", "path").agg(
            F.sum("n").alias("_seen"), F.sum(F.col("n") * F.log("n")).alias("_nlogn"), F.count("*").alias("_styles"), (F.max("name") > 0).alias("is_named"), F.first("above").alias("above")
        )
    )
    texts = F.transform(F.col("_nodes"), lambda n, i: F.struct(F.get("_paths", n).alias("path"), F.xxhash64(F.get("_texts", i)).alias("text")))
    own = known.select("host", F.explode(F.array_distinct(texts)).alias("t")).select("host", "t.*").groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    own = own.groupBy("host", "path").agg(F.sum(F.log("n")).alias("_log_n"), F.count("*").alias("_texts"))
    # Whole branches: each node of the style tree adds its sums to all nodes above it, by pointers twice as long each round.
    sums = cut(nodes.join(own, ["host", "path"], "left").select("host", "path", F.coalesce("_log_n", F.lit(0.0)).alias("_log_n"), F.coalesce("_texts", F.lit(0)).alias("_texts"), "above"))
    while not sums.where("above <> 0").isEmpty():
        to_above = sums.where("above <> 0").select("host", F.col("above").alias("path"), F.col("_log_n").alias("_add_log"), F.col("_texts").alias("_add_texts"))
        added = to_above.groupBy("host", "path").agg(F.sum("_add_log").alias("_add_log"), F.sum("_add_texts").alias("_add_texts"))
        jump = sums.select("host", F.col("path").alias("above"), F.col("above").alias("_next"))
        sums = sums.join(jump, ["host", "above"], "left").join(added, ["host", "path"], "left")
        sums = cut(sums.select("host", "path", (F.col("_log_n") + F.coalesce("_add_log", F.lit(0.0))).alias("_log_n"), (F.col("_texts") + F.coalesce("_add_texts", F.lit(0))).alias("_texts"), F.coalesce("_next", F.lit(0)).alias("above")))
    got = nodes.drop("above").join(sums.drop("above"), ["host", "path"])
    log_m = F.log("_seen")
    presentation = F.when(F.col("_seen") > 1, (log_m - F.col("_nlogn") / F.col("_seen")) / log_m).otherwise(1.0)
    content = F.when(F.col("_seen") > 1, 1 - F.least(F.coalesce(F.try_divide("_log_n", "_texts"), F.lit(0.0)) / log_m, F.lit(1.0))).otherwise(1.0)
    fade = F.pow(F.lit(GAMMA), F.col("_styles"))
    return got.select("host", "path", F.col("_seen").alias("pages"), "is_named", ((1 - fade) * presentation + fade * content).alias("importance"))


def extract(pages: DataFrame, least: float = LEAST, named: float = NAMED, url_col: str = "url", html_col: str = "html", broadcast_nodes: int = 200_000) -> DataFrame:
    """`pages` without html, plus text and n_chars. `least` of -1 turns the tree off, `named` of -1 the names."""
    trees = parsed(pages, url_col, html_col)
    kept = trees.columns[: trees.columns.index("_host")]
    judged = F.col("pages") >= MIN_PAGES
    is_low = judged & (F.col("importance") < least)
    is_named = F.col("is_named") & (~judged | (F.col("importance") < named)) if named >= 0 else F.lit(False)
    low = cut(importance(trees).where(is_low | is_named).select("host", "path", is_low.alias("is_low")))
    by_host = low.groupBy(F.col("host").alias("_of")).agg(F.collect_list(F.when(F.col("is_low"), F.col("path"))).alias("_low"), F.collect_list(F.when(~F.col("is_low"), F.col("path"))).alias("_named"))
    if low.count() <= broadcast_nodes:
        by_host = F.broadcast(by_host)
    rows = trees.join(by_host, F.col("_host") == F.col("_of"), "left").select(*kept, "_host", "_low", "_named", "_parents", "_paths", "_flags", "_nodes", "_texts")
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, low_paths, names, *tree in zip(*[c.to_pylist() for c in batch.columns[n:]]):
                without_tree = None if not host and named >= 0 else frozenset(names or ())
                texts.append(main_text(*tree, frozenset(low_paths or ()), without_tree))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, with_fields(trees.select(*kept), text=StringType(), n_chars=LongType()))
