"""Extraction from page text, JSON and labels."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape_html(c: Column) -> Column:
    """Character references; Spark has no function for the full table."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: html.unescape(x) if x is not None else None)

    return run(c)


def strip_tags(c: Column, unescape: bool = False) -> Column:
    """Text of a fragment: breaks become line ends, tags go, spaces collapse."""
    out = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = unescape_html(out) if unescape else out
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n ?", "\n"))


def tidy_address(c: Column) -> Column:
    """Line ends to commas, no doubled or hanging commas."""
    out = F.regexp_replace(c, r"\s*\n\s*", ", ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"(\s*,\s*)+", ", "), r"^, |, $", ""))


def page_title(c: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_heading(c: Column) -> Column:
    return F.nullif(strip_tags(F.regexp_extract(c, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def meta_content(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf'(?is)<meta[^>]+(?:name|property)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def slug_label(url: Column) -> Column:
    """Last path part as words."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.btrim(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[-_]+", " "))


def links(c: Column, least_depth: int = 1, stop: Sequence[str] = ()) -> Column:
    """Distinct hrefs in page order with at least `least_depth` path parts and no stop slug."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r'(?i)<a[^>]+href="([^"#?]+)'), F.lit(1)))
    parts = lambda u: F.filter(F.split(F.regexp_replace(u, r"^[a-z]+://[^/]*", ""), "/"), lambda p: p != "")
    keep = lambda u: (F.size(parts(u)) >= least_depth) & ~F.exists(parts(u), lambda p: p.isin(*stop) if stop else F.lit(False))
    return F.filter(found, keep)


#: Two-letter codes of the states.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


def state_in(c: Column) -> Column:
    """State code before a postal code, or at the end of an address."""
    return F.nullif(F.regexp_extract(c, rf"\b({'|'.join(STATES)})\b(?=,?\s*(?:\d{{5}}|$))", 1), F.lit(""))


def city_in(c: Column) -> Column:
    """Words before the state code, after the last comma or line end."""
    return F.nullif(F.btrim(F.regexp_extract(c, rf"([^,\n]+?),?\s+(?:{'|'.join(STATES)})\b,?\s*(?:\d{{5}}|$)", 1)), F.lit(""))


def locality(c: Column) -> Column:
    """struct(street, city, state, zip) from `<br>`-parted address lines."""
    lines = F.filter(F.split(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"\s*\n\s*"), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    pattern = r"^(.*?),?\s+([A-Z]{2})\s+(\d{5})"
    return F.struct(
        F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), ", ").alias("street"),
        F.nullif(F.regexp_extract(last, pattern, 1), F.lit("")).alias("city"),
        F.nullif(F.regexp_extract(last, pattern, 2), F.lit("")).alias("state"),
        F.nullif(F.regexp_extract(last, pattern, 3), F.lit("")).alias("zip"),
    )


def mentions(c: Column, pattern: str, after: int = 0) -> Column:
    """All matches of a pattern with up to `after` characters that follow."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)({pattern}.{{0,{after}}})"), F.lit(1))


def squash(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def scales(c: Column) -> Column:
    """map(label, scale) from `label [scale]` pieces."""
    pieces = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z _]*)\s*\[([^\]]*)\]"), F.lit(0))
    return F.map_from_entries(F.transform(pieces, lambda x: F.struct(squash(F.regexp_extract(x, r"^([^\[]*)", 1)).alias("label"), F.regexp_extract(x, r"\[([^\]]*)\]", 1).alias("scale"))))


def citation_keys(c: Column) -> Column:
    """Distinct keys after an at sign that no word character or at sign precedes."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\w@.])@([A-Za-z][\w:.-]*\w)"), F.lit(1)))


def choice_line(code: Column, label: Column) -> Column:
    return F.concat(code.cast("string"), F.lit(", "), label.cast("string"))


def parse_choice(c: Column) -> Column:
    """struct(code, id, name, city, state, phone) of `code, id: n, name, city, ST, Phone: x`; nulls where it doesn't fit."""
    pattern = r"^\s*(\d+), id: (\d+), (.*?), ([^,]*), ([A-Z]{2}), Phone:? ?(.*?)\s*$"
    names = ("code", "id", "name", "city", "state", "phone")
    return F.struct(*[F.nullif(F.regexp_extract(c, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def balanced_segment(c: Column, marker: str) -> Column:
    """The balanced {...} or [...] that follows a marker; brackets in strings don't count; null if there is none or it never closes.

    The rest of the text is cut into strings, brackets and other stretches; an aggregate follows the depth and keeps
    the length at which it comes back to zero.
    """
    at = F.instr(c, marker)
    rest = F.substring(c, at + len(marker), F.length(c))
    opening = F.regexp_instr(rest, F.lit(r"[\{\[]"), F.lit(0))
    body = F.substring(rest, opening, F.length(rest))
    parts = F.regexp_extract_all(body, F.lit(r'(?s)("(?:[^"\\]|\\.)*+"|".*|[\{\[]|[\}\]]|[^"\{\}\[\]]++)'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (s["length"] + F.length(x)).alias("length"), (depth == 0).alias("closed"))
        return F.when(s["closed"], s).otherwise(moved)

    found = F.aggregate(parts, start, step)
    return F.when((at > 0) & (opening > 0) & found["closed"], F.substring(body, F.lit(1), found["length"]))


def json_path(c: Column, path: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def geoid_in(c: Column, width: int = 11) -> Column:
    """First GEOID of the width in JSON text."""
    return F.nullif(F.regexp_extract(c, rf'"GEOID"\s*:\s*"(\d{{{width}}})"', 1), F.lit(""))


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def p_value(c: Column) -> Column:
    return F.when(c < 0.001, "<0.001").otherwise(F.format_string("%.3f", c.cast("double")))


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(fixed(c * 100, places), F.lit("%"))
