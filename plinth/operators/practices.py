"""Practices and rosters from page snapshots: structs read from declared sources with fallbacks, and a refresh by platform."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import keys, text


@dataclass(frozen=True)
class Platform:
    """How a platform's pages say things: what differs between sites is data, not code.

    `marker` stands before a JSON object with the page's data, `provider_path` is a pattern of links to providers,
    `defaults` fill fields that no source has (a platform of one state, say).
    """

    name: str
    marker: str | None = None
    provider_path: str | None = None
    json_fields: tuple[tuple[str, str], ...] = (
        ("name", "$.name"), ("address", "$.address.streetAddress"), ("city", "$.address.addressLocality"), ("state", "$.address.addressRegion"), ("phone", "$.telephone"),
    )
    defaults: tuple[tuple[str, str], ...] = ()


FIELDS = ("name", "city", "state", "address", "phone")


def practice(html: Column, url: Column, platform: Platform) -> Column:
    """struct(name, city, state, address, phone, url, provider_urls) of a page.

    Each field is the first that is not blank of: the page's linked data (JSON-LD), the platform's marker object, meta
    tags, the title or heading and the visible address, and the platform's default. Phones are shown in one form.
    """
    linked = F.regexp_extract(html, r'(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>', 1)
    objects = [linked] + ([text.balanced_segment(html, platform.marker)] if platform.marker else [])
    seen = text.strip_tags(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "))
    paths, defaults = dict(platform.json_fields), dict(platform.defaults)
    meta = {"name": ["og:site_name", "og:title"], "city": ["og:locality", "geo.placename"], "state": ["og:region"], "address": ["og:street-address"], "phone": ["og:phone_number"]}
    last = {
        "name": [text.page_heading(html), text.page_title(html)],
        "city": [text.city_in(seen)],
        "state": [text.state_in(seen)],
        "phone": [F.nullif(F.regexp_extract(seen, r"(\(?\d{3}\)?[ .\-]?\d{3}[ .\-]\d{4})", 1), F.lit(""))],
    }

    def field(f: str) -> Column:
        options = [F.get_json_object(o, paths[f]) for o in objects if f in paths] + [text.meta_content(html, m) for m in meta[f]] + last.get(f, [])
        found = keys.first_usable([*options, F.lit(defaults.get(f)).cast("string")])
        return keys.phone_display(found) if f == "phone" else F.btrim(found)

    urls = text.links(html)
    urls = F.filter(urls, lambda u: u.rlike(platform.provider_path)) if platform.provider_path else F.array().cast("array<string>")
    return F.struct(*[field(f).alias(f) for f in FIELDS], url.alias("url"), urls.alias("provider_urls"))


def practices(pages: DataFrame, platforms: Sequence[Platform], platform_col: str = "platform", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """platform and the practice struct's fields of each page of a known platform; pages of others are left out."""
    out = None
    for p in platforms:
        part = pages.where(F.col(platform_col) == p.name).select(F.lit(p.name).alias("platform"), practice(F.col(html_col), F.col(url_col), p).alias("_p")).select("platform", "_p.*")
        out = part if out is None else out.unionByName(part)
    return out


def provider_links(found: DataFrame) -> DataFrame:
    """platform, practice_url, provider_url: one row for each provider that a practice's page links to."""
    return found.select("platform", F.col("url").alias("practice_url"), F.explode("provider_urls").alias("provider_url")).distinct()


def refresh_roster(old: DataFrame, rebuilt: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows of platforms that were not rebuilt, and the rebuilt rows of physicians, with ids found before.

    `old` and `rebuilt` have platform, provider_url, provider_name, credentials and state; `resolved` has provider_url,
    provider_name, state and npi. Only MD and DO are kept of rebuilt rows. An id is reused by the provider's URL, else by
    state and name, if these lead to one id; `id_via` says how it was found.
    """
    gone = rebuilt.select("platform").distinct()
    kept = old.join(gone, "platform", "left_anti").select("platform", "provider_url", "provider_name", "credentials", "state", F.lit("retained").alias("origin"))
    fresh = rebuilt.where(keys.credential_kind(F.col("credentials")) == "physician").select("platform", "provider_url", "provider_name", "credentials", "state", F.lit("rebuilt").alias("origin"))
    out = kept.unionByName(fresh)
    known = resolved.where(F.col("npi").isNotNull())
    by = {"url": [F.col("provider_url")], "name": [F.upper(F.btrim("state")), keys.first_last_key(F.col("provider_name"))]}
    for via, columns in by.items():
        on = [f"_{via}{i}" for i in range(len(columns))]
        one = known.select(*[c.alias(k) for k, c in zip(on, columns)], "npi").dropna().groupBy(*on).agg(F.count_distinct("npi").alias("_n"), F.min("npi").alias(f"_npi_{via}")).where("_n = 1").drop("_n")
        out = out.withColumns(dict(zip(on, columns))).join(one, on, "left").drop(*on)
    via = F.when(F.col("_npi_url").isNotNull(), "url").when(F.col("_npi_name").isNotNull(), "name")
    return out.select(*kept.columns, F.coalesce("_npi_url", "_npi_name").alias("npi"), via.alias("id_via"))
