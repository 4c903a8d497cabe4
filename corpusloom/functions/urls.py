"""URL and page-title expressions, and hashes of content."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# Endings and substrings of URLs that are not followed, and what ends a title.
SKIPPED = [r"(?i)\.(jpg|jpeg|png|gif|bmp|svg|ico|css|js|pdf|zip|rar)$", "(?i)(login|register|search|tag|category|#)"]
TITLE_ENDS = [" - ", " | ", " _ ", "——"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def domain(url: Column) -> Column:
    """The network location: what stands between ``//`` and the path."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def normalize(url: Column) -> Column:
    """Without the fragment."""
    return F.regexp_replace(url, "(?s)#.*$", "")


def resolve(url: Column, base: Column) -> Column:
    """The absolute form of a link of page ``base``, without the fragment; null where it is no URL at all."""

    def run(links: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([_joined(a, b) for a, b in zip(links, bases, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(url, base)


def _joined(url: str | None, base: str | None) -> str | None:
    if url is None:
        return None
    try:
        return urljoin(base or "", url).partition("#")[0]
    except ValueError:
        return None


def is_valid(url: Column, base: Column | None = None, pattern: str | None = None) -> Column:
    out = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https")
    if base is not None:
        out = out & (domain(url) == domain(base))
    if pattern:
        out = out & url.rlike(pattern)
    for p in SKIPPED:
        out = out & ~url.rlike(p)
    return out


def unescape(text: Column) -> Column:
    for entity, by in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def title(html: Column) -> Column:
    """og:title, or the title element up to the first separator of each kind in turn."""
    og = F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    own = strip(unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))
    for end in TITLE_ENDS:
        own = strip(F.regexp_replace(own, f"(?s){re.escape(end)}.*$", ""))
    return F.when(og != "", strip(unescape(og))).otherwise(own)


def content_hash(text: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)
