"""URLs: parts, joins and tests."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import fixed
from quern.functions.text import contains_any


def domain(url: Column) -> Column:
    host = F.lower(F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit("")))
    return F.when(host.contains("xn--"), _unicode(host)).otherwise(host)


@F.pandas_udf(StringType())
def _unicode(hosts: pd.Series) -> pd.Series:
    def one(h: str) -> str:
        try:
            return h.encode("ascii").decode("idna")
        except UnicodeError:
            return h

    return hosts.map(one)


def path(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("/"))


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


@F.pandas_udf(StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href, strict=True)])


def is_bad(url: Column, parts=fixed.BAD_LINK_URLS) -> Column:
    return contains_any(F.lower(url), parts)


def is_listing(url: Column, pages: list[str] = fixed.LISTING_PAGES) -> Column:
    return F.rtrim(F.lower(url), F.lit("/")).isin([p.lower().rstrip("/") for p in pages])


def is_probably_article(url: Column, listing: list[str] = fixed.LISTING_PAGES, parts=fixed.ARTICLE_URLS, bad=fixed.BAD_LINK_URLS) -> Column:
    return ~is_bad(url, bad) & ~is_listing(url, listing) & contains_any(F.lower(url), parts)
