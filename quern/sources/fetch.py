"""Pages over HTTP, for callers that have a network; queries read stored pages."""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TIMEOUT = 40
_AGENT = {"User-Agent": "Mozilla/5.0"}
_CHARSET = re.compile(rb"charset=[\"']?([\w-]+)", re.I)


def decoded(body: bytes, named: str | None) -> str:
    """By the charset the server names, unless that is none or Latin-1; then by the page's own, by
    UTF-8 or by Windows-1251, whichever fits first."""
    inside = _CHARSET.search(body[:4096])
    tries = [] if (named or "latin-1").lower() in ("latin-1", "iso-8859-1") else [named]
    for name in [*tries, inside and inside[1].decode("ascii"), "utf-8", "cp1251"]:
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError, TypeError):
            continue
    return body.decode("utf-8", "replace")


def page(url: str | None, timeout: float = TIMEOUT) -> str:
    """The page's text; empty if it can't be had."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=_AGENT), timeout=timeout) as r:
            return decoded(r.read(), r.headers.get_content_charset())
    except (OSError, ValueError, AttributeError):
        return ""


def pages(urls: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """(page_id, url, html) out of (page_id, url), fetched by the workers.  Write the result before
    use: reading it twice fetches twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [page(u, timeout) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(html, pa.string())], names=["page_id", "url", "html"])

    return urls.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(run, "page_id long, url string, html string")
