"""HTML pages: a small tree, selectors, article extraction and links.

``articles``, ``extract`` and ``links`` parse each page once in a Python worker; links go on as columns.
Sites differ in rules (selectors, least length, whether any paragraph will do), not in code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed, plain as P, text as T, urls as U

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    up: Node | None = None

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                todo += reversed(n.children)
        return " ".join(out)

    def drop(self, tags: list[str]) -> None:
        for n in list(self.walk()):
            n.children = [c for c in n.children if isinstance(c, str) or c.tag not in tags]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, up=self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_STEP = re.compile(r"([a-z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:(\*?=)'?([^'\]]*)'?)?\]")


@lru_cache(1024)
def _parts(step: str) -> tuple[str, list[tuple[str, ...]]]:
    tag, rest = _STEP.fullmatch(step).groups()
    return tag, _PART.findall(rest)


def _fits(n: Node, step: str) -> bool:
    tag, parts = _parts(step)
    if tag and tag != "*" and n.tag != tag:
        return False
    for kind, name, attr, op, value in parts:
        if kind == "." and name not in n.attrs.get("class", "").split():
            return False
        if kind == "#" and n.attrs.get("id") != name:
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None or (op == "=" and have != value) or (op == "*=" and value not in have):
                return False
    return True


class Index:
    """The nodes of a page by tag, in page order, and the texts of nodes: worked out once for all selectors."""

    def __init__(self, root: Node):
        self.nodes = [n for n in root.walk() if n.tag]
        self.of: dict[str, list[Node]] = {}
        for n in self.nodes:
            self.of.setdefault(n.tag, []).append(n)
        self.texts: dict[int, str] = {}

    def text(self, n: Node) -> str:
        if id(n) not in self.texts:
            self.texts[id(n)] = " ".join(n.text().split())
        return self.texts[id(n)]

    def select(self, selector: str) -> list[Node]:
        tag = _STEP.fullmatch(selector.split()[-1]).group(1)
        return _matching(self.of.get(tag, []) if tag and tag != "*" else self.nodes, selector)


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in page order for a selector of descendant steps (tag, .class, #id, [a='v'], [a*='v']), or
    for several selectors between commas."""
    if "," in selector:
        wanted = {id(n) for one in selector.split(",") for n in select(root, one.strip())}
        return [n for n in root.walk() if id(n) in wanted]
    return _matching(root.walk(), selector)


def _matching(nodes, selector: str) -> list[Node]:
    steps = selector.split()
    out = []
    for n in nodes:
        if n.tag and _fits(n, steps[-1]):
            i, up = len(steps) - 2, n.up
            while i >= 0 and up is not None:
                i -= bool(up.tag) and _fits(up, steps[i])
                up = up.up
            if i < 0:
                out.append(n)
    return out


@dataclass(frozen=True)
class Rule:
    """How to take the text of pages whose host contains ``domain``, or one of several ('' is any).

    ``mode``: ``paragraphs`` filters and normalises blocks; ``block`` does so with the paragraphs in a
    selector's first node, or takes its whole text if it has none; ``joined`` normalises the blocks together;
    ``trimmed`` does that after cutting the title out of them; ``plain`` is the title and the blocks as they are."""

    domain: str | tuple[str, ...] = ""
    selectors: tuple[str, ...] = tuple(fixed.GENERIC_SELECTORS)
    least: int = 250
    any_paragraph: int | None = None  # least length of the page's paragraphs together, if they may serve
    title: tuple[str, ...] = ("h1", "meta[property='og:title']")
    mode: str = "paragraphs"
    #: blocks dropped beforehand, and containers of which the first on the page is searched (else all of it)
    drop: tuple[str, ...] = ()
    container: tuple[str, ...] = ()
    #: blocks go if shorter, if they hold one of the (lower-case) phrases, match a pattern or repeat the title
    least_block: int = 0
    unwanted: tuple[str, ...] = ()
    unwanted_pattern: str | None = None
    without_title: bool = False
    #: of the joined blocks, what stands behind the first pattern goes, and whatever the second one matches
    cut_behind: str | None = None
    without: str | None = None
    then_generic: bool = False
    skip_titles: tuple[str, ...] = ()

    def covers(self, url: str) -> bool:
        host = urlsplit(url).netloc.lower()
        return any(d in host for d in ((self.domain,) if isinstance(self.domain, str) else self.domain))

    def wanted(self, block: str, title: str) -> bool:
        low = block.lower()
        if len(block) < self.least_block or any(p in low for p in self.unwanted) or (self.without_title and low == title.lower()):
            return False
        return not (self.unwanted_pattern and re.search(self.unwanted_pattern, block))

    def blocks(self, page: Index, selector: str, title: str) -> list[str]:
        if self.mode == "block":
            first = next(iter(page.select(selector)), None)
            inner = [page.text(n) for n in select(first, "p")] if first else []
            return inner or ([page.text(first)] if first else [])
        found = page.select(selector) if "," not in selector else [n for n in page.nodes if any(_matching([n], x.strip()) for x in selector.split(","))]
        kept = [b for b in map(page.text, found) if self.wanted(b, title)]
        if self.mode == "paragraphs":
            return kept
        if self.mode == "plain":
            return list(dict.fromkeys([title, *kept] if title else kept))
        first: dict[str, str] = {}
        for b in kept:
            first.setdefault(b.lower(), b)
        kept = list(first.values())
        if self.cut_behind or self.without:
            whole = " ".join(kept)
            whole = re.split(self.cut_behind, whole, maxsplit=1)[0] if self.cut_behind else whole
            kept = [re.sub(self.without, " ", whole) if self.without else whole]
        return kept


GENERIC = Rule()
_CANDIDATE = pa.struct([("least", pa.int32()), ("mode", pa.string()), ("blocks", pa.list_(pa.string()))])


def candidates(url: str, html: str | None, rules: tuple[Rule, ...] = (GENERIC,)) -> tuple[str, Iterator[tuple[int, str, list[str]]]]:
    """A page's title and (least length, mode, texts of the blocks) of every selector of its rule, in the
    rule's order; the last may be all paragraphs.  A selector is looked for when its turn comes."""
    rule = next((r for r in rules if r.covers(url)), GENERIC)
    root = parse(html)
    heads = (h.attrs.get("content") or h.text() for s in rule.title for h in select(root, s)[:1])
    title = next((h for h in heads if h.strip() and h.strip().lower() not in rule.skip_titles), "")

    def found() -> Iterator[tuple[int, str, list[str]]]:
        root.drop(fixed.CHROME)
        for s in rule.drop:
            for n in select(root, s):
                n.up.children = [c for c in n.up.children if c is not n]
        page = Index(next((n for s in rule.container for n in select(root, s)), root))
        for r in (rule, GENERIC) if rule.then_generic else (rule,):
            page = page if r is rule else Index(root)
            for s in r.selectors:
                blocks = r.blocks(page, s, title)
                if blocks:
                    yield r.least, r.mode, blocks
                    if r.mode == "trimmed":  # the first selector that matches anything
                        break
            if r.any_paragraph:
                blocks = [page.text(n) for n in page.select("p")]
                if blocks:
                    yield r.any_paragraph, "paragraphs", blocks

    return title, found()


def extract(pages: DataFrame, rules: tuple[Rule, ...] = (GENERIC,)) -> DataFrame:
    """(page_id, url, title, candidates): the ``candidates`` of every page, all worked out."""

    def one(url: str, html: str | None) -> tuple[str, list[dict]]:
        title, found = candidates(url, html, rules)
        return title, [{"least": n, "mode": m, "blocks": b} for n, m, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(url or "", html) for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in done], pa.string()), pa.array([c for _, c in done], pa.list_(_CANDIDATE))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "title", "candidates"])

    schema = "page_id long, url string, title string, candidates array<struct<least:int,mode:string,blocks:array<string>>>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def page_title(title: Column) -> Column:
    """A page's or a link's title, normalised by columns alone."""
    return T.normalize_title(title, clean=lambda c: T.tidy(T.fix_encoding(c)))


def preview_title(title: Column, source: Column) -> Column:
    return T.normalize_title(title, source, clean=lambda c: T.tidy(T.fix_encoding(c)))


def cleaned(mode: str, blocks: list[str], head: str) -> str:
    """The text that blocks of a page give, by the mode of their rule; ``head`` is its title, normalised."""
    if mode == "plain":
        return P.tidy("\n".join(blocks))
    whole = lambda parts: P.cut_related(P.normalized_clean(" ".join(parts), head))
    tidied = [P.tidy(b) for b in blocks]
    if mode == "joined":
        return whole(tidied)
    if mode == "trimmed":
        rest = (P.remove_title_prefix(b, head) for b in tidied if not P.is_title_fragment(b, head))
        return whole(b for b in rest if len(b) >= 40)
    return whole(P.filter_paragraphs(tidied, head))


def articles(pages: DataFrame, rules: tuple[Rule, ...] = (GENERIC,), fallback: Column | None = None) -> DataFrame:
    """(page_id, url, title, text, text_source): the first candidate whose cleaned text reaches
    its least length, later ones are not worked out; else the feed's text (rss), else none.  A page is
    parsed, and its blocks are cleaned, in one worker."""

    def one(url: str, html: str | None) -> tuple[str, str | None]:
        title, found = candidates(url, html, rules)
        head = P.page_title(title)
        texts = ((n, cleaned(mode, blocks, head)) for n, mode, blocks in found)
        return head, next((t for n, t in texts if len(t) >= n), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(url or "", html) for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), *(pa.array([d[i] for d in done], pa.string()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "head", "first"])

    done = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, head string, first string")
    feed = F.coalesce(fallback if fallback is not None else F.lit(""), F.lit(""))
    text = F.coalesce("first", F.nullif(feed, F.lit("")), F.lit(""))
    source = F.when(F.col("first").isNotNull(), "html").when(feed != "", "rss").otherwise("none")
    return done.select("page_id", "url", F.col("head").alias("title"), text.alias("text"), source.alias("text_source"))


@dataclass(frozen=True)
class Section:
    """The part of a page below a heading that holds ``phrase``: the nearest of the ``climb`` blocks
    around it that has ``least`` links to the page's own site with paths like ``pattern``."""

    phrase: str
    pattern: str = r"/\d{4}/\d{2}/\d{2}/[^/]+/?"
    climb: int = 6
    least: int = 2

    def anchors(self, root: Node, url: str) -> list[Node]:
        head = next((h for h in root.walk() if h.tag in ("h1", "h2", "h3", "h4") and self.phrase in h.text()), None)
        at, found = head, []
        for _ in range(self.climb if head else 0):
            if at.up is None:
                break
            at = at.up
            found = [a for a in select(at, "a[href]") if self.fits(urljoin(url, a.attrs["href"]), url)]
            if len(found) >= self.least:
                break
        return found

    def fits(self, target: str, url: str) -> bool:
        host = lambda u: urlsplit(u).netloc.replace("www.", "").lower()
        return host(target) == host(url) and re.fullmatch(self.pattern, urlsplit(target).path) is not None


_SERVICE = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in fixed.LINK_SERVICE), re.IGNORECASE)


def link_title(a: Node) -> str:
    """A heading inside the link, else its title or text without service words, at most a sentence."""
    clean = lambda t: re.sub(r" +([,.!?;:])", r"\1", " ".join(t.split()))
    for s in fixed.LINK_HEADS:
        found = next((clean(n.text()) for n in select(a, s)), "")
        if len(found) >= 10:
            return found
    title = " ".join(_SERVICE.sub("", clean(a.attrs.get("title", "")) or clean(a.text())).split()).strip(" —-")
    return re.split(r"(?<=[.!?])\s+", title)[0].strip() if len(title) > 180 else title


def links(pages: DataFrame, section: Section | None = None) -> DataFrame:
    """A row per anchor: (page_id, page_url, pos, url, title, whole), URLs absolute, ``whole`` the anchor's
    text; with ``section`` only that part's."""
    names = ["page_id", "page_url", "pos", "url", "title", "whole"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                root = parse(html)
                for i, a in enumerate(section.anchors(root, url or "") if section else select(root, "a[href]")):
                    if a.attrs["href"]:
                        rows.append((page, url, i, urljoin(url or "", a.attrs["href"]), link_title(a), " ".join(a.text().split())))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, page_url string, pos int, url string, title string, whole string")


def previews(anchors: DataFrame, limit: int = 10, prefix: str | None = None, exclude: str | None = None, any_part: list[str] | None = None, all_parts: list[str] | None = None, least_title: int = 15, stop: list[str] = fixed.STOP_TITLES, whole: bool = False, articles_only: bool = False) -> DataFrame:
    """Link candidates of listing pages: same domain, the wanted paths, a real title; the first
    anchor of each URL that passes, and the first ``limit`` URLs of each page.  With ``whole`` a link's
    title is all of its text and its URL keeps the fragment; ``articles_only`` asks for URLs like articles'."""
    url = F.col("url") if whole else U.without_fragment(F.col("url"))
    df = anchors.withColumns({"url": url, "title": F.col("whole") if whole else F.col("title")}).where(U.domain(F.col("url")) == U.domain(F.col("page_url")))
    if prefix is not None:
        df = df.where(F.startswith(U.path(F.col("url")), F.lit(prefix.rstrip("/"))))
    if exclude is not None:
        df = df.where(U.path(F.col("url")) != exclude.rstrip("/"))
    if any_part is not None:
        df = df.where(T.contains_any(F.col("url"), any_part))
    for part in all_parts or []:
        df = df.where(F.contains(F.col("url"), F.lit(part)))
    if articles_only:
        df = df.where(U.is_probably_article(F.col("url")))
    df = df.where(F.length("title") >= least_title)
    df = df.where(~F.lower("title").isin(stop)) if stop else df
    once = df.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))).where("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= limit).select("page_id", "n", "url", "title")


def pages_of(primary: DataFrame, browser: DataFrame, browser_hosts: list[str] | None = None) -> DataFrame:
    """Pages (page_id, url, html) fetched plainly, or by a browser where that gave nothing; for the hosts
    that only a browser can read, its page always."""
    other = browser.select("page_id", F.coalesce("html", F.lit("")).alias("_html"))
    both = primary.join(other, "page_id", "left")
    plain, seen = F.nullif("html", F.lit("")), F.coalesce("_html", F.lit(""))
    always = T.contains_any(U.domain(F.col("url")), browser_hosts) if browser_hosts else F.lit(False)
    return both.withColumn("html", F.when(always, seen).otherwise(F.coalesce(plain, seen))).drop("_html")
