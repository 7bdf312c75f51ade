"""Text normalisation as column expressions (inside the JVM but for HTML entities and tags)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import fixed

ALPHABET = "а-яёa-z0-9"
#: What ``(?U)\\s`` matches.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(n)) for n in needles])


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def fix_encoding(text: Column) -> Column:
    """Windows-1251 text that was read as Latin-1, when every character could come from that."""
    high = [i for i in range(0x80, 0x100) if i != 0x98]
    wrong, right = "".join(map(chr, high)), bytes(high).decode("cp1251")
    sure = lambda t: t.rlike(f"[{fixed.MOJIBAKE}]") & ~t.rlike(r"[^\x{00}-\x{FF}]|\x{98}")
    return let(_or_empty(text), lambda t: F.when(sure(t), F.translate(t, wrong, right)).otherwise(t))


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.held: list[str] = []

    def flush(self) -> None:
        joined = "".join(self.held).strip()
        if joined:
            self.parts.append(joined)
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()

    def handle_data(self, data):
        self.held.append(data)


def plain_text(markup: str | None) -> str:
    """Text nodes of a fragment of HTML, each trimmed, with blanks between."""
    p = _Plain()
    p.feed(markup or "")
    p.close()
    p.flush()
    return " ".join(p.parts)


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain_text)


def clean_text(text: Column) -> Column:
    fixed_ = fix_encoding(text)
    bare = F.when(fixed_.contains("<") | fixed_.contains("&"), _plain(fixed_)).otherwise(F.regexp_replace(fixed_, r"(?U)^\s+|\s+$", ""))
    for old, new in (("\xa0", " "), ("\u200b", ""), ("\ufeff", ""), ("…", "..."), ("« ", "«"), (" »", "»")):
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return tidy(bare)


def tidy(text: Column) -> Column:
    """Single blanks, none before punctuation, none at the ends."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r" +([,.!?;:])", "$1"))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def upper_ratio(text: Column) -> Column:
    upper = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    return let(F.regexp_replace(text, r"[^\p{L}]", ""), lambda x: F.when(F.length(x) > 0, upper(x) / F.length(x)))


def normalize_title(title: Column, source: Column | None = None, clean=clean_text) -> Column:
    t = clean(title)
    t = F.regexp_replace(F.regexp_replace(t, r"(?iu)^Заголовок:\s*", ""), r"^\d{2}\.\d{2}\.\d{4}\s*[-–—]\s*", "")
    t = F.regexp_replace(t, rf"(?iuU)\b({'|'.join(fixed.TITLE_SERVICE)})\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ —-]+|[ —-]+$", "")
    t = let(t, lambda x: F.when(F.length(x) > 180, squeezed(split_sentences(x)[0])).otherwise(x))
    if source is not None:
        marked = lambda x: source.isin(fixed.IMPORTANT_SOURCES) & F.startswith(x, F.lit("Важное "))
        t = let(t, lambda x: F.when(marked(x), squeezed(F.substring(x, 8, 1 << 30))).otherwise(x))
    shouted = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))
    return squeezed(let(t, lambda x: F.when(F.coalesce(upper_ratio(x), F.lit(0.0)) > 0.8, shouted(x)).otherwise(x)))


def remove_dateline(text: Column) -> Column:
    return squeezed(reduce(lambda t, p: F.regexp_replace(t, "(?iuU)" + p, ""), fixed.DATELINES, _or_empty(text)))


def cut_at(text: Column, phrases: Sequence[str]) -> Column:
    """The text before the earliest of the phrases, whatever their case."""

    def first(low: Column) -> Column:
        return F.least(*[F.nullif(F.locate(p.lower(), low), F.lit(0)) for p in phrases], F.lit(None).cast("int"))

    def cut(t: Column) -> Column:
        return let(let(F.lower(t), first), lambda n: F.when(n.isNotNull(), F.substr(t, F.lit(1), n - 1)).otherwise(t))

    return let(text, cut)


def remove_boilerplate(text: Column, phrases: Sequence[str] = fixed.STOP_PHRASES) -> Column:
    return squeezed(cut_at(_or_empty(text), phrases))


def cut_related(text: Column, phrases: Sequence[str] = fixed.RELATED_MARKERS) -> Column:
    return F.regexp_replace(cut_at(text, phrases), r"(?U)^\s+|\s+$", "")


def remove_contacts(text: Column) -> Column:
    return squeezed(reduce(lambda t, p: F.regexp_replace(t, f"(?{p[1]}uU)" + p[0], " "), fixed.CONTACTS, _or_empty(text)))


def remove_repeated_title(text: Column, title: Column | None = None) -> Column:
    """The text without a leading repeat of ``title``, which is normalised first."""
    return without_head(text, None if title is None else normalize_title(title))


def without_head(text: Column, head: Column | None = None) -> Column:
    """The text without a leading repeat of a title that is normalised already."""
    t = stripped(F.regexp_replace(_or_empty(text), r"(?iuU)^(Заголовок:\s*)+", ""))
    if head is None:
        return t

    def without(v: Column) -> Column:
        n = F.length(v["head"])
        again = (n > 0) & F.startswith(F.lower(v["t"]), F.lower(v["head"])) & F.rlike(F.substr(v["t"], n + 1, F.lit(1)), F.lit(r"(?U)\s"))
        return F.when(again, stripped(F.substr(v["t"], n + 1))).otherwise(v["t"])

    return let(F.struct(t.alias("t"), _or_empty(head).alias("head")), without)


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def key_of(text: Column) -> Column:
    """Lower case, anything but letters and digits one blank: texts with equal keys are the same."""
    return F.btrim(F.regexp_replace(F.lower(text), f"[^{ALPHABET}]+", " "))


def first_by_key(items: Column, key) -> Column:
    """The items with a key not seen before, in order: a map of keys to first places, by sorting."""
    pairs = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    again = lambda s: F.filter(s, lambda p, j: (j == 0) | (F.get(s, j - 1)["k"] != p["k"]))
    kept = F.transform(F.array(pairs), again)[0]
    ordered = F.sort_array(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"))))
    return F.transform(ordered, lambda p: p["x"])


def remove_duplicate_sentences(text: Column) -> Column:
    parts = F.transform(split_sentences(_or_empty(text)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(first_by_key(F.filter(parts, lambda s: F.length(s) >= 20), key_of), " ")


def normalize_article_text(text: Column, title: Column | None = None) -> Column:
    return normalized_clean(clean_text(text), None if title is None else normalize_title(title))


def normalized_clean(text: Column, head: Column | None = None) -> Column:
    """``normalize_article_text`` of a text without markup, with a normalised title; columns only, so that
    it also runs on the elements of arrays."""
    t = without_head(text, head)
    return tidy(remove_duplicate_sentences(remove_contacts(remove_dateline(remove_boilerplate(t)))))


def is_bad_paragraph(text: Column, phrases: Sequence[str] = fixed.BAD_PARAGRAPHS) -> Column:
    def bad(t: Column) -> Column:
        few = F.size(F.split(squeezed(t), " ")) < 5
        named = let(F.lower(t), lambda low: contains_any(low, phrases))
        return (F.length(t) < 35) | named | few | t.contains("@") | t.contains("www.") | (F.length(F.regexp_replace(t, r"[^|]", "")) >= 2)

    return let(_or_empty(text), bad)


def filter_paragraphs(paragraphs: Column, head: Column | None = None) -> Column:
    """Paragraphs without markup, normalised, less the bad ones and repeats."""
    clean = F.transform(paragraphs, lambda p: normalized_clean(p, head))
    return first_by_key(F.filter(clean, lambda p: ~is_bad_paragraph(p)), key_of)


def is_title_fragment(text: Column, title: Column) -> Column:
    bare = lambda c: squeezed(F.regexp_replace(F.lower(c), r"[«»\"'.,:;!?()\[\]—-]", " "))
    a, b = F.lower(text), F.lower(title)
    inside = lambda x, y: (x == y) | ((F.length(x) > 20) & F.contains(y, x)) | F.contains(x, y)
    return (F.length(text) > 0) & (F.length(title) > 0) & (inside(a, b) | inside(bare(a), bare(b)))


def remove_title_prefix(text: Column, title: Column) -> Column:
    """The text without a leading title: the whole of it, it without quotes, or its last ten to four
    words (of 20 characters or more)."""
    w = F.split(squeezed(title), " ")
    tails = [F.array_join(F.slice(w, F.size(w) - (k - 1), k), " ") for k in range(10, 3, -1)]
    tries = [title, F.regexp_replace(title, "[«»\"]", "")] + [F.when(F.size(w) >= k, t) for k, t in zip(range(10, 3, -1), tails, strict=True)]

    def cut(t: Column) -> Column:
        fits = lambda i, x: (F.length(x) > 0) & ((F.length(x) >= 20) | F.lit(i < 2)) & F.startswith(F.lower(t), F.lower(x))
        rest = [F.when(fits(i, x), F.regexp_replace(F.substr(t, F.length(x) + 1), r"(?U)^[\s.,:;—–-]+", "")) for i, x in enumerate(tries)]
        return F.coalesce(*rest, t)

    return let(_or_empty(text), cut)


def sentence_key(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^а-яa-z0-9 ]", ""))


def starts_badly(sentence: Column, starts: Sequence[str] = fixed.BAD_STARTS) -> Column:
    return let(sentence_key(sentence), lambda k: _any([F.startswith(k, F.lit(s)) for s in starts]))


def is_bad_summary_sentence(sentence: Column) -> Column:
    return starts_badly(sentence, fixed.BAD_STARTS + fixed.PRONOUNS) | let(F.lower(sentence), lambda low: contains_any(low, fixed.BAD_CONTEXT))


def sentence_words(sentence: Column) -> Column:
    return F.array_distinct(F.filter(F.split(sentence_key(sentence), " "), lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOP_WORDS)))


def too_similar(a: Column, b: Column) -> Column:
    """Sentences of equal or contained keys, or of mostly the same words."""

    def compared(v: Column) -> Column:
        ka, kb, wa, wb, both = (v[c] for c in ("ka", "kb", "wa", "wb", "both"))
        share = F.size(both) / F.least(F.size(wa), F.size(wb))
        long_ = F.size(F.filter(both, lambda w: F.length(w) >= 6)) >= 5
        alike = (F.size(both) / F.size(F.array_union(wa, wb)) >= 0.55) | (share >= 0.7) | (long_ & (share >= 0.55))
        words = F.when((F.size(wa) > 0) & (F.size(wb) > 0), alike).otherwise(False)
        return (ka != "") & (kb != "") & (F.contains(kb, ka) | F.contains(ka, kb) | words)

    parts = F.struct(sentence_key(a).alias("ka"), sentence_key(b).alias("kb"), sentence_words(a).alias("wa"), sentence_words(b).alias("wb"), F.array_intersect(sentence_words(a), sentence_words(b)).alias("both"))
    return let(parts, compared)


def cut_text(text: Column, most: int) -> Column:
    return cut_squeezed(squeezed(_or_empty(text)), most)


def cut_squeezed(text: Column, most: int) -> Column:
    """``cut_text`` of a text with single blanks."""
    return F.btrim(F.substring(text, 1, most))


def normalize_filter_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(F.lower(_or_empty(text)), F.lit("ё"), F.lit("е")), r"[^а-яa-z0-9\-.]+", " "), F.lit(" "))


def lemmatized(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Normalised text with tokens replaced by their lemmas; without a table of them, as it is."""
    t = normalize_filter_text(text)
    if not lemmas:
        return t
    table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def prepared_markers(markers: Sequence[str], lemmas: dict[str, str] | None = None) -> list[str]:
    """Markers treated like the texts they are looked for in (``lemmatized``), distinct, longest
    first; blank ones go."""
    out = set()
    for m in markers:
        words = re.sub(r"[^а-яa-z0-9\-. ]", " ", m.lower().replace("ё", "е")).split()
        out.add(" ".join((lemmas or {}).get(w, w) for w in words))
    return sorted(out - {""}, key=lambda m: (-len(m), m))


def marker_matches(text: Column, markers: Sequence[str], lemmas: dict[str, str] | None = None) -> Column:
    """The markers, prepared, that the lemmatised text contains, longest first."""
    ready = F.array(*map(F.lit, prepared_markers(markers, lemmas))).cast("array<string>")
    return let(text, lambda t: F.filter(ready, lambda m: F.contains(t, m)))


def contains_marker(text: Column, markers: Sequence[str], lemmas: dict[str, str] | None = None) -> Column:
    return let(text, lambda t: contains_any(t, prepared_markers(markers, lemmas)))


def is_foreign_title(title: Column, foreign: Sequence[str], home: Sequence[str], lemmas: dict[str, str] | None = None) -> Column:
    """The title names another country and not the home one."""
    t = lemmatized(title, lemmas)
    return contains_marker(t, foreign, lemmas) & ~contains_marker(t, home, lemmas)


def normalize_for_keywords(text: Column) -> Column:
    """Like ``normalize_filter_text``, without dots."""
    return squeezed(F.translate(normalize_filter_text(text), ".", " "))


def hashtags(tags: Column) -> Column:
    parts = F.filter(F.transform(F.split(_or_empty(tags), ","), lambda t: F.btrim(t)), lambda t: t != "")
    return F.array_join(F.transform(parts, lambda t: F.concat(F.lit("#"), F.translate(t, " -", "__"))), " ")


def rss_datetime(text: Column) -> Column:
    """RFC 2822 dates with a numeric zone or GMT; anything else is null."""
    t = F.regexp_replace(squeezed(_or_empty(text)), r"^\w{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss z")))
