"""TF-IDF in SQL and extractive summaries by ranking sentences in a graph."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed, plain
from quern.functions import text as T
from quern.operators import terms as W
from quern.plans.shared import staged


def tfidf(rows: DataFrame, group: str, unit: str, max_df: float = 0.95) -> DataFrame:
    """(group, unit, term, weight): uni- and bigrams of word tokens of two characters or more, terms
    of more than ``max_df`` of the group's units left out, smoothed idf, unit length per unit.

    Counts are written once, as two steps read them.  Terms that most units share meet their idf in a
    join whose other side is a table with one row per term, so Spark can split them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    terms = F.transform(F.array(words), lambda w: F.concat(w, pairs(w)))[0]
    tf = rows.select(group, unit, F.explode_outer(terms).alias("term")).where("term is not null").groupBy(group, unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = staged(tf, "counts")
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df")).join(n, group).where(F.col("df") <= F.col("n") * max_df)
    idf = df.select(group, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(staged(idf, "idf"), [group, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, unit)))
    return raw.select(group, unit, "term", (F.col("w") / size).alias("weight"))


def top_terms(weights: DataFrame, group: str, unit: str, k: int) -> DataFrame:
    w = Window.partitionBy(group, unit).orderBy(F.round("weight", 9).desc(), "term")
    return weights.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def top_tfidf(rows: DataFrame, group: str, unit: str, k: int, max_df: float = 0.95) -> DataFrame:
    """``top_terms`` of the texts' ``tfidf``, without making all of its rows."""
    return W.top_weighted(rows, group, unit, k, max_df)


def similar_units(weights: DataFrame, group: str, unit: str, least: float = 0.0) -> DataFrame:
    """(group, a, b, cosine) of units of a group that share a term."""
    a, b = weights.alias("a"), weights.alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.term") == F.col("b.term")) & (F.col(f"a.{unit}") < F.col(f"b.{unit}"))
    out = a.join(b, same).groupBy(F.col(f"a.{group}").alias(group), F.col(f"a.{unit}").alias("a"), F.col(f"b.{unit}").alias("b")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("cosine"))
    return out.where(F.col("cosine") >= least)


def similar_texts(rows: DataFrame, group: str, unit: str, max_df: float = 0.95, least: float = 0.0, most_units: int = W.MOST_UNITS, most_chars: int = W.MOST_CHARS) -> DataFrame:
    """``similar_units`` of the texts' ``tfidf``.  Groups of up to ``most_units`` texts and ``most_chars``
    characters meet in one task each, so no row per term is written; larger ones are joined by term."""
    rows = rows.select(group, unit, "text").where(F.col(group).isNotNull())
    large = W.large_groups(rows, group, most_units, most_chars)
    if large.isEmpty():
        out = W.similar_in_small(rows, group, unit, max_df)
    else:
        out = W.similar_in_small(rows.join(large, group, "left_anti"), group, unit, max_df)
        out = out.unionByName(similar_units(tfidf(rows.join(large, group, "left_semi"), group, unit, max_df), group, unit))
    return out.where((F.col("cosine") >= least) & F.col("a").isNotNull() & F.col("b").isNotNull())


def summary_sentences(text: Column, least: int = 45, most: int = 420) -> Column:
    """Sentences fit for a summary; abbreviations and initials don't end one."""
    t = T.squeezed(text)
    for a in fixed.ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", "\x01")))
    t = F.regexp_replace(t, r"(?<![A-Za-zА-Яа-яЁё])([A-Za-zА-Яа-яЁё])(\s*)\.", "$1$2\x01")
    parts = F.transform(T.split_sentences(t), lambda s: T.squeezed(F.replace(s, F.lit("\x01"), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s).between(least, most) & ~T.contains_any(F.lower(s), fixed.BAD_SUMMARY))


# The same rules for single sentences, for use inside the ranking worker.


def key(s: str) -> str:
    raw = s.lower().replace("ё", "е").encode("cp1251", "ignore").translate(None, _NOT_KEY)
    return b" ".join(raw.split()).decode("cp1251")


_CYRILLIC = re.compile("[а-яё]")
_BAD_STARTS, _PRONOUNS = tuple(fixed.BAD_STARTS), tuple(fixed.PRONOUNS)
#: Bytes of cp1251, which holds all characters of keys, that go.
_KEY = "абвгдежзийклмнопрстуфхцчшщъыьэюяabcdefghijklmnopqrstuvwxyz0123456789 ".encode("cp1251")
_NOT_KEY = bytes(b for b in range(256) if b not in _KEY)
_DIGIT = re.compile(r"\d")


class Sentence:
    """A sentence with what its tests need, worked out once."""

    def __init__(self, text: str, known: str | None = None):
        self.text, self.low, self.key = text, text.lower(), key(text) if known is None else known
        #: All needles are Cyrillic, so a sentence without such letters holds none.
        self.cyrillic = not self.low.isascii() and _CYRILLIC.search(self.low) is not None
        self.starts_badly = self.cyrillic and self.key.startswith(_BAD_STARTS)
        self.bad = self.cyrillic and (self.starts_badly or any(p in self.low for p in fixed.BAD_CONTEXT) or self.key.startswith(_PRONOUNS))

    @cached_property
    def words(self) -> set[str]:
        return {w for w in self.key.split() if len(w) > 2 and w not in fixed.STOP_WORDS}

    @property
    def bonus(self) -> float:
        low, s = self.low, self.text
        if not self.cyrillic:
            return 0.04 if _DIGIT.search(s) else 0
        said = [(0.08, any(w in low for w in fixed.FACT_WORDS)), (0.04, re.search(r"\d", s)), (0.03, re.search("[А-ЯЁ][а-яё]+", s)), (-0.10, self.starts_badly), (-0.03, "сообщил" in low), (-0.04, "по словам" in low)]
        return sum(v for v, true in said if true)

    def like(self, other: Sentence) -> bool:
        """Keys that contain one another, or mostly the same words."""
        if not self.key or not other.key:
            return False
        if self.key in other.key or other.key in self.key:
            return True
        a, b = self.words, other.words
        if not a or not b:
            return False
        both = a & b
        share = len(both) / min(len(a), len(b))
        return len(both) / len(a | b) >= 0.55 or share >= 0.7 or (share >= 0.55 and sum(len(w) >= 6 for w in both) >= 5)


def too_similar(a: str, b: str) -> bool:
    return Sentence(a).like(Sentence(b))


@dataclass
class Weights:
    """TF-IDF rows of unit length: entry k has row[k], term[k] and value[k]."""

    n: int
    row: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def similar(self, x: np.ndarray) -> np.ndarray:
        """The matrix of cosines times ``x``, without making it: by terms and back by rows."""
        by_term = np.bincount(self.term, weights=self.value * x[self.row])
        return np.bincount(self.row, weights=self.value * by_term[self.term], minlength=self.n)


_TERM = re.compile(r"\b\w\w+\b")


def weights(sentences: list[str], max_df: float = 0.95) -> Weights | None:
    """TF-IDF of words and pairs of words; None when every term was left out."""
    said: list[str] = []
    sizes = []
    for s in sentences:
        w = _TERM.findall(s.lower())
        said += w
        said += map(" ".join, zip(w, w[1:], strict=False))
        sizes.append(max(0, 2 * len(w) - 1))
    terms = {t: i for i, t in enumerate(dict.fromkeys(said))}
    n, m = len(sentences), len(terms)
    if not m:
        return None
    ids = np.fromiter(map(terms.__getitem__, said), np.int64, len(said))
    pair, count = np.unique(np.repeat(np.arange(n), sizes) * m + ids, return_counts=True)
    row, term = pair // m, pair % m
    df = np.bincount(term, minlength=m)
    kept = df[term] <= max_df * n
    if not kept.any():
        return None
    row, term, value = row[kept], term[kept], count[kept] * (np.log((1 + n) / (1 + df[term[kept]])) + 1)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    return Weights(n, row, term, value / norm[row])


def pagerank(w: Weights, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    n, total = w.n, w.similar(np.ones(w.n))
    alone = total <= 0
    some = alone.any()
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        if not some:
            new = damping * w.similar(x / total) + (1 - damping) / n
            if np.abs(new - x).sum() < n * tol:
                return new
            x = new
            continue
        share = np.divide(x, total, out=np.zeros(n), where=~alone)
        new = damping * (w.similar(share) + x[alone].sum() / n) + (1 - damping) / n
        if np.abs(new - x).sum() < n * tol:
            return new
        x = new
    return x


def fitted(sentences: list[str], most: int) -> str:
    while len(sentences) > 1 and len(" ".join(sentences)) > most:
        sentences = sentences[:-1]
    return sentences[0] if len(sentences) == 1 else " ".join(sentences)


def limited(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    out: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(" ".join([*out, s])) > most:
            break
        out.append(s)
    return " ".join(out).strip() if out else text[:most].strip() + "..."


def summarize(sentences: list[str], title: str | None = None, count: int = 4, most: int = 800) -> str:
    """The summary of a text's sentences (see ``summary_sentences``)."""
    found = [(key(s), s) for s in sentences]
    if title:
        head, kept = key(title), []
        for k, s in found:
            if k != head:
                if k.startswith(head):
                    s = s[len(title) :].strip()
                    k = key(s)
                if len(s) >= 45:
                    kept.append((k, s))
        found = kept
    first: dict[str, str] = {}
    for k, s in found:
        first.setdefault(k, s)
    held = [Sentence(s, k) for k, s in first.items()]
    if not held:
        return ""
    held = [s for s in held if not s.bad] or held
    if len(held) == 1:
        return limited(held[0].text, most)
    w = weights([s.text for s in held])
    rank = pagerank(w) if w is not None else np.full(len(held), 1 / len(held))
    scored = sorted(((rank[i] + s.bonus + (0.10 if i == 0 else 0.0), i, s.text) for i, s in enumerate(held)), reverse=True)
    chosen: list[int] = []
    lead = next((i for i, s in enumerate(held[:4]) if not s.starts_badly), None)
    if lead is not None and not held[lead].bad:
        chosen.append(lead)
    for i in [i for _, i, _ in scored] + list(range(len(held))):
        if len(chosen) >= count:
            break
        if not held[i].bad and not any(held[i].like(held[j]) for j in chosen):
            chosen.append(i)
    return fitted([held[i].text for i in sorted(chosen or [scored[0][1]])], most)


def summaries(rows: DataFrame, id_: str, count: int = 4, most: int = 800) -> DataFrame:
    """(id, summary) for rows (id, title, sentences); a text without sentences gives ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [summarize(list(s or []), t, count, most) for t, s in zip(batch.column("title").to_pylist(), batch.column("sentences").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(out, pa.string())], names=[id_, "summary"])

    return rows.select(id_, "title", "sentences").mapInArrow(run, rows.select(id_).schema.add("summary", "string"))


def text_summaries(rows: DataFrame, id_: str, count: int = 4, most: int = 800) -> DataFrame:
    """``summaries`` of rows (id, title, text): texts are normalised and cut into sentences where they are ranked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [summarize(plain.summary_sentences(plain.normalize_article_text(t)), h, count, most) for h, t in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(out, pa.string())], names=[id_, "summary"])

    return rows.select(id_, "title", "text").mapInArrow(run, rows.select(id_).schema.add("summary", "string"))
