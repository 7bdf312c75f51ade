"""Substring dedup with sliding sentence spans.

A text is cut into sentences without losing a character.  Its words are maximal runs of anything
but ASCII white space; in scripts without blanks each letter is one.  A sentence ends behind a word
that ends in a full stop of any script, and a long one is cut further where its content says so:
behind words whose last letter and length give a multiple of CUT, and behind every UNIT-th word
since the last such place.  Equal passages are thus cut alike wherever they stand, but for the few
words in front of their first cut.

From every sentence on, the shortest run of sentences with ``words`` words is a span and is hashed
(letters of A-Z in lower case, white space as single blanks; 128 bits).  Spans are joined over the
corpus, and sentences covered by any span that is not the first of its kind are cut out.  Nothing
shorter than ``words`` words goes, and of a repeated passage of ``words`` + 3 (UNIT - 1) words that has
a cut among its first UNIT words some always goes.

Spans are built in numpy and joined by Spark.  First is the smallest doc_id (null before all), then
the text with the smaller hash where rows share an id, then the position.

Defined cases: null texts stay null, texts of fewer words than a span stay whole; very long texts are
cut into words a part at a time; of repeated passages in one document the first stays; rows equal in
both id and text are one document and stay alike; an empty table gives an empty one; columns whose
names clash with those added (n_sentences, n_removed) are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textblocks as tb
from quern.llm.spans import later_spans, order_key, row_of, text_check

SPAN_WORDS, UNIT, CUT = 30, 8, 5
STOPS = ".!?。．｡！？…।॥؟۔։።፧။៕"
#: Thai, Lao, Burmese, Khmer, Kana and Han: first and last code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_LETTER, _BLANK, _ALONE = 0, 1, 2
_BLOCK = 1 << 18


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(tb.SIZE, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    for lo, hi in UNSPACED:
        out[lo : hi + 1] = _ALONE
    return out


def words(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and folded hash of every word of an array of code points."""
    classes, begins, ends, hashes, at = _classes(), [], [], [], 0
    while at < len(arr):
        end = min(len(arr), at + _BLOCK)
        while end < len(arr) and classes[arr[end - 1]] == classes[arr[end]] == _LETTER:
            end += 1
        part = arr[at:end]
        kind = np.concatenate(([_BLANK], classes[part], [_BLANK]))
        seam = (kind[1:] != kind[:-1]) | (kind[1:] == _ALONE)
        b = np.flatnonzero(seam[:-1] & (kind[1:-1] != _BLANK))
        e = np.flatnonzero(seam[1:] & (kind[1:-1] != _BLANK)) + 1
        low = np.where((part >= 65) & (part <= 90), part + 32, part)
        begins.append(b + at)
        ends.append(e + at)
        hashes.append(tb.mix(tb.Hashes(low).of(b, e)))
        at = end
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes)


class Sentences:
    """The sentences of a block of texts."""

    def __init__(self, texts: list[str]):
        arr = tb.points("".join(t + "\n" for t in texts))
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(self.sizes + 1) - self.sizes - 1
        b, e, self.hashes = words(arr)
        doc = np.searchsorted(base, b, side="right") - 1
        last = arr[e - 1].astype(np.int64)
        cut = np.isin(last, [ord(c) for c in STOPS]) | ((31 * last + 17 * (e - b)) % CUT == 0)
        cut |= np.append(doc[1:] != doc[:-1], True)[: len(b)]
        at = np.arange(len(b))
        since = at - np.maximum.accumulate(np.where(np.concatenate(([True], cut[:-1]))[: len(b)], at, 0))
        cut |= since % UNIT == UNIT - 1
        self.end = np.flatnonzero(cut) + 1  # words, as all bounds but the last two
        self.begin = np.concatenate(([0], self.end[:-1]))[: len(self.end)]
        self.doc = doc[self.begin] if len(b) else np.zeros(0, np.int64)
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))[: len(self.doc)]
        # in code points of the text: the white space behind a sentence is part of it
        self.at = np.where(first, 0, b[self.begin] - base[self.doc]) if len(b) else np.zeros(0, np.int64)
        self.to = np.where(np.append(first[1:], True)[: len(first)], self.sizes[self.doc], np.append(self.at[1:], 0)[: len(self.at)])

    def reach(self, i: np.ndarray, least: int) -> np.ndarray:
        """The sentence with which each of ``i`` has ``least`` words, wherever texts end."""
        return np.searchsorted(self.end, self.begin[i] + least)

    def spans(self, least: int) -> tuple[np.ndarray, ...]:
        """(first sentence, hash, other hash, repeats an earlier one of its text)."""
        j = self.reach(np.arange(len(self.end)), least)
        i = np.flatnonzero(j < len(self.end))
        i = i[self.doc[j[i]] == self.doc[i]]
        j = j[i]
        a = tb.mix(tb.Hashes(self.hashes).of(self.begin[i], self.end[j]))
        b = tb.mix(tb.Hashes(tb.mix(self.hashes ^ np.uint64(0xD6E8FEB86659FD93))).of(self.begin[i], self.end[j]))
        order = np.lexsort((i, b, a, self.doc[i]))
        same = np.zeros(len(i), dtype=bool)
        one, two = order[1:], order[:-1]
        same[one] = (self.doc[i[one]] == self.doc[i[two]]) & (a[one] == a[two]) & (b[one] == b[two])
        return i, a, b, same


def spans_of(docs: DataFrame, least: int = SPAN_WORDS) -> DataFrame:
    """Rows (a, b, k, check, loc), one per span, of rows (k, check, text); loc is twice the code point at
    which the span begins, and one more if the text has an equal span before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "check"))
            for first, some in tb.blocks(texts, _BLOCK):
                s = Sentences(some)
                i, a, b, again = s.spans(least)
                row = s.doc[i] + first
                columns = (a.view(np.int64), b.view(np.int64), keys[row], checks[row], s.at[i] * 2 + again)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "k", "check", "loc"])

    return docs.select("k", "check", "text").mapInArrow(run, "a long, b long, k long, check long, loc long")


def dedup_spans(docs: DataFrame, words: int = SPAN_WORDS) -> DataFrame:
    """The documents, with ``text`` less its repeated spans, n_sentences and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    keyed = docs.select(row_of(kept).alias("row"), "text", order_key(F.col("doc_id")).alias("k"), text_check(F.col("text")).alias("check"))
    both = keyed.drop("text").join(later_spans(spans_of(keyed, words)), ["k", "check"], "left").select("row", "spans")
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("n_sentences", "long").add("n_removed", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            row, found = batch.column("row"), batch.column("spans").to_pylist()
            texts = row.field("text").to_pylist()
            whole, gone = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for first, some in tb.blocks([t or "" for t in texts], _BLOCK):
                s = Sentences(some)
                whole[first : first + len(some)] = np.bincount(s.doc, minlength=len(some))
                for d in (d for d in range(len(some)) if found[first + d]):
                    lo, hi = np.searchsorted(s.doc, (d, d + 1))
                    i = lo + np.searchsorted(s.at[lo:hi], found[first + d])
                    edge = np.bincount(i - lo, minlength=hi - lo + 1) - np.bincount(s.reach(i, words) + 1 - lo, minlength=hi - lo + 1)
                    covered = np.cumsum(edge)[: hi - lo] > 0
                    gone[first + d] = int(covered.sum())
                    texts[first + d] = "".join(some[d][x:y] for x, y in zip(s.at[lo:hi][~covered].tolist(), s.to[lo:hi][~covered].tolist(), strict=True))
            columns = [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole), pa.array(gone)], names=[*kept, "n_sentences", "n_removed"])

    return both.mapInArrow(cut, schema)
