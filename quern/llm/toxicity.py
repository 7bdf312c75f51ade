"""Toxicity by multiple-instance learning.

Labels belong to documents, the offence to sentences.  A sentence's probability is logistic in
its features (words in lower case, and their first four and five letters), a document's is the
noisy-or of its sentences: 1 - prod(1 - p).  Weights are trained on document labels by gradient
steps through the noisy-or; the sentences with p of a half or more are then the offending ones.

The training sample is bounded: about ``per_class`` documents of each label, chosen by a hash of
the id.  Tasks turn them into features and count these over the sample; every feature that is telling
enough is kept, and only where such features stand comes to the driver, never a text.
Scoring reads whole texts.

Defined cases: null, empty and letterless texts have sentences without known features and get
the bias alone, as every sentence does; without labels of both kinds, or without a telling feature, all scores are 0;
very long texts are read a part at a time, cut behind a sentence; equal texts, also in repeated rows, get equal
scores; a probability of exactly a half counts as offending, a score of exactly a half as toxic;
an empty table gives an empty one; a document with two labels counts as one of each; columns whose names clash with those added
(score, predicted, offending) are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quern.llm import textblocks as tb
from quern.llm.spans import row_of
from quern.llm.store import staged

#: Expected sample documents per label.
PER_CLASS = 2000
PREFIXES = (4, 5)
#: Sample documents that a feature is in at least, and its least log-likelihood ratio.
MIN_DOCS, TELLING = 3, 6.0
#: The log-odds of a sentence where nothing can be learned.
NEVER = -40.0
STEPS = 300
_BLOCK = 1 << 18
_ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float


def tokens(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of a block of texts: document and bounds (in its text) of each sentence; sentence of each
    word; hashes of each word's features, one row per kind, 0 where the word is too short."""
    low, alpha = tb.tables()
    arr = tb.points("".join(t + "\n" for t in texts))
    sym = low[arr]
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    end = np.flatnonzero(np.isin(arr, _ENDS)) + 1
    s_doc = np.searchsorted(begin, end - 1, side="right") - 1
    s_from = np.concatenate(([0], end[:-1]))
    letter = np.concatenate(([False], alpha[sym], [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    w0, w1 = edge[::2], edge[1::2]
    h = tb.Hashes(sym)
    kinds = [tb.mix(h.of(w0, w1))]
    for k in PREFIXES:
        cut = np.minimum(w0 + k, w1)
        kinds.append(np.where(w1 - w0 > k, tb.mix(h.of(w0, cut) ^ np.uint64(k * 0x1F123BB5)), np.uint64(0)))
    return s_doc, s_from - begin[s_doc], end - begin[s_doc], np.searchsorted(end, w0, side="right"), np.stack(kinds)


def parts(text: str, most: int = _BLOCK) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text, cut behind ends of sentences; ``tokens`` puts one behind each part."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in ".!?\n")
        if cut < 0:
            later = [k for k in (text.find(c, at + most) for c in ".!?\n") if k >= 0]
            if not later:
                break
            cut = min(later)
        yield at, text[at:cut]
        at = cut + 1
    yield at, text[at:]


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Texts in blocks of parts, with the text and the offset of each part."""
    cut = [(d, at, p) for d, t in enumerate(texts) for at, p in parts(t)]
    for first, some in tb.blocks([p for _, _, p in cut], _BLOCK):
        here = cut[first : first + len(some)]
        yield np.array([d for d, _, _ in here]), np.array([at for _, at, _ in here]), some


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class Sample:
    """Sentences as a matrix of features: entry k says that sentence ``sentence[k]`` has feature ``feature[k]``."""

    labels: np.ndarray  # of documents
    weight: np.ndarray  # how many documents of the corpus each one stands for
    document: np.ndarray  # of sentences
    sentence: np.ndarray
    feature: np.ndarray

    def slope(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Log loss of the noisy-or, and its derivatives by weights and bias."""
        z = b + np.bincount(self.sentence, weights=w[self.feature], minlength=len(self.document))
        a = np.bincount(self.document, weights=_softplus(z), minlength=len(self.labels))  # -log of no sentence offending
        miss = np.exp(-a)
        scale = self.weight / self.weight.sum()
        loss = np.where(self.labels == 1, -np.log(np.maximum(1 - miss, 1e-300)), a) @ scale
        by_a = np.where(self.labels == 1, -miss / np.maximum(1 - miss, 1e-9), 1.0) * scale
        by_z = by_a[self.document] / (1 + np.exp(-z))
        return float(loss), np.bincount(self.feature, weights=by_z[self.sentence], minlength=len(w)), float(by_z.sum())


def fit(keys: np.ndarray, sample: Sample, steps: int = STEPS) -> Model:
    """Gradient steps with momentum and a rate of its own for each weight."""
    w, b = np.zeros(len(keys)), -6.0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for step in range(1, steps + 1):
        _, gw, gb = sample.slope(w, b)
        gw += 2e-6 * w
        rate = 0.15 if step < steps * 2 // 3 else 0.03
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(keys, w, float(b))


def _entries(texts: list[str], keys: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Number of sentences of each text; text, sentence and feature of every distinct entry, of all
    features or of the sorted ``keys`` alone."""
    n = np.zeros(len(texts), np.int32)
    docs, sents, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for owner, _, some in blocks(texts):
        s_doc, _, _, w_sent, kinds = tokens(some)
        doc = owner[s_doc]
        new, size = np.unique(doc, return_counts=True)
        local = np.arange(len(doc)) - np.searchsorted(doc, doc) + n[doc]
        n[new] += size.astype(np.int32)
        for row in kinds:
            ok = np.flatnonzero(row if keys is None else keys[np.minimum(np.searchsorted(keys, row), len(keys) - 1)] == row)
            docs.append(doc[w_sent[ok]])
            sents.append(local[w_sent[ok]])
            found.append(row[ok])
    d, s, f = np.concatenate(docs), np.concatenate(sents), np.concatenate(found)
    order = np.lexsort((s, f, d))
    d, s, f = d[order], s[order], f[order]
    once = np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (s[1:] != s[:-1])))[: len(d)]
    return n, d[once], s[once], f[once]


def feature_counts(sample: DataFrame) -> DataFrame:
    """(f, n1, n) per task: documents of rows (toxic, text) that have a feature, toxic ones and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, n1, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in tb.slices(batches, 64):
            toxic = batch.column("toxic").to_numpy()
            _, d, _, g = _entries([t or "" for t in batch.column("text").to_pylist()])
            once = np.concatenate(([True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])))[: len(d)]
            keys, at = np.unique(np.concatenate((f, g[once])), return_inverse=True)
            n1 = np.bincount(at, weights=np.concatenate((n1, toxic[d[once]])), minlength=len(keys)).astype(np.int64)
            n = np.bincount(at, weights=np.concatenate((n, np.ones(int(once.sum())))), minlength=len(keys)).astype(np.int64)
            f = keys
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n1), pa.array(n)], names=["f", "n1", "n"])

    return sample.select("toxic", "text").mapInArrow(run, "f long, n1 long, n long")


def entries(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """Of rows (key, toxic, text) one row per document with its number of sentences ``n`` and, as lists, the
    sentences that have features among the sorted ``keys``, and the places of these there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, 64):
            n, d, s, f = _entries([t or "" for t in batch.column("text").to_pylist()], keys)
            ends = pa.array(np.searchsorted(d, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (s, np.searchsorted(keys, f))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(n), *lists], names=["key", "toxic", "n", "sents", "feats"])

    return sample.select("key", "toxic", "text").mapInArrow(run, "key long, toxic int, n int, sents array<int>, feats array<int>")


def telling(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Features (f) that more toxic documents have than others, by their log-likelihood ratio."""
    counts = counts.groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    r1, r0 = (F.col("n1") + 0.5) / (toxic + 1.0), (F.col("n") - F.col("n1") + 0.5) / (clean + 1.0)
    without = F.log(F.greatest(1 - r1, F.lit(1e-9)) / F.greatest(1 - r0, F.lit(1e-9)))
    tell = F.col("n1") * F.log(r1 / r0) + (toxic - F.col("n1")) * without
    return counts.where((F.col("n") >= MIN_DOCS) & (r1 > r0) & (tell > TELLING)).select("f")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic) with toxic 0 or 1.

    The sample is drawn from the labels alone: about 2 x ``per_class`` of them whatever the corpus,
    by a hash of the id.  So few rows are broadcast to the documents, and no text moves: one pass counts
    features, another finds where those stand that tell the labels apart."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), NEVER)
    labels = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return empty
    limit = {k: min(1.0, per_class / n) for k, n in counts.items()}
    drawn = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])
    chosen = staged(labels.where(drawn), "chosen")
    size = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.select(F.xxhash64("doc_id", "text", "toxic").alias("key"), "toxic", "text")
    keys = np.sort(telling(feature_counts(sample), size.get(1, 0), size.get(0, 0)).toArrow()["f"].to_numpy().view(np.uint64))
    if not len(keys):
        return empty
    rows = entries(sample, keys).toArrow().sort_by("key")
    first = np.concatenate(([True], np.diff(rows["key"].to_numpy()) != 0))[: len(rows)]  # repeated rows count once
    rows = rows.filter(pa.array(first))
    label, n = rows["toxic"].to_numpy().astype(np.float64), rows["n"].to_numpy().astype(np.int64)
    if not 0 < label.sum() < len(label):
        return empty
    held = np.array([len(x) for x in rows["sents"]])
    sentence = rows["sents"].combine_chunks().flatten().to_numpy() + np.repeat(np.cumsum(n) - n, held)
    feature = rows["feats"].combine_chunks().flatten().to_numpy()
    return fit(keys, Sample(label, np.where(label == 1, 1 / limit[1], 1 / limit[0]), np.repeat(np.arange(len(n)), n), sentence, feature))


def sentence_scores(texts: list[str], model: Model) -> tuple[np.ndarray, ...]:
    """Document, bounds and log-odds of every sentence."""
    s_doc, s_from, s_to, w_sent, kinds = tokens(texts)
    z = np.full(len(s_doc), model.bias)
    if len(model.keys):
        for row in kinds:
            at = np.minimum(np.searchsorted(model.keys, row), len(model.keys) - 1)
            hit = np.flatnonzero(model.keys[at] == row)
            # a feature counts once in a sentence, as in training
            once = np.unique(w_sent[hit].astype(np.int64) * len(model.keys) + at[hit])
            z += np.bincount(once // len(model.keys), weights=model.weights[once % len(model.keys)], minlength=len(z))
    return s_doc, s_from, s_to, z


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """All columns (``text`` only if asked for), with score, predicted and ``offending``: the bounds (code points)
    and probabilities of the sentences that offend."""
    kept = [c for c in docs.columns if c not in ("score", "predicted", "offending") and (keep_text or c != "text")]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("score", "double").add("predicted", "integer")
    schema = schema.add("offending", _parse_datatype_string("array<struct<begin:int,end:int,p:double>>"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, where = np.zeros(len(texts)), [[] for _ in texts]
            for owner, offset, some in blocks(texts):
                s_doc, s_from, s_to, z = sentence_scores(some, model)
                scores += np.bincount(owner[s_doc], weights=_softplus(z), minlength=len(texts))
                for i in np.flatnonzero(z >= 0):
                    d, at = owner[s_doc[i]], offset[s_doc[i]]
                    where[d].append({"begin": int(s_from[i] + at), "end": int(min(s_to[i] + at, len(texts[d]))), "p": float(1 / (1 + np.exp(-z[i])))})
            scores = np.round(np.clip(-np.expm1(-scores), 0.0, 1.0), 9)
            columns = [batch.column("row").field(c) for c in kept] + [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(where, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted", "offending"])

    return docs.select(row_of(kept).alias("row"), "text").mapInArrow(predict, schema)
