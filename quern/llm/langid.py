"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is the product of its letters'
vectors, rotated by their place (binding); a text is the sum of its trigrams' vectors (bundling),
and a language's prototype the sum of its sample texts' unit vectors.  The language whose
prototype has the largest cosine with the text is predicted; that cosine, at least 0, is the score.

Letters are taken in lower case, and anything between letters is one blank, so that beginnings
and ends of words are in the trigrams.  The profile is a sum of integers and so exact.

Defined cases: null texts and texts without letters give ``und`` and 0.0; with no labelled text
all give ``und``; of equal cosines (to nine digits) the language that sorts first wins; equal texts, also in repeated
rows, get equal results; very long texts are bundled a part at a time and count whole; an empty table
gives an empty one; columns whose names clash with those added (lang_pred, score) are replaced, all
others but ``text`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textblocks as tb
from quern.llm.spans import row_of
from quern.llm.store import staged

DIMENSIONS = 1024
#: Expected number of sample texts of each language that the prototypes are learned from.
SAMPLE = 2000
UNKNOWN = "und"
_BLOCK, _COLUMNS = 1 << 19, 4096
#: Vectors kept between blocks; they can be made again at any time.
_HELD = 1 << 14
_LETTERS: dict[tuple[int, int], np.ndarray] = {}


def _letters(symbols: np.ndarray, dims: int) -> np.ndarray:
    if len(_LETTERS) > _HELD:
        _LETTERS.clear()
    for s in symbols.tolist():
        if (s, dims) not in _LETTERS:
            _LETTERS[s, dims] = np.random.default_rng((s, dims)).integers(0, 2, dims, dtype=np.int8) * 2 - 1
    return np.stack([_LETTERS[s, dims] for s in symbols.tolist()]) if len(symbols) else np.zeros((0, dims), np.int8)


def _sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, one blank before, between and behind words, the text of each
    of these symbols, and the number of letters of each text."""
    low, alpha = tb.tables()
    sym = low[tb.points("".join(f"\n{t}\n" for t in texts))]
    sizes = np.array([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = alpha[sym]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[np.cumsum(sizes) - sizes] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, sym, 32)[keep], doc[keep], n_letters


def profiles(texts: list[str], dims: int = DIMENSIONS, most: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and its number of letters; ``most`` trigrams at a time."""
    sym, doc, n_letters = _sequence(texts)
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for lo in range(0, len(sym) - 2, most):
        _bundle(sym[lo : lo + most + 2], doc[lo : lo + most + 2], out)
    return out, n_letters


def _bundle(sym: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the bound vectors of all trigrams that lie in one text."""
    dims = out.shape[1]
    present = np.unique(sym)
    place = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    place[present] = np.arange(len(present))
    s, n = place[sym], len(present)
    key, of = (s[:-2] * n + s[1:-1]) * n + s[2:], doc[2:]
    whole = doc[:-2] == of
    key, of = key[whole], of[whole]
    if n**3 <= 1 << 23:
        seen = np.zeros(n**3, dtype=bool)
        seen[key] = True
        grams = np.flatnonzero(seen)
        index = np.zeros(n**3, dtype=np.int32)
        index[grams] = np.arange(len(grams))
        gram = index[key]
    else:
        grams, gram = np.unique(key, return_inverse=True)
    base = _letters(present, dims)
    third, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for lo in range(0, len(grams), _COLUMNS):
        part = grams[lo : lo + _COLUMNS]
        bound = (third[part // (n * n)] * second[part // n % n] * base[part % n]).astype(np.float32)
        inside = (gram >= lo) & (gram < lo + _COLUMNS) if len(grams) > _COLUMNS else slice(None)
        d, g = of[inside], gram[inside] - lo
        for a in range(0, len(out), 1024):
            b = min(len(out), a + 1024)
            i, j = np.searchsorted(d, (a, b))
            if i < j:
                counts = np.bincount((d[i:j] - a).astype(np.int64) * len(part) + g[i:j], minlength=(b - a) * len(part))
                out[a:b] += counts.reshape(b - a, len(part)).astype(np.float32) @ bound


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v.astype(np.float64), axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros(v.shape, dtype=np.float64), where=size > 0)


def prototypes(labelled: DataFrame, per_language: int = SAMPLE, dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from rows (doc_id, text, lang) with non-null lang.

    About ``per_language`` texts of each language are used, chosen by a hash of id and text, so the
    sample is bounded by the number of languages whatever the corpus; partial sums of eight
    tasks come back, one row per language each."""
    labelled = labelled.select("doc_id", "text", "lang")
    # a row per language, as in the model that the driver holds in the end: small enough to broadcast
    counts = staged(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    drawn = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < per_language / F.col("n")
    sample = labelled.join(F.broadcast(counts), "lang").where(drawn).select("text", "lang").repartition(8)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in tb.slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at, some in tb.blocks(texts, _BLOCK):
                vectors = _unit(profiles(some, dims)[0])
                here = langs[at : at + len(some)]
                for lang in set(here):
                    sums[lang] = sums.get(lang, 0) + vectors[here == lang].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    total: dict[str, np.ndarray] = {}
    for row in sorted(sample.mapInArrow(part, "lang string, v array<double>").collect()):
        total[row["lang"]] = total.get(row["lang"], 0) + np.array(row["v"])
    names = sorted(total)
    return names, _unit(np.stack([total[x] for x in names])) if names else np.zeros((0, dims))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, held column pass-through ..., lang_pred, score) for rows with doc_id and text;
    all columns but ``text`` are kept."""
    names, vectors = model
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            preds, scores = [], []
            for _, some in tb.blocks(texts, _BLOCK):
                bundle, letters = profiles(some, vectors.shape[1] or DIMENSIONS)
                if names:
                    cosine = np.round(_unit(bundle) @ vectors.T, 9)
                    best = cosine.argmax(axis=1)
                    top = np.clip(cosine[np.arange(len(some)), best], 0.0, 1.0)
                else:
                    best, top, letters = np.zeros(len(some), int), np.zeros(len(some)), letters * 0
                preds += [names[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
                scores += [float(s) if n else 0.0 for s, n in zip(top, letters, strict=True)]
            columns = [batch.column("row").field(c) for c in kept] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return docs.select(row_of(kept).alias("row"), "text").mapInArrow(predict, schema)
