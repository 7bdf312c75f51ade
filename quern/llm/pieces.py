"""SentencePiece encoding and decoding in batches of numpy arrays.

A text, with blanks as U+2581 and one in front, is cut wherever two neighbouring characters stand
next to each other in no piece; no token can span such a cut.  Equal segments of a batch are
encoded once, and segments of equal length advance together: for every end position and piece
length the substring's hash is looked up among the sorted piece hashes, and the best way to reach
the position is kept with a backpointer.

For unigram models the best way has the largest sum of scores.  For BPE models, scores are merge
ranks and the largest sum is not what the model's merges give; there a way counts only if its last
two tokens are what the merges make of their joint text.  Exactly one way per position passes, and
it is the merges' own result (checked against the library in the tests).  Characters in no piece
become byte tokens, or the unknown token where the model has none.

Segments with two or more U+2581 in a row, whose merges tie in rank, are merged one by one.

Defined cases: null and empty texts give no tokens; decoding gives U+2581 back as a blank; very long texts are
cut into parts that no token spans; of equal ways the model's own order decides; repeated rows get equal
tokens; an empty table gives an empty one; columns whose names clash with those added (ids, decoded) are
replaced, all others but ``text`` are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quern.llm import textblocks as tb
from quern.llm.spans import row_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Code points of a block, and of the blocks that are encoded together; segments kept.
_BLOCK, _TOGETHER, _CACHE = 1 << 18, 1 << 21, 1 << 19
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """A model file's pieces, in the arrays that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces, scores, kinds, self.kind = [], [], [], UNIGRAM
        self.dummy_prefix = True
        for no, value in _fields(raw):
            if no == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode("utf-8"))
                scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif no == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif no == 3:
                f = dict(_fields(value))
                self.dummy_prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models without a character map that keep white space are supported")
        self.kinds = np.array(kinds)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        usable = [i for i in range(len(self.pieces)) if kinds[i] == NORMAL]
        self.id_of = {self.pieces[i]: i for i in usable}
        self.score_of = {self.pieces[i]: scores[i] for i in usable}
        points = [tb.points(self.pieces[i]) for i in usable]
        self.longest = max(map(len, points))
        pairs = [p[:-1].astype(np.uint64) << np.uint64(32) | p[1:] for p in points if len(p) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.known = np.unique(np.concatenate(points))
        hashes = np.array([tb.Hashes(p).of(np.array([0]), np.array([len(p)]))[0] for p in points], dtype=np.uint64)
        # rank: single characters come first, then merges in the order in which they are made
        single = np.array([len(p) == 1 for p in points])
        value = np.array([scores[i] for i in usable])
        order = np.lexsort((np.arange(len(usable)), -value, ~single))
        rank = np.empty(len(usable), np.int64)
        rank[order] = np.arange(len(usable))
        at = np.argsort(hashes)
        self.keys, self.rank_at = hashes[at], rank[at]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.id_at_rank = np.array(usable)[order]
        self.hash_at_rank, self.size_at_rank = hashes[order], np.array([len(p) for p in points])[order]
        self.score_at_rank, self.singles = value[order], int(single.sum())
        self.left = np.arange(len(usable))
        self.right = np.arange(len(usable))
        self.whole = np.ones(len(usable), dtype=bool)
        if self.kind == BPE:
            rank_of = {self.pieces[usable[i]]: int(rank[i]) for i in range(len(usable))}
            for text, r in rank_of.items():
                if len(text) > 1:
                    split = self.merge(text, last=True)
                    if split is None or any(x not in rank_of for x in split):
                        self.whole[r] = False
                    else:
                        self.left[r], self.right[r] = rank_of[split[0]], rank_of[split[1]]

    def merge(self, text: str, last: bool = False):
        """The merges done one by one: best score first, leftmost of equal ones.  With ``last``,
        the two parts of the final merge if all of ``text`` becomes one token, else None."""
        size, after, before = [1] * len(text), [*range(1, len(text)), -1], list(range(-1, len(text) - 1))
        queue: list = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0:
                s = self.score_of.get(text[i : j + size[j]])
                if s is not None:
                    heapq.heappush(queue, (-s, i, size[i], size[j]))

        for i in range(len(text)):
            push(i)
        split = None
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if size[i] != a or j < 0 or size[j] != b:
                continue
            split = (text[i : i + a], text[j : j + b])
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            push(before[i])
        if last:
            return split if size[0] == len(text) else None
        return [text[i : i + n] for i, n in enumerate(size) if n]

    def ids_one_by_one(self, text: str) -> list[int]:
        out: list[int] = []
        for t in self.merge(text):
            out += [self.id_of[t]] if t in self.id_of else self.fallback(t)
        return out

    def fallback(self, text: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[x] for x in text.encode("utf-8", "surrogatepass")]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of the pieces with these hashes, -1 where there is none."""
        at = self.keys.searchsorted(hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.rank_at[at], -1)

    def agree(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two tokens (as ranks) gives these two: undoes the
        later of their last merges in turn and looks for a merge across the seam that would have
        come first."""
        ok = np.ones(len(one), dtype=bool)
        live, a, b = np.arange(len(one)), one.copy(), two.copy()
        limit = np.full(len(one), np.iinfo(np.int64).max)
        pw = tb.powers(1 << 16)[0]
        while len(live):
            across = self.find(self.hash_at_rank[a] + self.hash_at_rank[b] * pw[self.size_at_rank[a]])
            bad = (across >= 0) & (across < limit)
            ok[live[bad]] = False
            later = a > b
            na, nb = self.right[a], self.left[b]
            a_done, b_done = na == a, nb == b
            end = a_done & b_done
            # the side whose merge is later is undone; if it can't be, the other one
            use_a = np.where(later, ~a_done, b_done)
            new_limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, na, a), np.where(use_a, b, nb)
            go = ~bad & ~end
            live, a, b, limit = live[go], a[go], b[go], new_limit[go]
        return ok

    def advance(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of segments of one length (rows of ``symbols``): (row, rank) in row order, a
        rank of -1 for a character without a piece."""
        n, size = symbols.shape
        flat = tb.Hashes(symbols.ravel())
        base = np.arange(n) * size
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        token = np.full((size + 1, n), -1, dtype=np.int64)
        back = np.zeros((size + 1, n), dtype=np.int64)
        every = np.arange(n)
        for j in range(1, size + 1):
            open_ = every
            for k in range(min(self.longest, j), 0, -1):
                i = j - k
                if not len(open_):
                    break
                rank = self.find(flat.of(base[open_] + i, base[open_] + j))
                fits = (rank >= 0) & ~np.isneginf(best[i][open_])
                if self.kind == BPE:
                    fits &= np.where(rank >= 0, self.whole[rank], False)
                    if i:
                        check = np.flatnonzero(fits & (token[i][open_] >= 0))
                        if len(check):
                            pair = token[i][open_[check]] * np.int64(len(self.whole)) + rank[check]
                            u, inverse = np.unique(pair, return_inverse=True)
                            fits[check] = self.agree(u // len(self.whole), u % len(self.whole))[inverse]
                    gain = 0.0
                else:
                    gain = self.score_at_rank[rank]
                value = np.where(fits, best[i][open_] + gain, -np.inf)
                better = value > best[j][open_]
                hit = open_[better]
                best[j][hit], token[j][hit], back[j][hit] = value[better], rank[better], i
                if self.kind == BPE:  # one way is the only one
                    open_ = open_[~better]
            stuck = np.flatnonzero(np.isneginf(best[j]))
            if len(stuck):  # a character in no piece
                best[j][stuck] = best[j - 1][stuck] - 1e4
                token[j][stuck], back[j][stuck] = -1, j - 1
        rows, ranks = [], []
        at, row = np.full(n, size), np.arange(n)
        while len(row):
            rows.append(row)
            ranks.append(token[at, row])
            at = back[at, row]
            more = at > 0
            at, row = at[more], row[more]
        # each round gave one token per row from the end: turn the order round
        rows_, ranks_ = np.concatenate(rows), np.concatenate(ranks)
        turn = np.concatenate([np.full(len(r), -i) for i, r in enumerate(rows)])
        order = np.lexsort((turn, rows_))
        return rows_[order], ranks_[order]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cached = np.zeros(0, np.uint64)  # hashes of segments, sorted
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _new(self, arr: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of segments, one after the other, and how many each has."""
        v = self.v
        count = np.zeros(len(begin), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        blank = np.concatenate((arr == ord(BLANK), [False]))
        twice = np.concatenate(([0], np.cumsum(blank[:-1] & blank[1:])))
        slow = twice[begin + size - 1] > twice[begin] if v.kind == BPE else np.zeros(len(begin), bool)
        order = np.argsort(size, kind="stable")
        order = order[~slow[order]]
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            n = int(size[group[0]])
            for some in np.array_split(group, min(len(group), 1 + (len(group) * n >> 17))):
                sym = arr[begin[some, None] + np.arange(n)]
                rows, ranks = v.advance(sym)
                ids = np.where(ranks >= 0, v.id_at_rank[ranks], -1)
                if (ids < 0).any():
                    out_r, out_i = [], []
                    pos = np.zeros(len(some), np.int64)
                    sizes = np.where(ranks >= 0, v.size_at_rank[ranks], 1)
                    for r, i, s in zip(rows.tolist(), ids.tolist(), sizes.tolist(), strict=True):
                        new = [i] if i >= 0 else v.fallback(chr(sym[r, pos[r]]))
                        pos[r] += s
                        out_r += [r] * len(new)
                        out_i += new
                    rows, ids = np.array(out_r), np.array(out_i)
                found.append((some[rows], ids))
        for i in np.flatnonzero(slow):
            text = arr[begin[i] : begin[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(v.ids_one_by_one(text))
            found.append((np.full(len(ids), i), ids))
        owner = np.concatenate([f[0] for f in found])
        ids = np.concatenate([f[1] for f in found]).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        count += np.bincount(owner, minlength=len(begin))
        return ids[order], count

    def shaped(self, text: str) -> str:
        return (BLANK if self.v.dummy_prefix else "") + text.replace(" ", BLANK) if text else ""

    def parts(self, text: str, most: int = _BLOCK) -> Iterator[str]:
        """A shaped text in parts of about ``most`` characters that no token spans."""
        at = 0
        while len(text) - at > most:
            end = at + most
            while end < len(text):
                pair = np.uint64(ord(text[end - 1]) << 32 | ord(text[end]))
                i = np.searchsorted(self.v.pairs, pair)
                if i == len(self.v.pairs) or self.v.pairs[i] != pair:
                    break
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has.

        Texts are cut into segments a block, or a part of a long text, at a time; the segments that
        are new to the encoder advance together."""
        parts = [list(self.parts(self.shaped(t))) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
        blocks = [self._segments(some) for _, some in tb.blocks([x for one in parts for x in one], _BLOCK)]
        del parts
        if not blocks:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        self._learn(blocks)
        ids, counts = [], []
        for key, part, n_parts, *_ in blocks:
            at = np.searchsorted(self.cached, key)
            ids.append(self.ids[_ranges(self.start[at], self.count[at])])
            counts.append(np.bincount(part, weights=self.count[at], minlength=n_parts))
        return np.concatenate(ids), np.bincount(owner, weights=np.concatenate(counts), minlength=len(texts)).astype(np.int64)

    def _segments(self, shaped: list[str]) -> tuple:
        """Of a block: each segment's hash and text, the number of texts; hashes, symbols and sizes
        of the segments that the encoder doesn't know yet."""
        v = self.v
        ends = np.cumsum([len(t) for t in shaped])
        arr = tb.points("".join(shaped))
        cut = np.ones(len(arr), dtype=bool)
        if len(arr) and len(v.pairs):
            pair = arr[:-1].astype(np.uint64) << np.uint64(32) | arr[1:]
            at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
            cut[1:] = v.pairs[at] != pair
        cut[ends[:-1][ends[:-1] < len(arr)]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(arr))[: len(begin)]
        key = tb.mix(tb.Hashes(arr).of(begin, end))
        keys, first = np.unique(key, return_index=True)
        new = np.flatnonzero(~_among(keys, self.cached))
        size = (end - begin)[first[new]]
        return key, np.searchsorted(ends, begin, side="right").astype(np.int32), len(shaped), keys[new], arr[_ranges(begin[first[new]], size)], size

    def _learn(self, blocks: list[tuple]) -> None:
        """Encodes the new segments of some blocks and keeps them sorted by hash."""
        keys, first = np.unique(np.concatenate([b[3] for b in blocks]), return_index=True)
        if not len(keys):
            return
        arr, size = np.concatenate([b[4] for b in blocks]), np.concatenate([b[5] for b in blocks])
        ids, count = self._new(arr, (np.cumsum(size) - size)[first], size[first])
        if len(self.cached) + len(keys) > _CACHE:  # start again with what these blocks need
            used = np.flatnonzero(_among(self.cached, np.unique(np.concatenate([b[0] for b in blocks]))))
            self.ids, self.cached, self.count = self.ids[_ranges(self.start[used], self.count[used])], self.cached[used], self.count[used]
            self.start = np.cumsum(self.count) - self.count
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
        self.count, self.ids, self.cached = np.concatenate((self.count, count)), np.concatenate((self.ids, ids)), np.concatenate((self.cached, keys))
        order = np.argsort(self.cached, kind="stable")  # two sorted runs: a merge
        self.cached, self.start, self.count = self.cached[order], self.start[order], self.count[order]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of token ids; unknown tokens give the library's mark, control tokens nothing."""
    out: list[bytes] = []
    for i in ids:
        kind = v.kinds[i]
        if kind == BYTE:
            out.append(bytes([int(v.pieces[i][3:5], 16)]))
        elif kind == UNKNOWN:
            out.append(" ⁇ ".encode())
        elif kind != CONTROL:
            out.append(v.pieces[i].replace(BLANK, " ").encode("utf-8"))
    text = b"".join(out).decode("utf-8", "replace")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


class Decoder:
    """Decodes many rows at once: the pieces' bytes are gathered by token."""

    def __init__(self, v: Vocabulary):
        raw = []
        for i, p in enumerate(v.pieces):
            kind = v.kinds[i]
            raw.append(bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" if kind == CONTROL else p.replace(BLANK, " ").encode("utf-8"))
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.strip = v.dummy_prefix

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        data = self.bytes[_ranges(self.start[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [x[1:] if self.strip and x[:1] == b" " else x for x in out]


@lru_cache(2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(Vocabulary(raw))


def load(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file's bytes, read once on the driver and sent along with the tasks: from its
    own disk, or for a path with a scheme by Spark."""
    if ":" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """All columns but ``text``, with ``ids``."""
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in tb.slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at, some in tb.blocks(texts, _TOGETHER):
                ids, counts = encoder.encode(some)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row").field(c).slice(at, len(some)) for c in kept] + [lists], names=[*kept, "ids"])

    return docs.select(row_of(kept).alias("row"), "text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, model: bytes) -> DataFrame:
    """All columns, with ``decoded``: the text of ``ids``."""
    names = [c for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*[f"`{c}`" for c in names]).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_encoder(model).v)
        for batch in tb.slices(batches):
            lists = batch.column("row").field("ids")
            counts = np.diff(lists.offsets.to_numpy())
            texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column("row").field(c) for c in names), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*names, "decoded"])

    return tokens.select(row_of(names).alias("row")).mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, " "), 256)
