import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components, fingerprints, langid, linededup, minhash, mixing, mpegts, pieces, substrings, toxicity, warc

def test_sketches(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:200]), " ".join(words[200:]))], "a string, b string, c string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    r = df.select(
        fingerprints.resemblance(s["a"], s["b"]).alias("near"), fingerprints.containment(s["b"], s["a"]).alias("inside"), fingerprints.distinct_count(s["a"]).alias("n"),
        (fingerprints.from_text(fingerprints.as_text(s["a"])) == s["a"]).alias("back"),
    ).first()
    assert abs(r["near"] - 196 / 296) < 0.15 and r["inside"] > 0.8 and abs(r["n"] - 296) < 90 and r["back"]
    parts = df.select(F.lit(1).alias("k"), F.explode(F.array(s["b"], s["c"])).alias("sketch"))
    whole = fingerprints.merge_parts(parts, "k").first()["sketch"]
    union = df.select(fingerprints.merged(s["b"], s["c"]).alias("m")).first()["m"]
    assert whole == union


@pytest.mark.parametrize("bucket", [2, 7, 1024])
def test_successors_of_clumped_equal_and_missing_ids(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket)
    rnd = random.Random(bucket)
    ids = [*range(40), *(10**12 + 3 * i for i in range(30)), -(2**63) + 5, 2**63 - 1, *[7] * 25, *[None] * 20]
    rows = [(i, f"text {n} " + " ".join(str(rnd.randrange(50)) for _ in range(12))) for n, i in enumerate(ids)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check = {r["text"]: r["c"] for r in docs.select("text", fingerprints.text_check(F.col("text")).alias("c")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, check[r[1]]))
    want = {t: hashlib.sha256((t[: len(t) - len(t) // 2] + order[(n + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for n, (_, t) in enumerate(order)}
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(rows) and {r["edited_sha256"] for r in got} == set(want.values())


def brute_near(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rnd = random.Random(size)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(14):  # copies whose likeness lies on both sides of the limit
            copy = list(base)
            for _ in range(rnd.randrange(max(1, len(base) // 10))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "one", "ONE  two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size, 80).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts, size, 80)


def test_near_duplicates_of_a_large_group_equal_brute_force(spark):
    """Copies of one text by replacing, deleting and inserting words, and copies of copies: many stay
    outside the limit of the first text and are linked with other copies only."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(2000)}" for _ in range(90)]
    copies = [base]
    for _ in range(700):
        copy = list(base if rnd.random() < 0.6 else rnd.choice(copies))
        for _ in range(rnd.randrange(0, 14)):
            at, how = rnd.randrange(len(copy)), rnd.random()
            copy[at : at + 1] = [f"x{rnd.randrange(3000)}"] if how < 0.5 else [] if how < 0.75 else [copy[at], f"y{rnd.randrange(3000)}"]
        copies.append(copy)
    shared = " ".join(f"c{i}" for i in range(30))
    others = [f"{shared} " + " ".join(f"z{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 60))) for _ in range(350)]
    texts = [" ".join(c) for c in copies] + others
    rnd.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80).collect()}
    want = brute_near(texts, 2, 80)
    assert [got[i] for i in range(len(texts))] == want and 20 < len({c for _, c in want}) < len(texts)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {n: find(n) for e in edges for n in e if find(n) != n}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_mix_comes_near_its_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * int(rnd.paretovariate(1.2) * 20), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs, bucket_rows=256).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.06 * r["target"] and r["most"] <= 2 for r in out)
    n = mixing.emitted(docs).count()
    assert n == mixing.mixed(docs).agg(F.sum("copies")).first()[0]


def plain_read(media):
    """A second, plain parser: payloads by packet id, for streams without faults."""
    bodies = {}
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        pid, skip = int.from_bytes(p[1:3], "big") & 0x1FFF, 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if p[3] & 0x10 and pid not in (0, 0x1000, 0x1FFF):
            bodies.setdefault(pid, []).append((bool(p[1] & 0x40), p[3] & 15, p[skip:]))
    out = {}
    for pid, parts in bodies.items():
        parts = [x for k, x in enumerate(parts) if not k or x != parts[k - 1]]  # packets sent twice
        units = []
        for start, _, b in parts:
            if start:
                units.append(b"")
            units[-1] += b
        out[pid] = b"".join(u[9 + u[8] : 6 + int.from_bytes(u[4:6], "big")] for u in units)
    return out


def packets(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_interleaved_streams_repeats_and_long_tables():
    rnd = random.Random(4)
    one, two = rnd.randbytes(3000), rnd.randbytes(2500)
    section = lambda table, body: mpegts._section(table, 1, body)
    info = bytes([0x05, 180]) + rnd.randbytes(180)  # a descriptor that makes the program map longer than a packet
    entry = lambda pid: b"\x06" + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    table = b"\x00" + section(2, b"\xe1\x00\xf0\x00" + entry(0x100) + entry(0x101))
    maps = [b"\x47" + ((0x4000 if k == 0 else 0) | 0x1000).to_bytes(2, "big") + bytes([0x10 | k & 15]) + table[a : a + 184].ljust(184, b"\xff") for k, a in enumerate(range(0, len(table), 184))]
    pat = packets(mpegts._TABLES)[:1]
    a = packets(mpegts.encode(one, 1000))[2:]
    b = [p[:1] + ((p[1] & 0xE0) << 8 | 0x101).to_bytes(2, "big") + p[3:] for p in packets(mpegts.encode(two, 1000))[2:]]
    mixed = [x for pair in zip(a, b) for x in pair] + a[len(b) :] + b[len(a) :]
    found = mpegts.parse(b"".join(pat + maps + mixed))
    assert {k: x.payload for k, x in found.streams.items()} == {0x100: one, 0x101: two} == plain_read(b"".join(mixed))
    assert (found.cc_errors, found.crc_errors, found.pes_errors, found.programs) == (0, 0, 0, 1)
    assert [t for t, _ in found.first.points] == [3600, 7200, 10800] and [o for _, o in found.streams[0x101].points] == [0, 1000, 2000]
    doubled = mpegts.parse(b"".join(pat + maps + [x for p in mixed for x in (p, p)]))
    assert doubled.first.payload == one and doubled.cc_errors == 0
    jumped = [bytes(p[:3]) + bytes([p[3] & 0xF0 | (p[3] + 5) & 15]) + p[4:] for p in a]
    assert mpegts.parse(b"".join(pat + maps + a[:2] + jumped[2:])).cc_errors == 1
    flagged = jumped[2][:3] + bytes([jumped[2][3] | 0x20]) + b"\x01\x80" + jumped[2][4:-2] if not jumped[2][3] & 0x20 else None
    if flagged:
        assert mpegts.parse(b"".join(pat + maps + a[:2] + [flagged])).cc_errors == 0
    broken = bytearray(maps[0])
    broken[30] ^= 1
    assert mpegts.parse(b"".join(pat + [bytes(broken)] + maps[1:] + mixed)).crc_errors == 1
    assert mpegts.parse(b"".join(pat + maps + a[:3])).pes_errors == 1 and mpegts.parse(b"junk" * 100).cc_errors == 3


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 169, 170, 171, 184, 200, 5000, 40000, 100_000])
def test_transport_stream(n):
    data = random.Random(n).randbytes(n)
    media = mpegts.encode(data, 1000 if n < 10_000 else 32768)
    found = mpegts.parse(media)
    one = found.first
    assert one.payload == data and found.cc_errors == found.crc_errors == found.pes_errors == 0 and len(media) % 188 == 0
    assert len(one.points) == len(one.parts) and [o for _, o in one.points] == sorted({o for _, o in one.points})
    assert plain_read(media) == ({0x100: data} if n else {})
    if found.packets > 6:
        cut = media[: 188 * 4] + media[188 * 5 :]
        assert mpegts.parse(cut).cc_errors == 1


def test_media_digests(spark):
    r = mpegts.from_media(mpegts.to_media(spark.createDataFrame([(1, "é" * 50), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    payload = ("é" * 50).encode() + bytes(28)
    assert (r[0]["n_bytes"], r[0]["payload_bytes"], r[0]["payload_sha256"], r[0]["tail_crc32"]) == (100, 128, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert (r[1]["n_bytes"], r[1]["payload_sha256"]) == (0, hashlib.sha256(bytes(64)).hexdigest())


def brute_lines(texts, window):
    """Line dedup by plain loops: windows, first positions, extension, stretches."""
    lines = [t.split("\n") for t in texts]
    size = [[len(x.strip(" \t\n\x0b\x0c\r")) for x in u] for u in lines]
    name = lambda x: (int(hashlib.md5(x.encode()).hexdigest()[: linededup.DIGITS], 16), hashlib.md5(x.encode()).hexdigest())
    prints = []
    for u, z in zip(lines, size):
        solid, chosen = [i for i in range(len(u)) if z[i]], set()
        for a in range(len(solid)):
            total = 0
            for b in range(a, len(solid)):
                total += z[solid[b]]
                if total >= window:
                    chosen.add(min(solid[a : b + 1], key=lambda i: (name(u[i])[0], -i)))
                    break
        prints.append(sorted(chosen))
    first, out = {}, []
    for d, (u, z) in enumerate(zip(lines, size)):
        gone = set()
        for k, p in enumerate(prints[d]):
            e, q = first.setdefault(name(u[p])[1], (d, p))
            if (e, q) != (d, p):
                at = prints[e].index(q)
                for step, end, other in ((-1, prints[d][k - 1] if k else 0, prints[e][at - 1] if at else 0), (1, prints[d][k + 1] if k + 1 < len(prints[d]) else len(u) - 1, prints[e][at + 1] if at + 1 < len(prints[e]) else len(lines[e]) - 1)):
                    i, j = p, q
                    gone.add(i)
                    while i != end and j != other and u[i + step] == lines[e][j + step]:
                        i, j = i + step, j + step
                        gone.add(i)
        stretch, last = [], None
        for i in [*sorted(gone), None]:
            if stretch and (i is None or i != last + 1):
                if sum(z[x] for x in stretch) < window:
                    gone -= set(stretch)
                stretch = []
            stretch.append(i)
            last = i
        out.append("\n".join(x for i, x in enumerate(u) if i not in gone))
    return out


def test_lines_equal_brute_force(spark):
    rnd = random.Random(5)
    pool = ["", "  ", "Yes.", "No way", "Menu", "Home | About"] + ["line " + "".join(rnd.choice("abcdef ") for _ in range(rnd.choice([8, 20, 60]))) for _ in range(30)]
    texts = []
    for _ in range(150):
        part = [rnd.choice(pool) if rnd.random() < 0.6 else f"own {rnd.randrange(10**9)}" for _ in range(rnd.randrange(1, 14))]
        if texts and rnd.random() < 0.4:  # a run of lines of another text
            u = rnd.choice(texts).split("\n")
            a = rnd.randrange(len(u))
            part[3:3] = u[a : a + rnd.randrange(1, 6)]
        texts.append("\n".join(part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    want = brute_lines(texts, linededup.WINDOW)
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert sum(r["n_removed"] > 0 for r in got.values()) > 30


def test_a_long_line_goes_between_any_neighbours(spark):
    long = "a passage of one line that is long enough"
    texts = [f"a\n{long}\n\nb", f"c\n{long}\nd\n\nd", "x\n\ny", "short\nlines", "short\nlines"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert left == dict(enumerate(texts)) | {1: "c\nd\n\nd"}


def brute_spans(texts, least):
    """Span dedup by plain loops over words."""
    alone = lambda c: any(lo <= ord(c) <= hi for lo, hi in substrings.UNSPACED)
    space, seen, out = " \t\n\x0b\x0c\r", set(), []
    for t in texts:
        spans, i = [], 0
        while i < len(t):
            if t[i] in space:
                i += 1
                continue
            j = i + 1
            while not alone(t[i]) and j < len(t) and t[j] not in space and not alone(t[j]):
                j += 1
            spans.append((i, j))
            i = j
        units, unit, since = [], [], 0
        for k, (a, b) in enumerate(spans):
            unit.append(k)
            since += 1
            cut = t[b - 1] in substrings.STOPS or (31 * ord(t[b - 1]) + 17 * (b - a)) % substrings.CUT == 0
            if cut or since % substrings.UNIT == 0 or k == len(spans) - 1:
                units.append(unit)
                unit = []
            if cut:
                since = 0
        fold = lambda k: "".join(c.lower() if c.isascii() else c for c in t[slice(*spans[k])])
        gone = set()
        for a in range(len(units)):
            n = 0
            for b in range(a, len(units)):
                n += len(units[b])
                if n >= least:
                    key = tuple(fold(k) for u in units[a : b + 1] for k in u)
                    if key in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(key)
                    break
        begin = [0 if u == 0 else spans[units[u][0]][0] for u in range(len(units))] + [len(t)]
        out.append(("".join(t[begin[u] : begin[u + 1]] for u in range(len(units)) if u not in gone) if gone else t, len(units), len(gone)))
    return out


def test_planted_passages_and_short_fragments(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioubcdfgh") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", "", "", ",", ".", "!\n"]) for _ in range(n))
    passages = [" ".join(word() for _ in range(rnd.randrange(51, 80))) if i % 2 else prose(rnd.randrange(51, 80)) for i in range(15)]
    fragments = [prose(rnd.randrange(3, 29)) for _ in range(15)] + ["No. 1. A.", "Other. Words. Here. Again."]
    texts, planted = [], set()
    for i in range(160):
        t = [prose(rnd.randrange(5, 60))]
        if i % 4 == 0:
            t.append(passages[i // 4 % 15].upper() if i % 3 else passages[i // 4 % 15])
            if i >= 60:
                planted.add(i)
        elif i % 4 == 1:
            t.append(rnd.choice(fragments))
        texts.append(" ".join([*t, prose(rnd.randrange(5, 60))]))
    texts += ["甲乙。" + "这是一个很长的句子用来检查没有空格的文字里重复的段落" * 2, "丙丁。" + "这是一个很长的句子用来检查没有空格的文字里重复的段落" * 2, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.dedup_spans(docs).collect()}
    assert [(got[i]["text"], got[i]["n_sentences"], got[i]["n_removed"]) for i in range(len(texts))] == brute_spans(texts, substrings.SPAN_WORDS)
    hit = {i for i in range(160) if got[i]["n_removed"]}
    assert len(hit & planted) >= 0.95 * len(planted) and hit <= planted and got[161]["n_removed"] and not got[160]["n_removed"]


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n\r\n", "é" * 1000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://e/{i} ", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    rows = {r["page_id"]: r for r in warc.rejoin(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert [rows[i]["refers_to"] for i in range(7)] == [None, 0, None, 2, None, None, 0]
    assert rows[4]["payload"] == html[4] and rows[5]["payload"] == html[5] and rows[1]["payload_bytes"] == 8 and rows[3]["payload_bytes"] == 0


def test_encoder_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    rnd = random.Random(3)
    parts = list(" \t\nabcdeABC0123.,!?-_éñßжиш世😀▁") + ["  ", "    ", "the", "ing", " the", "tion"]
    texts = ["", " ", " " * 37, "a" * 300, "=\t" * 20] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 50))) for _ in range(1500)]
    e = pieces.Encoder(v)
    for _ in range(2):  # the second time from the cache
        ids, counts = e.encode(texts)
        ends = np.concatenate(([0], np.cumsum(counts)))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)
    assert [x.decode("utf-8", "replace") for x in pieces.Decoder(v).decode(ids, counts)] == [sp.decode(i) for i in sp.encode(texts)]
    assert pieces.decode(v, sp.encode("Hello  world é😀")) == "Hello  world é😀"


def test_unigram_viterbi_is_the_best_sum():
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    v.kind = pieces.UNIGRAM
    words = ["▁hello", "▁international", "▁processing", "▁aaaa"]
    for w in words:
        best = [0.0] + [-1e18] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = max(best[i] + v.score_of[w[i:j]] for i in range(j) if w[i:j] in v.score_of)
        sym = pieces.tb.points(w)[None, :]
        _, ranks = v.advance(sym)
        assert abs(sum(v.score_at_rank[ranks]) - best[-1]) < 1e-6


def test_offending_sentences(spark):
    texts = [f"A calm line {i}. You are a {'moron' if i % 2 else 'friend'} today. End." for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    s_doc, lo, hi, z = toxicity.sentence_scores(["Fine words. You moron here. Bye."], m)
    assert [("Fine words. You moron here. Bye."[a:b]).strip() for a, b, x in zip(lo, hi, z) if x > 0] == ["You moron here."]
    assert toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).bias == toxicity.NEVER


def test_profiles_are_exact_sums():
    texts = ["the cat", "Ünï cat; DOG", "", "123"]
    together, n = langid.profiles(texts)
    assert n.tolist() == [6, 9, 0, 0]
    for t, v in zip(texts, together):
        assert (langid.profiles([t])[0][0] == v).all()
