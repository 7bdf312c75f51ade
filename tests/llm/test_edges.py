"""Nulls, odd texts, repeated rows, empty tables and clashing names, with trained models."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import fingerprints, langid, linededup, minhash, mixing, mpegts, pieces, substrings, toxicity, warc
from tests.conftest import SMALL

NAMES = ["k", "check", "row", "s", "b", "h", "m", "i", "u", "c", "size", "source_size", "target", "copies", "score", "predicted", "offending", "lang_pred", "ids", "decoded", "n_lines", "n_removed", "n_sentences", "lines", "gone", "spans", "held", "again", "payload_digest", "record_type", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some words of a very long text, sentence after sentence, number {}. "
TEXTS = [None, "", " \n\t ", "one", "same words here and there, and some more of them", "same words here and there, and some more of them", "w " * 5000, "é😀 ß!\n\n\n.", "a\nb\nc", "x" * 3000, "".join(LONG.format(i) for i in range(2000)), "这是一个很长的句子" * 20]


def rows(doc_ids=None):
    ids = doc_ids or [*range(len(TEXTS) - 2), None, None]
    return [(i, t, ["en", None][n % 2], [None, "a", "b"][n % 3], len(t or "")) for n, (i, t) in enumerate(zip(ids, TEXTS))]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.train(docs, labels), langid.prototypes(docs.where("lang is not null").select("doc_id", "text", "lang"))


def operators(spark, models):
    model = pieces.load(spark)
    return {
        "fingerprints": fingerprints.edited_fingerprints, "lines": linededup.dedup_lines, "spans": substrings.dedup_spans, "minhash": minhash.near_duplicates,
        "mixing": mixing.mixed, "emitted": mixing.emitted, "media": lambda d: mpegts.from_media(mpegts.to_media(d)), "pieces": lambda d: pieces.decoded(pieces.encoded(d, model), model),
        "language": lambda d: langid.identify(d, models[1]), "toxicity": lambda d: toxicity.score(d, models[0], keep_text=True),
    }


ADDED = {"lines": {"n_lines", "n_removed"}, "spans": {"n_sentences", "n_removed"}, "mixing": {"size", "source_size", "target", "copies"}, "emitted": set(), "pieces": {"ids", "decoded"}, "language": {"lang_pred", "score"}, "toxicity": {"score", "predicted", "offending"}}


@pytest.mark.parametrize("name", ["fingerprints", "lines", "spans", "minhash", "mixing", "emitted", "media", "pieces", "language", "toxicity"])
def test_same_values_beside_clashing_columns_and_on_repeated_rows(spark, models, name):
    run = operators(spark, models)[name]
    docs = spark.createDataFrame(rows(), SCHEMA)
    plain, extra = run(docs), run(clashing(docs))
    shared = [c for c in plain.columns if c in extra.columns]
    key = lambda df: sorted((repr([r[c] for c in shared]) for r in df.select(*shared).collect()))
    assert key(plain) == key(extra)
    for c in set(NAMES) & set(extra.columns) - ADDED.get(name, set()) if name in ADDED else ():
        assert {r[0] for r in extra.select(f"`{c}`").collect()} == {f"own {c}"}
    assert run(docs.where("false")).collect() == []
    twice = run(docs.unionByName(docs))
    if name not in ("mixing", "emitted", "fingerprints"):
        assert sorted(repr([r[c] for c in shared]) for r in twice.select(*shared).distinct().collect()) == sorted(set(key(plain)))


def test_texts_with_defined_results(spark, models):
    docs = spark.createDataFrame(rows(), SCHEMA)
    ops = operators(spark, models)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in ops["language"](docs).collect()}
    assert [lang[i] for i in range(3)] == [("und", 0.0)] * 3 and lang[3][0] != "und"
    score = {r["doc_id"]: r for r in ops["toxicity"](docs).collect()}
    assert score[0]["score"] == score[1]["score"] and score[4]["score"] == score[5]["score"] and score[0]["text"] is None and score[1]["predicted"] == 0
    near = ops["minhash"](docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in near if r["n_shingles"] == 0} == {(0, 0), (1, 1), (2, 2)}
    assert [r["component_id"] for r in near if r["doc_id"] is None] == [None, None] and next(r for r in near if r["doc_id"] == 5)["component_id"] == 4
    tokens = {r["doc_id"]: r for r in ops["pieces"](docs).collect()}
    assert tokens[0]["ids"] == tokens[1]["ids"] == [] and tokens[9]["decoded"] == TEXTS[9] and tokens[6]["decoded"] == TEXTS[6]
    mixed = {r["doc_id"]: r["size"] for r in ops["mixing"](docs).where("doc_id < 7").collect()}
    assert [mixed[i] for i in range(7)] == [0, 0, 0, 1, 10, 10, 5000]


def test_rows_without_or_with_equal_ids_are_told_apart(spark):
    line, other = "a line that is long enough to be a window", "and another line, also long enough to be one"
    docs = spark.createDataFrame([(None, f"x\n{line}"), (None, f"y\n{line}"), (5, f"z\n{other}"), (5, f"v\n{other}"), (7, "q"), (7, "q")], "doc_id long, text string")
    left = [r["text"] for r in linededup.dedup_lines(docs).collect()]
    assert sum(line in t for t in left) == 1 and sum(other in t for t in left) == 1 and left.count("q") == 2
    words = " ".join(f"w{i}" for i in range(60)) + ". "
    docs = spark.createDataFrame([(None, "One. " + words), (None, "Two. " + words), (5, "Six. " + words.replace("w", "v")), (5, "Ten. " + words.replace("w", "v"))], "doc_id long, text string")
    lost = [r["n_removed"] > 0 for r in substrings.dedup_spans(docs).collect()]
    assert sum(lost) == 2


def test_archives_of_odd_pages(spark, tmp_path):
    pages = [(None, None, "a"), (None, "http://x", "a"), (3, "u", "a"), (3, "u", "a"), (4, "u", "a"), (5, "u", None), (6, "u", ""), (None, "u", "only"), (9, "u", "y" * 2_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for name, table in {"plain": df, "extra": df.select("*", *[F.lit("own").alias(c) for c in ("payload_digest", "record_type", "key", "salt", "refers_to", "payload_bytes")])}.items():
        warc.write(table, str(tmp_path / name))
        got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.rejoin(warc.read(spark, str(tmp_path / name))).collect()]
        want = [(None, "revisit", 3, 1)] * 2 + [(3, "response", None, 1)] * 2 + [(4, "revisit", 3, 1), (5, "response", None, 0), (6, "revisit", 5, 0), (None, "response", None, 4), (9, "response", None, 2_000_000)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    warc.write(df.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.createDataFrame([(i if i < 10 else None, t, l, s, n) for i, (_, t, l, s, n) in enumerate(rows())], SCHEMA)
    odd = clashing(docs.unionByName(docs))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        if name != "sentencepiece":
            assert out.columns == odd.columns
        got = out.collect()
        assert name == "sentencepiece" or {r["score"] for r in got} <= {"own score"}
        assert stage(spark, odd.where("false"), SMALL).collect() == []
        if name == "near duplicates":  # rows that repeat id and text count once, rows without an id stay
            assert sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x or 0)) == [*(i for i in range(10) if i != 5), *[None] * 4]
        if name == "toxicity":
            assert len(got) == len(TEXTS) * 2


def test_scores_of_languages_by_plain_loops(spark):
    """Trigram vectors bound, bundled and compared one by one."""
    texts = {"de": ["Der Hund schläft.", "Die Katze!"], "en": ["the dog sleeps", "a CAT"]}
    labelled = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in texts.items() for t in v)], "doc_id long, text string, lang string")
    names, vectors = langid.prototypes(labelled, dims=64)

    def bundle(t):
        letters = "".join(c.lower() if c.isalpha() else " " for c in t).split()
        seq = " " + " ".join(letters) + " " if letters else " "
        rnd = {c: langid._letters(langid.np.array([ord(c)], dtype="uint32"), 64)[0].astype(float) for c in set(seq)}
        roll = langid.np.roll
        return sum((roll(rnd[a], 2) * roll(rnd[b], 1) * rnd[c] for a, b, c in zip(seq, seq[1:], seq[2:])), langid.np.zeros(64))

    unit = lambda v: v / (v @ v) ** 0.5 if (v @ v) > 0 else v
    protos = {k: unit(sum(unit(bundle(t)) for t in v)) for k, v in texts.items()}
    asked = ["the katze", "Hund, dog; cat", "zzz"]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), (names, vectors)).collect()}
    for i, t in enumerate(asked):
        cos = {k: round(float(unit(bundle(t)) @ v), 9) for k, v in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert out[i]["lang_pred"] == best and abs(out[i]["score"] - max(0, cos[best])) < 1e-6


def test_noisy_or_and_its_slope(spark, models):
    import numpy as np

    rnd = np.random.default_rng(1)
    n, f = 40, 6
    doc = np.sort(rnd.integers(0, 12, n))
    at = np.unique(rnd.integers(0, n * f, 90))
    sample = toxicity.Sample(rnd.integers(0, 2, 12).astype(float), rnd.uniform(1, 3, 12), doc, at // f, at % f)
    w, b = rnd.normal(size=f), -1.0
    loss, gw, gb = sample.slope(w, b)
    share, total = sample.weight / sample.weight.sum(), 0.0
    for d in range(12):  # the loss by hand
        none = 1.0
        for s in np.flatnonzero(doc == d):
            z = b + sum(w[k % f] for k in at if k // f == s)
            none *= 1 - 1 / (1 + np.exp(-z))
        total += -share[d] * (np.log(1 - none) if sample.labels[d] == 1 else np.log(none)) if (doc == d).any() or sample.labels[d] == 0 else 0
    known = [d for d in range(12) if (doc == d).any() or sample.labels[d] == 0]
    if len(known) == 12:
        assert abs(loss - total) < 1e-9
    eps = 1e-6
    for k in range(f):
        step = np.eye(f)[k] * eps
        assert abs((sample.slope(w + step, b)[0] - sample.slope(w - step, b)[0]) / (2 * eps) - gw[k]) < 1e-5
    assert abs((sample.slope(w, b + eps)[0] - sample.slope(w, b - eps)[0]) / (2 * eps) - gb) < 1e-5
    # scores of whole texts, sentence by sentence
    text = "You are fine. You moron! What a stupid idiot you are.\nBye"
    _, _, _, z = toxicity.sentence_scores([text], models[0])
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), models[0]).first()
    assert abs(got["score"] - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-8
    assert [text[x["begin"] : x["end"]].strip() for x in got["offending"]] == [t.strip() for t, x in zip(["You are fine.", " You moron!", " What a stupid idiot you are.", "\n", "Bye"][: len(z)], z) if x >= 0] or len(z) != 5


def test_long_texts_score_as_in_one_part(models):
    import numpy as np

    text = "".join(f"Sentence {i} is here. What a moron! " for i in range(50))
    whole = toxicity.sentence_scores([text], models[0])
    cut = [(at, p) for at, p in toxicity.parts(text, 100)]
    z = np.concatenate([toxicity.sentence_scores([p], models[0])[3] for _, p in cut])
    assert len(cut) > 10 and np.allclose(z, whole[3])


def test_held_out_rule(spark):
    from quern.llm.exprs import crc_of_id

    got = spark.range(50).select("id", crc_of_id(F.col("id")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in got)
