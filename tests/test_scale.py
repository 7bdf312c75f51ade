"""What keeps queries whole and affordable on large tables."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import clusters as C
from quern.operators import summaries as S
from quern.operators import terms as W
from quern.plans import catalogue
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, seed=1):
    rng, names = np.random.default_rng(seed), ["ab", "ab c", "été", "naïve_x", "c3", "zz", "a", "Ab", "b²"]
    rows = [(int(g), int(i), " ".join(rng.choice(names, rng.integers(0, 12)))) for i, g in enumerate(rng.integers(0, 9, 60))]
    return spark.createDataFrame([*rows, (0, 100, None), (1, 101, ""), (None, 102, "ab ab"), (3, None, "ab zz"), (77, 103, "ab")], "g int, id long, text string")


def test_similar_texts_in_tasks_as_by_joins(spark):
    rows = texts(spark)
    got = [{(r["g"], r["a"], r["b"]): r["cosine"] for r in df.collect()} for df in (S.similar_texts(rows, "g", "id"), S.similar_texts(rows, "g", "id", most_units=7), S.similar_units(S.tfidf(rows, "g", "id"), "g", "id"))]
    assert len(got[2]) > 50
    for other in got[:2]:
        assert other.keys() == got[2].keys() and all(abs(v - got[2][k]) < 1e-12 for k, v in other.items())


def test_similarity_of_members_makes_no_row_per_term(spark):
    assert "Generate" not in plan(catalogue.QUERIES["member_similarity"](spark, SMALL))


def test_markers_are_looked_for_in_a_text_normalised_once(spark):
    assert plan(catalogue.QUERIES["marker_matches"](spark, SMALL)).count("regexp_replace(") == 1


def test_most_similar_by_products_of_matrices(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 3)).astype(float).tolist()
    v[7], v[8], v[9] = None, [0.0, 0.0, 0.0], [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(v)), "id long, e array<double>")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 9) + 0.0 if size > 0 else 0.0

    want = {(i, *x[1:], n) for i in range(0, 300, 7) for n, x in enumerate(sorted((-cosine(v[i], v[j]), j) for j in range(300) if j != i)[:4], 1)}
    for block in (5, 4096):
        found = C.most_similar(rows, rows.where("id % 7 = 0"), 4, "id", "e", block)
        assert "FlatMapCoGroupsInArrow" in plan(found)
        assert {(r["query"], r["id"], r["rn"]) for r in found.collect()} == want


def test_leaders_by_bounds_as_one_by_one(monkeypatch):
    """Small blocks, so that bounds, changed centroids and centroids of the same block all meet."""
    monkeypatch.setattr(C, "AHEAD", 8), monkeypatch.setattr(C, "SHARED", 4), monkeypatch.setattr(C, "WIDE", 12)
    rng = np.random.default_rng(3)
    vectors = list(rng.normal(size=(600, 4)) * rng.uniform(0.5, 2, (600, 1)))
    vectors[5], vectors[50] = np.zeros(0), np.zeros(4)
    for threshold in (0.3, 0.9, 0.99):
        state, got = C.Leaders(), []
        for i in range(0, 600, 8):
            got += state.taken([0] * 8, list(range(i, i + 8)), vectors[i : i + 8], [True] * 8, threshold)
        sums, leaders = np.zeros((0, 4)), []
        for i, x in enumerate(vectors):
            n = np.linalg.norm(x)
            s = sums @ x / n / np.linalg.norm(sums, axis=1) if n > 0 and leaders else np.zeros(0)
            k = int(s.argmax()) if len(s) else -1
            top = max(s[k], 0.0) if len(s) else 0.0
            if len(s) and top > 0 and top >= threshold:
                sums[k] += x
            elif n > 0:
                sums, k = np.vstack((sums, x)), len(leaders)
                leaders.append(i)
            assert got[i][1:3] == (i, leaders[k] if n > 0 else i) and abs(got[i][3] - top) < 1e-9


def test_top_terms_by_chunks_as_by_joins(spark):
    rows = texts(spark, 2)
    want = {(r["g"], r["id"], r["term"], r["rn"]): r["weight"] for r in S.top_terms(S.tfidf(rows, "g", "id"), "g", "id", 3).collect()}
    assert len(want) > 100
    for chars in (100, 1_000_000):
        found = W.top_weighted(rows, "g", "id", 3, 0.95, chars)
        got = {(r["g"], r["id"], r["term"], r["rn"]): r["weight"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-12 for k, v in got.items())
        assert "Generate" not in plan(found)


def test_words_are_hashed_once_for_vectors(spark, monkeypatch):
    from quern.functions import vectors as V

    met = []
    monkeypatch.setattr(V, "MOST_WORDS", 3)
    plain_hash = V.hashlib.md5
    monkeypatch.setattr(V.hashlib, "md5", lambda w, **k: met.append(w) or plain_hash(w, **k))
    given = ["a b a Ab b", "", None, "é a a", "x y z", "a"]
    got = next(V.encoder(dims=5).func(iter([given])))
    assert len(met) == 8 and met.count(b"a") == 2  # forgotten once there were more than three
    for t, v in zip(given, got, strict=True):
        want = np.zeros(5)
        for w in (t or "").lower().split():
            h = plain_hash(w.encode()).hexdigest()
            want[int(h[:7], 16) % 5] += 1.0 if h[7] >= "8" else -1.0
        n = np.linalg.norm(want)
        assert np.array_equal(v, want / n if n > 0 else want)


def test_texts_for_tags_are_squeezed_once_and_prepared_in_one_place(spark):
    from quern.functions import plain as P
    from quern.functions import text as T
    from quern.operators import tags as G
    from tests.test_plain import texts as odd

    given = [*odd(200, 21), None]
    members = spark.createDataFrame([(i // 3, i % 3 + 1, i % 5 == 0, f"T{i}", t, f"u{i}") for i, t in enumerate(given)], "cluster_id long, rn int, is_primary boolean, title string, text string, url string")
    clusters = members.groupBy("cluster_id").agg(F.max("title").alias("title"), F.lit(None).cast("string").alias("summary_text"))
    found = G.filter_text(members, clusters)
    body = plan(found).split("collect_list")[-1]
    assert sum("regexp_replace(" in line and "coalesce(text" in line for line in body.splitlines()) == 1 and body.count("regexp_replace(coalesce(text") == 1
    want = {}
    for i, t in enumerate(given):
        cut = lambda n: P.squeezed(P.squeezed(t or "")[:n])  # noqa: B023, E731
        tag = [f"T{i}", f"T{i}", cut(5000 if i % 3 == 0 or i % 5 == 0 else 2500)]
        want.setdefault(i // 3, ([], []))
        want[i // 3][0].append(" ".join(x for x in (f"T{i}", cut(4000), f"u{i}") if x))
        want[i // 3][1].append("\n".join(x for x in tag if x))
    for r in found.join(clusters.select("cluster_id", "title"), "cluster_id").collect():
        one, tag = want[r["cluster_id"]]
        assert r["filter_text"] == " ".join([r["title"], *one]).lower() and r["tag_text"] == "\n".join([r["title"]] * 3 + tag)
    lists = [["завод", "ЁТЕЛЬ"], ["new."], []]
    ready = G.prepared(found.withColumns({"vector": F.array(F.lit(1.0)), "has_content": F.lit(True)}), *lists)
    assert "regexp_replace(filter_text" not in plan(ready)
    got = {r["cluster_id"]: tuple(r)[1:] for r in ready.select("cluster_id", "text", "foreign", "home", "banned").collect()}
    hit = lambda words: F.size(T.marker_matches(T.lemmatized(F.col("filter_text")), words)) > 0
    by_columns = found.select("cluster_id", T.lemmatized(F.col("tag_text")), *map(hit, lists))
    assert got == {r[0]: tuple(r)[1:] for r in by_columns.collect()} and any(v[1] for v in got.values())
