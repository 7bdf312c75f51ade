import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import summaries as S


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*map(F.col, names)).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.clean_text, "Завод  <b>открыл</b>&nbsp;цех , новый …", "Завод открыл цех, новый..."),
        (T.clean_text, None, ""),
        (T.fix_encoding, "Çàâîä", "Завод"),
        (T.fix_encoding, "Îк", "Îк"),
        (T.normalize_title, "ЗАВОД ОТКРЫЛ ЦЕХ", "Завод открыл цех"),
        (T.normalize_title, "Заголовок: Новый цех Подробнее", "Новый цех"),
        (T.normalize_title, "01.02.2024 - Новый цех", "Новый цех"),
        (T.remove_dateline, "РИА Новости. Завод открыт.", "Завод открыт."),
        (T.remove_dateline, "МОСКВА, 5 мая - РИА Новости. Завод открыт.", "Завод открыт."),
        (T.remove_boilerplate, "Завод открыт. Фото: архив. читайте также: ещё", "Завод открыт."),
        (T.remove_contacts, "Пишите a@b.ru или www.x.ru, тел. 8 (800) 555-35-35 ok", "Пишите или ok"),
        (T.remove_duplicate_sentences, "Завод открыл новый цех. Завод открыл новый цех! Коротко.", "Завод открыл новый цех."),
        (T.sentence_key, "Ёлка, «дом»  №5!", "елка дом 5"),
        (T.normalize_filter_text, "Ёж-2.0, да!", "еж-2.0 да"),
        (T.hashtags, "станки, тяжёлая-пром , ", "#станки #тяжёлая_пром"),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f, text) == want


def test_repeated_title(spark):
    assert one(spark, T.remove_repeated_title, "Новый цех Завод открыл цех.", "Новый цех") == "Завод открыл цех."
    assert one(spark, T.remove_repeated_title, "Новый цехов", "Новый цех") == "Новый цехов"


def test_bad_paragraphs(spark):
    good = "Завод открыл новый цех по выпуску станков в этом году"
    assert not one(spark, T.is_bad_paragraph, good)
    for bad in (None, "", "Коротко", good + " реклама", good + " a@b", good + " | |", "слово" * 10):
        assert one(spark, T.is_bad_paragraph, bad)


def test_similar_sentences_agree_with_the_worker(spark):
    a = "Завод запустил новую линию по выпуску станков"
    for b in (a, a + " в Туле", "Завод запустил линию станков", "Совсем другое предложение о погоде", "!!!"):
        assert bool(one(spark, T.too_similar, a, b)) == S.too_similar(a, b)


def test_urls(spark):
    assert one(spark, U.domain, "https://www.Example.com:80/a?b#c") == "example.com:80"
    assert one(spark, U.domain, "https://xn--e1aybc.xn--p1ai/x") == "тест.рф"
    assert one(spark, U.path, "https://example.com/a/b/?q#f") == "/a/b"
    assert one(spark, U.joined, "https://e.com/a/b", "../c#d") == "https://e.com/c#d"
    assert one(spark, U.is_probably_article, "https://e.com/ru/news/5")
    assert not one(spark, U.is_probably_article, "https://e.com/ru/news/5#x")


def test_rss_dates(spark):
    f = lambda c: T.rss_datetime(c).cast("string")
    assert one(spark, f, "Mon, 01 Jan 2024 10:00:00 +0300") == "2024-01-01 07:00:00"
    assert one(spark, f, "01 Jan 2024 10:00:00 GMT") == "2024-01-01 10:00:00"
    assert one(spark, f, "yesterday") is None


def test_abbreviations_do_not_end_sentences(spark):
    text = "В 2023 г. завод выпустил 5 млн. изделий под руководством А. Иванова в Туле. Второе предложение тоже достаточно длинное для отбора."
    assert len(one(spark, S.summary_sentences, text)) == 2


def test_pagerank_is_a_distribution():
    sims = S.weights(["завод выпустил станки сегодня", "завод выпустил двигатели вчера", "погода ясная и тёплая", "станки и двигатели"])
    rank = S.pagerank(sims)
    assert abs(rank.sum() - 1) < 1e-6 and (rank > 0).all()


def test_summary_cases():
    assert S.summarize([], "t") == ""
    long = "Завод " + "очень " * 200
    assert S.summarize([long], most=100).endswith("...")
    s = [f"Предприятие номер {w} запустило производство {w} в регионе {w}{w}." for w in ("альфа", "бета", "гамма", "дельта", "омега")]
    assert S.summarize(s, count=2).count(".") <= 2


def test_markers_are_prepared_like_the_text(spark):
    assert T.prepared_markers([" США ", "Ёлки", "", "сша", "заводы"], {"заводы": "завод"}) == ["завод", "елки", "сша"]
    df = spark.createDataFrame([("Ёлки из США",)], "t string")
    assert df.select(T.marker_matches(T.lemmatized(F.col("t")), ["сша", "ЁЛКИ", "нет"])).first()[0] == ["елки", "сша"]
    assert df.select(T.is_foreign_title(F.col("t"), ["США"], ["Россия"]), T.normalize_for_keywords(F.lit("А.Б"))).first() == (True, "а б")


def test_sparse_ranks_equal_dense_ones():
    import numpy as np

    sentences = ["завод выпустил станки сегодня утром", "завод выпустил двигатели вчера", "погода ясная и тёплая", "станки и двигатели", "123", "утром завод"]
    w = S.weights(sentences)
    rows = np.zeros((w.n, w.term.max() + 1))
    rows[w.row, w.term] = w.value
    near = rows @ rows.T
    assert all(abs(near[i, i] - 1) < 1e-12 for i in set(w.row)) and np.allclose([w.similar(e) for e in np.eye(w.n)], near)
    x, total = np.full(w.n, 1 / w.n), near.sum(axis=1)
    for _ in range(200):
        step = np.divide(near, total[:, None], out=np.zeros_like(near), where=total[:, None] > 0)
        x = 0.85 * (x @ step + x[total == 0].sum() / w.n) + 0.15 / w.n
    assert np.allclose(S.pagerank(w), x, atol=1e-5)


def test_summaries_of_russian_texts():
    news = ["Завод в Перми запустил новую линию по выпуску труб.", "Он работает уже давно и всем известен в этом крае.", "Мощность линии составит 100 тысяч тонн продукции в год.", "Мощность линии составит 100 тысяч тонн продукции в год."]
    got = S.summarize(news, "Завод запустил линию", count=2)
    assert got == f"{news[0]} {news[2]}"
    assert S.summarize([], "t") == "" and S.summarize(["Короткое"], "Заголовок") == ""
    assert S.summarize(news[:1] * 2) == news[0] and len(S.summarize([f"{c} {news[0]}" for c in "абвгд"], most=60)) <= 60
