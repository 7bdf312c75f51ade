"""The normalisation inside workers against the columns, on odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import fixed, plain as P
from quern.functions import text as T
from quern.operators import summaries as S
from quern.plans import catalogue
from quern.sources import html
from tests.conftest import SMALL
from tests.test_scale import plan

PARTS = [
    "Завод", "открыл", "новый цех", "СТАНКИ", "a", "Б.", "А. Б. Иванов", "в 2023 г.", "5 млн.", "т. д.", "Straße", "naïve", "e\u0301te\u0301", "ΟΔΟΣ", "İstanbul", "x²", "№5", "plant", "THE PLANT", "Then it came to a longer end",
    ".", ". ", "! ", "?", "? ", ", ", " ,", " :", "...", "…", "\n", "\t", "  ", " ", " ", " ", "\xa0", "\u200b", "\ufeff", "\u2003", "\u2028", "\x1c", "\x1f", "\x85", "\x01", "«", "« ", " »", "»", "(", ")", "-", " — ", "|", "/", "_", "\u200d", "\u24b6", "\u203f", "\U0001d4b3", "\U0001f600",
    "<b>", "</b>", "<p", "&amp;", "&nbsp;", "&#1047;", "<br/>", "&", "<", "Çàâîä", "Îê", "\x98",
    "МОСКВА, 5 мая - РИА Новости. ", "Пермь. 12 июня. INTERFAX.RU - ", "риа новости ", "Тула, 3 мая /ТАСС/. ", "Тула, 3 мая. /Корр. ТАСС Иван Петров/. ", "/ Агентство. ", "Заголовок: ", "ЗАГОЛОВОК:",
    "+7 (900) 123-45-67", "8 800 5553535 ", "1234567890", "12 345", "a.b@c.ru", "é_x@ü.de", "@", "www.x.ru/y", "xwww.z", "http://a.b/c", "https://d", "тел. ", "12 тел.: ", "отель", "Тел:", "e-mail: ", "E-MAIL", "email",
    "Фото: ", "Читайте также ", "реклама", "Источник: ", "популярное", "Фотогалерея", "подробнее", "Подробнее", "Новость", "Проновости", "01.02.2024 - ", "cookie",
]
DATELINES = ["Пермь, 7 мая - РИА Новости. ", "New York. 3 мая. interfax.ru — ", "МОСКВА,5 мая–РИА Новости", "Нижний Тагил, 12 июня. /ТАСС/. ", "Тула, 3 мая /Корр. тасс И. Петров/ ", "/ Агентство. "]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        odd = rng.random() < 0.5
        words = [rng.choice(PARTS) if rng.random() < (0.5 if odd else 0.04) else rng.choice(["завод", "steel", "tubes", "the", "Werk", "été", "trains. Die", "ends! And"]) for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.2:
            words = [w for w in words if max(w, default="a") < "\u0100"] + [rng.choice(["Çàâîä", "\x98", "naïve", "a"])]
        out.append(rng.choice(["", "", "", "Заголовок: ", *DATELINES]) + rng.choice([" ", " ", ""]).join(words))
    return [*out, "", " ", ".", "\x1c", "А.", " . ,", "Б .", "т.е."]


@pytest.mark.parametrize(
    ("column", "function"),
    [
        (T.clean_text, P.clean_text), (T.fix_encoding, P.fix_encoding), (T.tidy, P.tidy), (T.squeezed, P.squeezed), (T.cut_related, P.cut_related), (T.remove_boilerplate, P.remove_boilerplate),
        (lambda c: T.remove_dateline(T.squeezed(c)), lambda t: P.remove_dateline(P.squeezed(t))), (lambda c: T.remove_contacts(T.squeezed(c)), lambda t: P.remove_contacts(P.squeezed(t))),
        (lambda c: T.remove_duplicate_sentences(T.squeezed(c)), lambda t: P.remove_duplicate_sentences(P.squeezed(t))), (T.normalize_article_text, P.normalize_article_text), (T.normalized_clean, P.normalized_clean),
        (lambda c: T.normalized_clean(c, F.substring(T.tidy(c), 1, 9)), lambda t: P.normalized_clean(t, P.tidy(t)[:9])), (T.is_bad_paragraph, P.is_bad_paragraph), (html.page_title, P.page_title),
        (lambda c: F.array_join(S.summary_sentences(c), "|"), lambda t: "|".join(P.summary_sentences(t))), (lambda c: html.page_title(F.substring(c, 1, 12)), lambda t: P.page_title(t[:12])),
        (lambda c: T.is_title_fragment(c, F.substring(c, 3, 30)), lambda t: P.is_title_fragment(t, t[2:32])), (lambda c: T.remove_title_prefix(c, F.substring(c, 1, 40)), lambda t: P.remove_title_prefix(t, t[:40])),
        (lambda c: F.array_join(T.filter_paragraphs(F.split(c, r"\."), F.lit("Завод")), "|"), lambda t: "|".join(P.filter_paragraphs(t.split("."), "Завод"))),
    ],
)
def test_functions_as_columns(spark, column, function):
    given = texts(1500, 11)
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", column(F.col("t")).alias("r")).collect()
    wrong = [(given[r["i"]], r["r"], function(given[r["i"]])) for r in rows if r["r"] != function(given[r["i"]])]
    assert not wrong, (len(wrong), wrong[0])


def test_null_texts_and_lists():
    assert P.clean_text(None) == P.normalize_article_text(None) == P.page_title(None) == "" and list(P.filter_paragraphs([])) == []
    assert all(p == p.strip() for p in fixed.TITLE_SERVICE)


def test_summaries_normalise_where_they_rank(spark):
    df = catalogue.QUERIES["textrank_summary"](spark, SMALL)
    assert "regexp_replace(" not in plan(df) and "ArrowEvalPython" not in plan(df)
    news = catalogue.news(spark, SMALL)
    by_columns = S.summaries(news.select("id", "title", S.summary_sentences(T.normalize_article_text(F.col("text"))).alias("sentences")), "id")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, by_columns.collect()))


def articles_by_columns(pages, rules):
    """``html.articles`` with every candidate extracted and cleaned by columns."""

    def cleaned(c, head):
        blocks, mode = F.transform(c["blocks"], T.tidy), c["mode"]
        whole = lambda parts: T.cut_related(T.normalized_clean(F.array_join(parts, " "), head))
        rest = F.filter(F.transform(F.filter(blocks, lambda b: ~T.is_title_fragment(b, head)), lambda b: T.remove_title_prefix(b, head)), lambda b: F.length(b) >= 40)
        text = F.when(mode == "plain", T.tidy(F.array_join(c["blocks"], "\n"))).when(mode == "joined", whole(blocks)).when(mode == "trimmed", whole(rest))
        return text.otherwise(whole(T.filter_paragraphs(blocks, head)))

    done = html.extract(pages, rules).withColumn("head", html.page_title(F.col("title")))
    fit = lambda acc, c: F.when(acc.isNotNull(), acc).otherwise(T.let(cleaned(c, F.col("head")), lambda t: F.when(F.length(t) >= c["least"], t)))
    return done.select("page_id", "head", F.coalesce(F.aggregate("candidates", F.lit(None).cast("string"), fit), F.lit("")).alias("text"))


def test_pages_are_cleaned_where_they_are_parsed(spark):
    pages = catalogue.table(spark, SMALL, "pages")
    assert "regexp_replace(" not in plan(html.articles(pages))
    odd = [(i, f"https://{'abcd'[i % 4]}.ru/{i}", f"<h1>{t[:40]}</h1><article><p>{t}</p><p>{t[:40]} {u}</p><div>{u}</div><p>{u}</p></article><p>{u}</p>") for i, (t, u) in enumerate(zip(texts(300, 3), texts(300, 4), strict=True))]
    odd += [(1000, "https://a.ru", None), (1001, None, ""), (1002, "https://b.ru", "<h1>x")]
    rules = (
        html.Rule("a.ru", ("article p",), 100, 10), html.Rule("b.ru", (".no", "article p"), 50, mode="joined"), html.Rule("c.ru", ("b", "article p", "div"), 60, mode="trimmed", then_generic=True),
        html.Rule("d.ru", ("article p",), 50, mode="plain"),
    )
    for given, by in ((pages, (html.GENERIC,)), (spark.createDataFrame(odd, "page_id long, url string, html string"), rules)):
        got = {r["page_id"]: (r["title"], r["text"]) for r in html.articles(given, by).collect()}
        want = {r["page_id"]: (r["head"], r["text"]) for r in articles_by_columns(given, by).collect()}
        assert got == want and sum(len(t) > 50 for _, t in got.values()) > 30
