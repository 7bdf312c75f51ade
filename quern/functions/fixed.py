"""Word lists, patterns and markers that results depend on, in their natural order.

Larger dictionaries (tags with their keywords, country markers, topics not to publish) are data of
the user and are passed to the operators as tables or lists."""

# --- fixed values -----------------------------------------------------------------------------
BAD_TITLES = ["дайджест", "главное в отраслевых сми", "поздравляем", "поздравление", "с днем", "с днём", "итоги недели", "за неделю", "обзор сми", "подборка", "анонс", "фоторепортаж", "видео", "новости и медиа"]
BAD_CONTENT = ["свидетельство о регистрации сми", "политика конфиденциальности", "согласие на обработку", "персональных данных", "юридическая информация", "внутренние документы", "корпоративное управление", "личный кабинет", "тендеры", "вакансии"]
BAD_PAGE_URLS = ["/contacts", "/contact", "/about", "/privacy", "/policy", "/personal", "/governance", "/career", "/personnel-policy", "/tenders", "/legal", "/documents", "/internaldocuments", "/contractor", "/sustainability"]
BAD_LINK_URLS = ["#", "mailto:", "javascript:", "/tag/", "/tags/", "/category/", "/author/", "/search", "/contacts", "/contact", "/about", "/rss", "/feed", "/privacy", "/personal", "/policy", "/sitemap", "/governance", "/company/", "/career", "/personnel-policy", "/tenders", "/tendersandauctions", "/legal", "/documents", "/internaldocuments", "/contractor", "/sustainability", "/issues", "/books/", "/flotcominprintedmedia", "/join/", "max.ru", "translate.google", "/miller-journal", "/conference", "/media-library", "/reports", "/forum"]
ARTICLE_URLS = ["/press-center/news/", "/media/news/", "/press/news/", "/journalist/news/", "/2026/", "/ru/vazhno/", "/post/", "/publication/", "/press-releases/", "/pressreleases/", "/news-and-media/", ".html", "/doc/", "/news/promyshlennost/", "/nedradv/ru/news/", "/ru/news/", "/mining/", "/geology/", "/metallurgy/", "/oilgas/", "/nedradv/ru/page_news"]
STOP_PHRASES = ["Читайте также", "Материалы по теме", "Другие материалы", "Главное в отраслевых СМИ", "Новости по теме", "Популярное", "Последние новости", "Еще по теме", "Смотрите также", "Ранее сообщалось", "Подписывайтесь", "Подписаться", "Печатная версия статьи", "Печатная версия", "Источник:", "Фото:", "Реклама", "На правах рекламы", "Свидетельство о регистрации СМИ", "Политика конфиденциальности", "Согласие на обработку", "На информационном ресурсе применяются рекомендательные технологии", "Шрифт Guildenstern", "Оригинал: FontSpace"]
RELATED_MARKERS = ["Главное в отраслевых СМИ", "Читайте также", "Другие материалы", "Материалы по теме", "Новости по теме", "Еще по теме", "Ещё по теме", "Смотрите также", "Популярное", "Последние новости", "Ранее сообщалось", "Подписывайтесь", "Печатная версия статьи", "Печатная версия", "Фотогалерея"]
BAD_PARAGRAPHS = ["читайте также", "материалы по теме", "другие материалы", "главное в отраслевых сми", "последние новости", "популярное", "подписывайтесь", "подписаться", "реклама", "на правах рекламы", "свидетельство о регистрации", "политика конфиденциальности", "согласие на обработку", "рекомендательные технологии", "fontspace", "guildenstern", "cookie", "cookies", "печатная версия статьи", "печатная версия", "источник новости"]
BAD_SUMMARY = ["читайте также", "материалы по теме", "другие материалы", "главное в отраслевых сми", "подписывайтесь", "печатная версия", "источник новости", "фото:", "реклама", "на правах рекламы", "подробнее"]
BAD_STARTS = ["также", "кроме того", "при этом", "однако", "в то же время", "между тем", "он", "она", "они", "оно", "это", "этот", "эта", "эти", "данный", "данная", "данные", "такие", "такой", "именно тогда", "тогда", "ранее", "позднее", "первоначально", "после этого", "до этого", "в результате этого"]
BAD_CONTEXT = ["именно тогда", "как сообщалось ранее", "ранее сообщалось", "напомним", "стоит отметить", "следует отметить", "по словам", "сообщил", "сообщила", "сообщили", "рассказал", "рассказала", "рассказали"]
PRONOUNS = ["он", "она", "они", "оно", "это", "эти", "этот", "эта", "данный", "данная", "данные"]
FACT_WORDS = ["запустил", "запустила", "запустили", "открыл", "открыла", "открыли", "построил", "построила", "построили", "ввел", "ввела", "ввели", "введен", "введена", "начал", "начала", "начали", "завершил", "завершила", "завершили", "разработал", "разработала", "разработали", "представил", "представила", "представили", "модернизировал", "модернизировала", "модернизировали", "увеличил", "увеличила", "увеличили", "поставил", "поставила", "поставили", "произвел", "произвела", "произвели", "изготовил", "изготовила", "изготовили", "внедрил", "внедрила", "внедрили", "испытал", "испытала", "испытали", "передал", "передала", "передали"]
STOP_WORDS = ["и", "в", "во", "на", "с", "со", "по", "для", "от", "до", "из", "за", "к", "ко", "о", "об", "обо", "а", "но", "что", "как", "это", "его", "ее", "её", "их", "у", "же", "ли", "также", "при", "или", "были", "был", "была", "будет", "будут", "является", "стал", "стала", "стали"]
ABBREVIATIONS = ["г.", "гг.", "им.", "т.д.", "т. д.", "т.п.", "т. п.", "т.е.", "т. е.", "руб.", "млн.", "млрд."]
TITLE_SERVICE = ["Читать далее", "Подробнее", "Проновости"]
STOP_TITLES = ["читать далее", "подробнее", "новости"]
IMPORTANT_SOURCES = ["Военное.рф", "ФлотПром", "Отраслевое.рф", "ФлотКом"]
DATELINES = [
    r"^[А-ЯЁA-Z][а-яёА-ЯЁA-Z\-\s]+\.?\s*\d{1,2}\s+[а-яё]+\.\s*INTERFAX\.RU\s*[-—]?\s*",
    r"^[А-ЯЁA-Z][а-яёА-ЯЁA-Z\-\s]+,\s*\d{1,2}\s+[а-яё]+\s*[-–—]\s*РИА Новости\.?\s*",
    r"^РИА Новости\.?\s*",
    r"^МОСКВА,\s*\d{1,2}\s+[а-яё]+\s*[-–—]\s*РИА Новости\.?\s*",
    r"^[А-ЯЁA-Z][а-яёА-ЯЁA-Z\-\s]+,\s*\d{1,2}\s+[а-яё]+\.?\s*/ТАСС/\.?\s*",
    r"^[А-ЯЁA-Z][а-яёА-ЯЁA-Z\-\s]+,\s*\d{1,2}\s+[а-яё]+\.?\s*/Корр\. ТАСС[^/]*/\.?\s*",
    r"^/\s*[^.]+?\.\s*",
]
CONTACTS = [(r"\+?\d[\d\s().-]{7,}\d", ""), (r"[\w\.-]+@[\w\.-]+\.\w+", ""), (r"\bwww\.[^\s]+", ""), (r"\bhttps?://[^\s]+", ""), (r"\b\d+\s*тел\.?:?", "i"), (r"\bтел\.?:?", "i"), (r"\be-mail:?", "i")]
MOJIBAKE = "ÌÎÁÂÃÄÅÆÇÈÉ"
DEFAULT_TITLE, SOURCE_LABEL = "Новость промышленности", "Источник: "
CHROME = ["script", "style", "nav", "header", "footer", "aside", "form", "button", "noscript"]
GENERIC_SELECTORS = ["article p", "main p", ".entry-content p", ".post-content p", ".article p", ".news p", ".content p", "div[itemprop='articleBody'] p", "div[class*='content'] p", "div[class*='text'] p", "div[class*='article'] p"]
LISTING_PAGES = [
    "https://promvest.info/ru/novosti-promyishlennosti", "https://promvest.info/ru/novosti-kompaniy", "https://promvest.info/ru/novosti-avtoproma", "https://promvest.info/ru/novosti-metallurgii",
    "https://promvest.info/ru/novosti-mashinostroeniya", "https://promvest.info/ru/novosti-energetiki", "https://www.nornickel.ru/news-and-media/press-releases-and-news", "https://nornickel.ru/news-and-media/press-releases-and-news",
]
LINK_SERVICE = ["Читать далее", "Подробнее", "Проновости", "Новости", "Добыча", "Металлургия", "Геология", "Нефтегаз"]
LINK_HEADS = ["h1", "h2", "h3", "h4", ".title", ".entry-title"]
# ----------------------------------------------------------------------------------------------
