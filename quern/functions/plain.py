"""The normalisation of ``text`` for single texts, for workers that go through whole texts anyway.

Each function gives what the column of the same name does.  The columns' patterns look at every character
several times over; here a pattern runs only where a text holds what it can match."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from quern.functions import fixed
from quern.functions.text import SPACE, plain_text

_SPACES = re.compile(f"[{SPACE}]+")
_TIGHT = re.compile(" +([,.!?;:])")
_LOOSE = (" ,", " .", " !", " ?", " ;", " :")
#: Letters whose upper or lower case lies in the alphabet, though they don't.
_KIN = "\u0131\u017f\u1c80-\u1c86"
_CYRILLIC = "а-яёА-ЯЁ\u1c80-\u1c86"
_PLACE = rf"[А-ЯЁA-Zа-яёa-z{_KIN}][а-яёА-ЯЁA-Za-z{_KIN}\- ]+"


def squeezed(text: str) -> str:
    if text.isprintable() and "  " not in text:  # the blank is the only space that counts as printable
        return text.strip(" ")
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return _SPACES.sub(" ", text).strip(" ")
    return " ".join(text.split())


def tidy(text: str) -> str:
    t = squeezed(text)
    return _TIGHT.sub(r"\1", t) if any(m in t for m in _LOOSE) else t


def fix_encoding(text: str) -> str:
    if text.isascii() or not any(c in text for c in fixed.MOJIBAKE) or "\x98" in text:
        return text
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return raw.decode("cp1251")


def clean_text(text: str | None) -> str:
    t = fix_encoding(text or "")
    t = plain_text(t) if "<" in t or "&" in t else t.strip(SPACE)
    for old, new in (("\xa0", " "), ("\u200b", ""), ("\ufeff", ""), ("…", "..."), ("« ", "«"), (" »", "»")):
        t = t.replace(old, new)
    return tidy(t)


@lru_cache(1)
def _word() -> str:
    """A class of the characters of words: letters, their marks, decimal digits, connectors, joiners."""
    out, start = [], None
    for i in range(0x110001):
        inside = i < 0x110000 and (unicodedata.category(chr(i)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc") or i in (0x200C, 0x200D) or 0x24B6 <= i <= 0x24E9 or 0x1F130 <= i <= 0x1F149 or 0x1F150 <= i <= 0x1F169 or 0x1F170 <= i <= 0x1F189)
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def _contacts() -> list[tuple[str, re.Pattern[str]]]:
    """What an upper-case text must hold for a contact to be there, and the contact."""
    w = _word()
    edge = f"(?<![{w}])"
    return [
        ("@", re.compile(rf"[{w}.\-]+@[{w}.\-]+\.[{w}]+")),
        ("WWW.", re.compile(rf"{edge}www\.[^ ]+")),
        ("HTTP", re.compile(rf"{edge}https?://[^ ]+")),
        ("ТЕЛ", re.compile(rf"{edge}\d+ *(?i:тел)\.?:?")),
        ("ТЕЛ", re.compile(rf"{edge}(?i:тел)\.?:?")),
        ("E-MAIL", re.compile(rf"{edge}(?i:e-mail):?")),
    ]


_PHONE = re.compile(r"\d[\d ().\-]{7,}\d")


def _without_phones(text: str) -> str:
    found = [m.span() for m in _PHONE.finditer(text)]
    if not found:
        return text
    out, at = [], 0
    for lo, hi in found:
        out.append(text[at : lo - (lo > at and text[lo - 1] == "+")])
        at = hi
    return " ".join((*out, text[at:]))


def remove_contacts(text: str) -> str:
    """``text`` has single blanks."""
    t = _without_phones(text)
    up = t.upper()
    for sign, pattern in _contacts() if any(s in up for s in ("@", "WWW.", "HTTP", "ТЕЛ", "E-MAIL")) else ():
        if sign in up:
            t = pattern.sub(" ", t)
    return squeezed(t)


#: What an upper-case text must hold for a dateline to be there, and the dateline.
_DATELINES = [
    (sign, re.compile(p))
    for sign, p in (
        ("INTERFAX.RU", rf"{_PLACE}\.? *\d{{1,2}} +[{_CYRILLIC}]+\. *(?i:INTERFAX\.RU) *[-—]? *"),
        ("РИА НОВОСТИ", rf"{_PLACE}, *\d{{1,2}} +[{_CYRILLIC}]+ *[-–—] *(?i:РИА Новости)\.? *"),
        ("РИА НОВОСТИ", r"(?i:РИА Новости)\.? *"),
        ("РИА НОВОСТИ", rf"(?i:МОСКВА), *\d{{1,2}} +[{_CYRILLIC}]+ *[-–—] *(?i:РИА Новости)\.? *"),
        ("ТАСС", rf"{_PLACE}, *\d{{1,2}} +[{_CYRILLIC}]+\.? */(?i:ТАСС)/\.? *"),
        ("ТАСС", rf"{_PLACE}, *\d{{1,2}} +[{_CYRILLIC}]+\.? */(?i:Корр\. ТАСС)[^/]*/\.? *"),
        ("", r"/ *[^.]+?\. *"),
    )
]


def remove_dateline(text: str) -> str:
    """``text`` has single blanks."""
    up = text.upper()
    for sign, p in _DATELINES:
        m = p.match(text) if sign in up else None
        text = text[m.end() :] if m else text
    return squeezed(text)


@lru_cache(64)
def _lowered(phrases: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(p.lower() for p in phrases)


def cut_at(text: str, phrases: Sequence[str]) -> str:
    low = text.lower()
    found = [i for i in map(low.find, _lowered(tuple(phrases))) if i >= 0]
    return text[: min(found)] if found else text


def remove_boilerplate(text: str) -> str:
    return squeezed(cut_at(text, fixed.STOP_PHRASES))


def cut_related(text: str) -> str:
    return cut_at(text, fixed.RELATED_MARKERS).strip(SPACE)


_HEADING = re.compile(rf"(?:(?i:Заголовок:)[{SPACE}]*)+")


def without_head(text: str, head: str | None = None) -> str:
    m = _HEADING.match(text)
    t = (text[m.end() :] if m else text).strip(SPACE)
    n = len(head or "")
    again = n > 0 and t.lower().startswith(head.lower()) and t[n : n + 1] and t[n] in SPACE
    return t[n:].strip(SPACE) if again else t


def sentences(text: str) -> list[str]:
    """The sentences of a text with single blanks."""
    return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")


#: The alphabet of keys and line feeds; any other byte of cp1251, which holds them all, is a blank.
_KEPT = "абвгдежзийклмнопрстуфхцчшщъыьэюяёabcdefghijklmnopqrstuvwxyz0123456789\n".encode("cp1251")
_BLANKED = bytes(b if b in _KEPT else 32 for b in range(256))


def keys(texts: Sequence[str]) -> list[bytes]:
    """``key_of`` of texts without line feeds, in cp1251."""
    low = "\n".join(texts).lower().encode("cp1251", "replace")
    return [b" ".join(k.split()) for k in low.translate(_BLANKED).split(b"\n")] if texts else []


_FILTERED = bytes(b if b in "абвгдежзийклмнопрстуфхцчшщъыьэюяabcdefghijklmnopqrstuvwxyz0123456789-.".encode("cp1251") else 32 for b in range(256))


def normalize_filter_text(text: str | None) -> str:
    low = (text or "").lower().replace("ё", "е").encode("cp1251", "replace")
    return b" ".join(low.translate(_FILTERED).split()).decode("cp1251")


def first_by_key(texts: Sequence[str]) -> Iterable[str]:
    first: dict[bytes, str] = {}
    for k, t in zip(keys(texts), texts, strict=True):
        first.setdefault(k, t)
    return first.values()


def remove_duplicate_sentences(text: str) -> str:
    """``text`` has single blanks."""
    parts = [s for s in sentences(text) if len(s) >= 20]
    return " ".join(first_by_key(parts) if len(parts) > 1 else parts)


def normalized_clean(text: str, head: str | None = None) -> str:
    return tidy(remove_duplicate_sentences(remove_contacts(remove_dateline(remove_boilerplate(without_head(text, head))))))


def normalize_article_text(text: str | None) -> str:
    return normalized_clean(clean_text(text))


@lru_cache(1)
def _service() -> re.Pattern[str]:
    w = _word()
    return re.compile(rf"(?<![{w}])(?i:{'|'.join(fixed.TITLE_SERVICE)})(?![{w}])")


_TITLE_MARK, _TITLE_DATE = re.compile("(?i:Заголовок:) *"), re.compile(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4} *[-–—] *")


def page_title(title: str | None) -> str:
    """``html.page_title`` of a title."""
    t = tidy(fix_encoding(title or ""))
    for p in (_TITLE_MARK, _TITLE_DATE):
        m = p.match(t)
        t = t[m.end() :] if m else t
    up = t.upper()
    if any(w.upper() in up for w in fixed.TITLE_SERVICE):
        t = _service().sub("", t)
    t = squeezed_inside(t).strip(" —-")
    if len(t) > 180:
        t = sentences(t)[0].strip(" ")
    letters = [c for c in t if c.isalpha()]
    if letters and sum(unicodedata.category(c) == "Lu" for c in letters) / len(letters) > 0.8:
        t = t[:1].upper() + t[1:].lower()
    return squeezed(t)


def squeezed_inside(text: str) -> str:
    return _SPACES.sub(" ", text)


def is_bad_paragraph(text: str) -> bool:
    if len(text) < 35 or "@" in text or "www." in text or text.count("|") >= 2 or len(squeezed(text).split(" ")) < 5:
        return True
    low = text.lower()
    return any(p in low for p in fixed.BAD_PARAGRAPHS)


def filter_paragraphs(paragraphs: Iterable[str], head: str | None = None) -> Iterable[str]:
    clean = [normalized_clean(p, head) for p in paragraphs]
    return first_by_key([p for p in clean if not is_bad_paragraph(p)])


_MARKS = re.compile(r"[«»\"'.,:;!?()\[\]—-]")


def is_title_fragment(text: str, title: str) -> bool:
    if not text or not title:
        return False
    inside = lambda x, y: x == y or (len(x) > 20 and x in y) or y in x
    bare = lambda x: squeezed(_MARKS.sub(" ", x))
    a, b = text.lower(), title.lower()
    return inside(a, b) or inside(bare(a), bare(b))


def remove_title_prefix(text: str, title: str) -> str:
    w = squeezed(title).split(" ")
    tries = [title, re.sub("[«»\"]", "", title)] + [" ".join(w[len(w) - k :]) for k in range(10, 3, -1) if len(w) >= k]
    low = text.lower()
    for i, x in enumerate(tries):
        if x and (len(x) >= 20 or i < 2) and low.startswith(x.lower()):
            return text[len(x) :].lstrip(SPACE + ".,:;—–-")
    return text


_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюяЁё")


def _initials_kept(text: str) -> str:
    """The text with the full stops behind single letters masked."""
    out, done, at = [], 0, text.find(".")
    while at >= 0:
        i = at - 1
        while i >= 0 and text[i] == " ":
            i -= 1
        if i >= 0 and text[i] in _LETTERS and (i == 0 or text[i - 1] not in _LETTERS):
            out += (text[done:at], "\x01")
            done = at + 1
        at = text.find(".", at + 1)
    return "".join((*out, text[done:])) if out else text


def summary_sentences(text: str, least: int = 45, most: int = 420) -> list[str]:
    t = squeezed(text)
    for a in fixed.ABBREVIATIONS:
        t = t.replace(a, a.replace(".", "\x01"))
    parts = [squeezed(s.replace("\x01", ".")) for s in sentences(_initials_kept(t))]
    parts = [s for s in parts if least <= len(s) <= most]
    low = t.lower().replace("\x01", ".")
    if any(p in low for p in fixed.BAD_SUMMARY):
        parts = [s for s in parts if not any(p in s.lower() for p in fixed.BAD_SUMMARY)]
    return parts
