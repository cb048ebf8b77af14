"""Checks and cleaning of user and menu text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .turkish import ascii_fold, trim

#: Phrases of notices, officials and calorie lines, ASCII-folded.
JUNK = (
    "il muduru", "sube muduru", "genclik ve spor", "rektor", "daire balkani", "daire baskani", "valisi",
    "valilik", "kaymakam", "ramazan ayi", "hayirli ramazanlar", "afiyet olsun", "iyi dersler", "not:", "not :", "duyuru",
    "menude degisiklik", "menudegisiklik", "tarihinde", "yili", "kalori", "kcal", "toplam kalori", "besin degerleri", "besin degeri",
    "icerik", "kullanim kosullari", "fiyat listesi", "tabldot ucreti",
)
#: What counts as a link.
LINKS = ("http://", "https://", "www.", "ftp://")
#: Entities in the pages that are read, and their characters; the ampersand first.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
TURKISH_ENTITIES = tuple((f"&#x{ord(c):X};", c) for c in "şŞıİğĞçÇüÜöÖ+")


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def is_junk(c: Column, names: tuple[str, ...] = ()) -> Column:
    """Notices, calorie lines, empty texts and texts without letters, and texts with one of the caller's names (of officials,
    say; ASCII, lower case). A null is junk."""
    t = trim(c)
    return F.coalesce((t == "") | ~t.rlike(r"\p{L}") | contains_any(ascii_fold(t), (*JUNK, *names)), F.lit(True))


def is_feed_junk(c: Column) -> Column:
    """Navigation texts in the JSON feed, and what is junk anyway, and texts of under three bytes."""
    return (F.octet_length(c) < 3) | is_junk(c) | c.rlike(r"(?iu)(yemek listesi|KYK Men|kahvalt.{0,3}ak.{0,3}am|^[-←→•*])")


def count_of(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def is_spam(c: Column) -> Column:
    """Two links, a link in under 50 bytes, or one letter more than ten times in a row, non-letters between not counted."""
    low = F.lower(c)
    links = reduce(lambda a, b: a + b, [count_of(low, n) for n in LINKS])
    letters = F.regexp_replace(c, r"\P{L}", "")
    return (links >= 2) | ((links >= 1) & (F.octet_length(c) < 50)) | letters.rlike(r"(\p{L})\1{10,}")


def decode_entities(c: Column, turkish: bool = False) -> Column:
    for name, char in (ENTITIES[:4] + TURKISH_ENTITIES + ENTITIES[4:]) if turkish else ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Without tags, with entities decoded, with single spaces."""
    bare = F.regexp_replace(c, r"</?[a-zA-Z0-9]+(?:\s+[^>]*)?>", "")
    return trim(F.regexp_replace(decode_entities(bare), r"[\p{Z}\s]+", " "))


def sanitize_html(c: Column, allowed: tuple[str, ...] = ("a", "b", "i", "u", "em", "strong", "p", "br", "ul", "ol", "li", "code", "pre", "blockquote")) -> Column:
    """An approximation of an allow-list sanitizer: scripts and styles go with their content, allowed tags lose their
    attributes, other tags go. Use it to clean text for display, not as a security boundary."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, rf"(?i)<(/?)(?:({'|'.join(allowed)}))\b[^>]*>", "\u0001$1$2\u0002")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    return F.translate(s, "\u0001\u0002", "<>")


def _quoted(text: str) -> str:
    """A regular expression of just this text."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)


def _as_word(pattern: str, rest: str = "") -> str:
    """The pattern, as a group, and what comes after it, in any case, with no letter, digit or underscore beside them."""
    return rf"(?iuU)(?<![\p{{L}}\p{{N}}_])({pattern}){rest}(?![\p{{L}}\p{{N}}_])"


def has_profanity(c: Column, words: list[str]) -> Column:
    """Whether a word of the caller's list is in the text as a whole word, in Turkish or plain lower case. Words are plain
    texts, whatever characters they have; empty ones are none."""
    listed = sorted({w for w in words if w})
    return c.rlike(_as_word("|".join(_quoted(w) for w in listed))) if listed else F.lit(False)


def censor(c: Column, words: list[str]) -> Column:
    """Listed words with their letters after the first as stars."""
    for w in words:
        if w:
            c = F.regexp_replace(c, _as_word(_quoted(w[0]), _quoted(w[1:])), "$1" + "*" * (len(w) - 1))
    return c
