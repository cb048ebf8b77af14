"""Turkish-aware text functions as column expressions.

Three lower-casings differ on purpose. `tr_lower` maps I to dotless ı and İ to i and else lowers ASCII and the five
Turkish letters only. `soft_lower` is Unicode lower case with the combining dot of İ dropped, so I becomes i. `lower` of
Spark is plain Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZİÇŞĞÜÖ"
_LOWER = "abcdefghıjklmnopqrstuvwxyziçşğüö"
#: The Turkish alphabet, then the letters that names borrow.
ALPHABET = "abcçdefgğhıijklmnoöpqrsştuüvwxyz"
VOWELS_BACK, VOWELS_FRONT = "aıou", "eiöü"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def tr_lower(c: Column) -> Column:
    return trim(F.translate(c, _UPPER, _LOWER))


def soft_lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("i̇"), F.lit("i"))


def ascii_fold(c: Column) -> Column:
    """Turkish letters as ASCII, then lower case."""
    return F.lower(F.translate(c, "İIışŞğĞüÜöÖçÇ", "iiissgguuoocc"))


def slug(c: Column) -> Column:
    """A city's name as in addresses: lower case, Turkish letters as ASCII."""
    return F.translate(soft_lower(c), "ığüşöç", "igusoc")


def sort_key(c: Column) -> Column:
    """A key that sorts as the Turkish alphabet does: each letter as two digits, unknown characters before them."""
    letters = F.split(tr_lower(c), "")
    place = F.create_map(*[x for i, a in enumerate(ALPHABET) for x in (F.lit(a), F.lit(f"{i + 10:02d}"))])
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(place, x), F.lit("00"))), "")


def title_word(word: Column, exceptions: dict[str, str] | None = None, keep_lower: tuple[str, ...] = ()) -> Column:
    """First letter in Turkish upper case, the rest in lower case. `exceptions` has whole words with their spelling by lower
    case; `keep_lower` words stay small."""
    low = soft_lower(word)
    first = F.substring(low, 1, 1)
    big = F.when(first == "i", "İ").when(first == "ı", "I").otherwise(F.upper(first))
    out = F.concat(big, F.substring(low, F.lit(2), F.length(low)))
    if keep_lower:
        out = F.when(low.isin(*keep_lower), low).otherwise(out)
    for k, v in (exceptions or {}).items():
        out = F.when(low == k, v).otherwise(out)
    return out


#: Spellings that title casing alone would not give.
SPELLINGS = {
    "izgara": "Izgara", "ızgara": "Izgara", "ispanak": "Ispanak", "ıspanak": "Ispanak", "ispanaklı": "Ispanaklı", "ıspanaklı": "Ispanaklı",
    "islim": "İslim", "iskender": "İskender", "incik": "İncik", "inegöl": "İnegöl", "izmir": "İzmir", "imam": "İmam", "içli": "İçli",
    "işkembe": "İşkembe", "iftariyelik": "İftariyelik",
}
#: Units and small words.
SMALL = ("ve", "veya", "ile", "de", "da", "ml", "g", "gr", "kg", "l", "lt", "kcal", "adet")


def title_case(c: Column) -> Column:
    """Every word in title case, with the non-letters around it kept and single spaces between words."""

    def one(token: Column) -> Column:
        head = F.regexp_extract(token, r"^([^\p{L}]*)", 1)
        core = F.regexp_extract(token, r"^[^\p{L}]*(\p{L}(?:.*\p{L})?)", 1)
        tail = F.substring(token, F.length(head) + F.length(core) + 1, F.length(token))
        return F.when(core == "", token).otherwise(F.concat(head, title_word(core, SPELLINGS, SMALL), tail))

    tokens = F.filter(F.split(c, r"[\p{Z}\s]+"), lambda x: x != "")
    return F.array_join(F.transform(tokens, one), " ")


def last_vowel(c: Column) -> Column:
    return F.regexp_extract(tr_lower(c), rf"([{VOWELS_BACK}{VOWELS_FRONT}])[^{VOWELS_BACK}{VOWELS_FRONT}]*$", 1)


def ablative(c: Column) -> Column:
    """The name with 'from': vowel harmony by the last vowel, -t- after a hard consonant."""
    hard = tr_lower(c).rlike("[fstkçşhp]$")
    vowel = F.when(last_vowel(c).isin(*VOWELS_BACK), "a").otherwise("e")
    return F.concat(c, F.lit("'"), F.when(hard, "t").otherwise("d"), vowel, F.lit("n"))


def dative(c: Column) -> Column:
    """The name with 'to': -y- after a vowel."""
    ends = tr_lower(c).rlike(f"[{VOWELS_BACK}{VOWELS_FRONT}]$")
    vowel = F.when(last_vowel(c).isin(*VOWELS_BACK), "a").otherwise("e")
    return F.concat(c, F.lit("'"), F.when(ends, "y").otherwise(""), vowel)


def locale_contains(c: Column, query: Column) -> Column:
    """Substring search in Turkish lower case on both sides."""
    return F.contains(tr_lower(c), tr_lower(query))
