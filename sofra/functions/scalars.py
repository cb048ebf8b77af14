"""Numbers, hashes, vectors, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 0) -> Column:
    """Rounded, halves away from zero."""
    return F.round(c, places)


def share_1dp(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10.0).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, in double; 1 if one is all zeros or null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, 1.0 - dot(a, b) / norms), F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def fingerprint(*columns: str) -> Column:
    """A row's content hash, as an entity tag."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def calorie_label(low: Column, high: Column) -> Column:
    """'650 - 850 kcal', '650 kcal' if only one end is known or both agree, else null."""
    one = F.coalesce(low, high)
    return F.when(low.isNotNull() & high.isNotNull() & (low != high), F.format_string("%d - %d kcal", low, high)).when(one.isNotNull(), F.format_string("%d kcal", one))


def price_label(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f ₺", c.cast("double")))


def level(karma: Column) -> Column:
    """Level of a score: 1 + floor(sqrt(score / 10)), negative scores count as 0."""
    return (F.lit(1) + F.floor(F.sqrt(F.greatest(karma, F.lit(0)) / 10))).cast("int")


def level_title(lv: Column, titles: list[str]) -> Column:
    """The title of a level, the last one for all above."""
    return F.element_at(F.array(*[F.lit(t) for t in titles]), F.least(lv, F.lit(len(titles))))


def level_progress(karma: Column) -> Column:
    """Percent of the way from this level to the next, rounded."""
    k, lv = F.greatest(karma, F.lit(0)), level(karma)
    low, high = F.pow(lv - 1, F.lit(2)) * 10, F.pow(lv, F.lit(2)) * 10
    return F.round((k - low) * 100 / (high - low)).cast("int")


def preview(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def first_match(c: Column, cases: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the first case one of whose parts is in the text, whatever the case of letters."""
    out = F.lit(default)
    for label, parts in reversed(cases):
        out = F.when(reduce(lambda a, b: a | b, [c.ilike(f"%{p}%") for p in parts]), label).otherwise(out)
    return out


#: Reasons of reports and actions of warnings, by parts of their text.
REASONS = [("Hakaret & Küfür", ["inappropriate", "hakaret", "küfür", "uygunsuz"]), ("Spam & Reklam", ["spam", "reklam"]), ("Yanıltıcı İçerik", ["wrong", "fake", "sahte", "yanıltıcı", "typo"])]
REASON_ELSE = "Kural Dışı / Diğer"
ACTION_KINDS = [("toxicity", ["küfür", "hakaret"]), ("spam", ["spam", "reklam"])]


def diet_labels(vegan: Column, vegetarian: Column, celiac: Column) -> Column:
    return F.array_compact(F.array(F.when(vegan, "Vegan"), F.when(vegetarian, "Vegetarian"), F.when(celiac, "Gluten-free")))


def best_label(scores: Column, threshold: float = 0.5, other: str = "OTHER") -> Column:
    """(label, score, flagged) from a map of class scores (a soft-max output): flagged if the best is not `other` and high enough."""
    entries = F.map_entries(scores)
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("score"), e["key"].alias("label"))))
    return F.struct(best["label"].alias("label"), best["score"].alias("score"), ((best["label"] != other) & (best["score"] >= threshold)).alias("flagged"))
