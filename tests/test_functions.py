"""Text, date and number functions against literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sofra.functions import classify, dates, guard, names, scalars, turkish

D, T = dt.date, dt.datetime
NOW = lambda: F.lit("2026-05-20 12:00:00").cast("timestamp")
text = lambda f, *a: lambda: f(F.lit(a[0]) if a[0] is not None else F.lit(None).cast("string"), *a[1:])
day = lambda f, v, *a: lambda: f(F.lit(v).cast("date"), *[x() if callable(x) else x for x in a])
time = lambda f, v, *a: lambda: f(F.lit(v).cast("timestamp"), *[x() if callable(x) else x for x in a])
array = lambda *v: F.array(*[F.lit(x) for x in v])

CASES = {
    "lower": (text(turkish.tr_lower, "ISPANAK İÇLİ"), "ıspanak içli"),
    "name drink": (text(names.food_name, "  - 200 ml. ayran  "), "200 ml Ayran"),
    "name soup": (text(names.food_name, "mercimek ç."), "Mercimek Çorbası"),
    "name stew": (text(names.food_name, "kuru  fasulye y."), "Kuru Fasulye Yemeği"),
    "name pilaf": (text(names.food_name, "pirinç p."), "Pirinç Pilavı"),
    "name null": (text(names.food_name, None), None),
    "split outside": (text(names.split_outside, "a (b/c) / [d/e]/f/ "), ["a (b/c)", "[d/e]", "f"]),
    "alternatives olive": (text(names.alternatives, "siyah/yeşil zeytin"), ["Siyah Zeytin", "Yeşil Zeytin"]),
    "alternatives pilaf": (text(names.alternatives, "pirinç/bulgur pilavı"), ["Pirinç Pilavı", "Bulgur Pilavı"]),
    "alternatives one": (text(names.alternatives, "cacık"), ["Cacık"]),
    "written out": (text(names.written_out, "Siyah/Yeşil Zeytin"), "Siyah Zeytin / Yeşil Zeytin"),
    "item name long": (text(names.item_name, "ş" * 76), None),
    "item name": (text(names.item_name, " ş "), "ş"),
    "number unit": (text(names.numeric_value, " 200-250 gr "), "200-250 gr"),
    "number none": (text(names.numeric_value, "çok"), None),
    "int": (text(names.strict_int, "-12"), -12),
    "int spaced": (text(names.strict_int, " 12"), None),
    "aligned": (lambda: names.aligned_value(array("a", "b"), F.lit(1)), "b"),
    "aligned single": (lambda: names.aligned_value(array("a"), F.lit(4)), "a"),
    "aligned none": (lambda: names.aligned_value(array("a", "b"), F.lit(2)), None),
    "amount": (text(names.trailing_amount, "Pilav (200 g)"), {"name": "Pilav", "amount": "200 g"}),
    "or": (text(names.or_parts, "süt VEYA ayran"), ["süt", "ayran"]),
    "calories": (text(names.calorie_range, "650-850 kcal"), {"low": 650, "high": 850}),
    "calories one": (text(names.calorie_range, "650"), {"low": 650, "high": 650}),
    "calories none": (text(names.calorie_range, "1 2 3"), None),
    "junk": (text(guard.is_junk, "Afiyet Olsun"), True),
    "junk no letters": (text(guard.is_junk, "12 - 3"), True),
    "junk null": (text(guard.is_junk, None), True),
    "dish is no junk": (text(guard.is_junk, "Mercimek Çorbası"), False),
    "feed junk": (text(guard.is_feed_junk, "• Menü"), True),
    "spam links": (text(guard.is_spam, "http://a and https://b " + "x y " * 20), True),
    "spam short link": (text(guard.is_spam, "www.a.b"), True),
    "spam letters": (text(guard.is_spam, "ee ee ee ee ee ee"), True),
    "no spam": (text(guard.is_spam, "iyi bir yemek"), False),
    "entities": (text(guard.decode_entities, "a &lt;b&gt; &quot;c&quot;"), 'a <b> "c"'),
    "html": (text(guard.strip_html, "<p>a  <b>b</b></p>"), "a b"),
    "sanitized": (text(guard.sanitize_html, "<script>x</script><b onclick='y'>z</b><img src=q>"), "<b>z</b>"),
    "profanity": (text(guard.has_profanity, "çok KÖTÜ!", ["kötü"]), True),
    "profanity inside": (text(guard.has_profanity, "kötülük", ["kötü"]), False),
    "profanity pattern": (text(guard.has_profanity, "x a(b y", ["a(b"]), True),
    "profanity none": (text(guard.has_profanity, "x", []), False),
    "censored": (text(guard.censor, "Kötü şey, a.c abc", ["kötü", "a.c", ""]), "K*** şey, a** abc"),
    "grid date": (text(dates.grid_date, "Pzt 5.3.2026"), "2026-03-05"),
    "long date": (text(dates.long_date, "12 Mayıs 2026 Salı"), D(2026, 5, 12)),
    "long date impossible": (text(dates.long_date, "31 Şubat 2026"), None),
    "any date": (text(dates.any_date, "2026-02-03"), D(2026, 2, 3)),
    "month of december": (day(dates.month_range, "2027-01-01", 2026, 12), False),
    "year prefix": (day(dates.prefix_range, "2026-12-31", "2026"), True),
    "month prefix": (day(dates.prefix_range, "2026-06-01", "2026-05"), False),
    "within": (time(dates.within, "2026-05-13 12:00:00", "weekly", NOW), True),
    "not within": (time(dates.within, "2026-05-13 11:59:59", "weekly", NOW), False),
    "near": (day(dates.near_date, "2024-05-20", lambda: F.lit("2026-05-20").cast("date")), True),
    "month shift": (day(dates.month_shift, "2026-12-31", 2), D(2027, 2, 1)),
    "days in month": (day(dates.days_in_month, "2028-02-10"), 29),
    "leap": (lambda: dates.is_leap(F.lit(1900)), False),
    "month label": (day(dates.month_label, "2026-11-02"), "Kasım"),
    "date label": (day(dates.date_label, "2026-08-02"), "2 Ağustos 2026"),
    "meal label": (text(dates.meal_label, "lunch"), "Öğle Yemeği"),
    "relative now": (time(dates.relative_label, "2026-05-20 11:59:30", NOW), "az önce"),
    "relative hours": (time(dates.relative_label, "2026-05-20 09:30:00", NOW), "2 saat önce"),
    "relative date": (time(dates.relative_label, "2025-01-02 09:30:00", NOW), "02.01.2025"),
    "bucket": (time(dates.day_bucket, "2026-05-19 23:59:00", NOW), "yesterday"),
    "service end": (day(dates.service_end, "2026-05-23", "20:00", "19:00"), "19:00"),
    "service end later": (day(dates.service_end, "2026-05-23", "20:00", "19:00", "2026-05-01", "21:00"), "21:00"),
    "meal by sheet": (lambda: classify.meal_type(F.lit("SABAH"), array("pilav", "köfte")), "breakfast"),
    "meal by items": (lambda: classify.meal_type(F.lit("x"), array("pilav", "köfte", "çay")), "dinner"),
    "meal unknown": (lambda: classify.meal_type(F.lit("x"), array("çay")), None),
    "celiac": (text(classify.is_celiac, "Colyak paketi"), True),
    "status": (text(classify.auto_status, "web", ("web",)), "approved"),
    "mapped": (text(classify.mapped, "b", {"a": 1}, 7), 7),
    "calorie label": (lambda: scalars.calorie_label(F.lit(650), F.lit(850)), "650 - 850 kcal"),
    "calorie label one": (lambda: scalars.calorie_label(F.lit(None).cast("int"), F.lit(850)), "850 kcal"),
    "price label": (lambda: scalars.price_label(F.lit(40)), "40.00 ₺"),
    "level": (lambda: scalars.level(F.lit(90)), 4),
    "level negative": (lambda: scalars.level(F.lit(-5)), 1),
    "level title": (lambda: scalars.level_title(F.lit(9), ["a", "b"]), "b"),
    "level progress": (lambda: scalars.level_progress(F.lit(25)), 50),
    "preview": (text(scalars.preview, "x" * 81), "x" * 77 + "..."),
    "diet": (lambda: scalars.diet_labels(F.lit(True), F.lit(False), F.lit(True)), ["Vegan", "Gluten-free"]),
    "best label": (lambda: scalars.best_label(F.create_map(F.lit("OTHER"), F.lit(0.2), F.lit("INSULT"), F.lit(0.8))), {"label": "INSULT", "score": 0.8, "flagged": True}),
}


@pytest.fixture(scope="module")
def got(spark):
    """All cases in one row."""
    row = spark.range(1).select(*[f().alias(f"c{i}") for i, (f, _) in enumerate(CASES.values())]).first()
    return dict(zip(CASES, row))


@pytest.mark.parametrize("case", CASES)
def test_value(got, case):
    value = got[case].asDict() if hasattr(got[case], "asDict") else got[case]
    assert value == CASES[case][1]


def test_first_rule_both_ways(spark):
    rules = spark.createDataFrame([(0, "soup", ["çorba"], []), (1, "meat", ["et", "köfte"], ["etsiz"]), (2, "other", ["a"], None)], "rule_idx int, category string, keywords array<string>, excludes array<string>")
    rows = spark.createDataFrame([(1, "ET Sote"), (2, "Etsiz köfte"), (3, "Çorba"), (4, "sütlü"), (5, None), (6, "a b")], "id int, name string")
    want = {1: "meat", 2: None, 3: "soup", 4: None, 5: None, 6: "other"}
    assert {r.id: r.category for r in classify.first_rule(rows, rules).collect()} == want
    assert {r.id: r.category for r in classify.first_rule_joined(rows, rules, "id").collect()} == want
