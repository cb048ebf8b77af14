"""Dates of menus and labels of time. Nothing here reads the clock: `as_of` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .turkish import soft_lower

#: Month names.
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
#: Rolling time frames in days.
TIMEFRAMES = {"daily": 1, "weekly": 7, "monthly": 30, "yearly": 365}
#: A date in a cell of a grid.
DATE = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"


def grid_date(c: Column) -> Column:
    """The first d.m.yyyy, d/m/yyyy or d-m-yyyy in a cell as yyyy-mm-dd text, not checked against the calendar; else null."""
    part = [F.regexp_extract(c, DATE, i) for i in (3, 2, 1)]
    return F.when(part[0] != "", F.concat_ws("-", F.lpad(part[0], 4, "0"), F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def long_date(c: Column) -> Column:
    """'12 Mayıs 2026 ...' as a date; an impossible date or another text is null."""
    words = F.filter(F.split(c, r"[\p{Z}\s]+"), lambda x: x != "")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), soft_lower(F.try_element_at(words, F.lit(2))))
    day, year = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(3))
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((F.size(words) >= 3) & (month > 0) & day.rlike(r"^\d{1,2}$") & year.rlike(r"^\d{1,4}$"), F.try_to_date(text, "yyyy-MM-dd"))


def any_date(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")), long_date(c))


def month_range(c: Column, year: int, month: int) -> Column:
    """Whether a date is in the half-open month, as a range that reaches the scan."""
    first = F.lit(f"{year:04d}-{month:02d}-01").cast("date")
    after = F.lit(f"{year + month // 12:04d}-{month % 12 + 1:02d}-01").cast("date")
    return (c >= first) & (c < after)


def prefix_range(c: Column, prefix: str) -> Column:
    """A year ('2026') or a month ('2026-05')."""
    if len(prefix) == 7:
        return month_range(c, int(prefix[:4]), int(prefix[5:]))
    return (c >= F.lit(f"{prefix}-01-01").cast("date")) & (c < F.lit(f"{int(prefix) + 1:04d}-01-01").cast("date"))


def within(c: Column, timeframe: str | None, as_of: Column) -> Column:
    """Whether a time is in the rolling frame before as_of; an unknown frame filters nothing."""
    days = TIMEFRAMES.get(timeframe or "")
    return c >= as_of - F.expr(f"INTERVAL {days} DAYS") if days else F.lit(True)


def near_date(c: Column, as_of: Column, days: int = 730) -> Column:
    return c.between(F.date_sub(as_of, days), F.date_add(as_of, days))


def month_shift(c: Column, months: int) -> Column:
    """First day of the month so many months later."""
    return F.add_months(F.trunc(c, "month"), months)


def days_in_month(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def iso_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_label(c: Column) -> Column:
    """A month's Turkish name with a capital."""
    names = [("I" + m[1:]) if m[0] == "ı" else m[0].upper() + m[1:] for m in MONTHS]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(c))


def date_label(c: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(c).cast("string"), month_label(c), F.year(c).cast("string"))


#: Labels of meals.
MEALS = {"breakfast": "Kahvaltı", "lunch": "Öğle Yemeği", "dinner": "Akşam Yemeği"}


def meal_label(c: Column) -> Column:
    out = c
    for k, v in MEALS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def relative_label(c: Column, as_of: Column) -> Column:
    """Age of a time in words: now, minutes, hours, days, weeks, months, then the date."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(c)
    n = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(s < 60, "az önce").when(s < 3600, F.concat(n(60), F.lit(" dakika önce"))).when(s < 86400, F.concat(n(3600), F.lit(" saat önce")))
        .when(s < 7 * 86400, F.concat(n(86400), F.lit(" gün önce"))).when(s < 30 * 86400, F.concat(n(7 * 86400), F.lit(" hafta önce")))
        .when(s < 365 * 86400, F.concat(n(30 * 86400), F.lit(" ay önce"))).otherwise(F.date_format(c, "dd.MM.yyyy"))
    )


def day_bucket(c: Column, as_of: Column) -> Column:
    """today, yesterday or older."""
    d = F.datediff(F.to_date(as_of), F.to_date(c))
    return F.when(d <= 0, "today").when(d == 1, "yesterday").otherwise("older")


def day_theme(days, dated, yearly):
    """(day, theme) of a frame with a date column `day`: a holiday of that date, else of that month and day ('MM-dd'), else
    weekend or weekday. dated: (day, theme); yearly: (month_day, theme); both are small tables of the caller."""
    return (
        days.join(dated.withColumnRenamed("theme", "t1"), "day", "left")
        .join(yearly.withColumnRenamed("theme", "t2"), F.date_format("day", "MM-dd") == F.col("month_day"), "left")
        .select("day", F.coalesce("t1", "t2", F.when(F.dayofweek("day").isin(1, 7), "weekend").otherwise("default")).alias("theme"))
    )


def service_end(day: Column, weekday: str, weekend: str, since: str | None = None, later: str | None = None) -> Column:
    """The closing time of a day: by weekend, and another one from a date on."""
    end = F.when(F.dayofweek(day).isin(1, 7), weekend).otherwise(weekday)
    return F.when(day >= F.lit(since).cast("date"), later).otherwise(end) if since else end
