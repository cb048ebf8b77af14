"""Moderation, tag and table statistics. Empty tables give empty results, never placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_z
from ..functions.scalars import REASON_ELSE, REASONS, first_match, share_1dp


def status_counts(rows: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """One row: a count for each status (output name -> value), the total, and the whole percentage (rounded down) of those
    other than the first; null without rows."""
    counts = rows.agg(*[F.count_if(F.col(status) == v).alias(k) for k, v in names.items()])
    total = reduce(lambda a, b: a + b, [F.col(k) for k in names])
    done = reduce(lambda a, b: a + b, [F.col(k) for k in list(names)[1:]])
    return counts.withColumn("total", total).withColumn("resolution_rate", F.when(total > 0, F.expr(f"({' + '.join(list(names)[1:])}) * 100 div total")))


def distribution(rows: DataFrame, label: Column, name: str = "category") -> DataFrame:
    """Counts of each label and their share of all, one decimal. The window is over the labels only."""
    per = rows.groupBy(label.alias(name)).agg(F.count("*").alias("n"))
    return per.withColumn("percentage", share_1dp(F.col("n"), F.sum("n").over(Window.partitionBy())))


def reasons(reports: DataFrame, reason: str = "reason") -> DataFrame:
    return distribution(reports, first_match(F.col(reason), REASONS, REASON_ELSE))


def trending(links: DataFrame, tags: DataFrame, link_key: str, tag_key: str, time: str, as_of: Column, days: int = 30, limit: int = 10) -> DataFrame:
    """The tags used most in the last days, at most 50."""
    used = links.where(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy(link_key).agg(F.count("*").alias("n"))
    return tags.join(used, F.col(tag_key) == F.col(link_key)).orderBy(F.col("n").desc(), tag_key).limit(min(limit, 50))


def top_contributors(users: DataFrame, acts: DataFrame, user_key: str, act_key: str, limit: int = 5) -> DataFrame:
    """The users with the most acts (a filtered frame), summed before the join."""
    per = acts.groupBy(act_key).agg(F.count("*").alias("n"))
    return users.join(per, F.col(user_key) == F.col(act_key)).orderBy(F.col("n").desc(), user_key).limit(limit)


def masked_contributor(name: str, avatar: str, opted_out: Column) -> list[Column]:
    return [F.when(opted_out, "Anonim").otherwise(F.col(name)).alias(name), F.when(~opted_out, F.col(avatar)).alias(avatar)]


def months(rows: DataFrame, date: str) -> DataFrame:
    return rows.select(F.date_format(date, "yyyy-MM").alias("month")).where("month is not null").distinct()


def years(rows: DataFrame, date: str) -> DataFrame:
    return rows.select(F.year(date).alias("year")).where("year is not null").distinct()


def usage_with_zero(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Every parent with the number of its children, none included."""
    per = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias("__n"))
    return parents.join(per, F.col(key) == F.col("__k"), "left").withColumn("n_used", F.coalesce("__n", F.lit(0))).drop("__k", "__n")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table, and their total."""
    each = reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()])
    return each.unionByName(each.agg(F.sum("n").alias("n")).select(F.lit("total").alias("name"), "n"))


def warning_log(warnings: DataFrame, kinds: list[tuple[str, list[str]]], limit: int = 6) -> DataFrame:
    """The latest warnings with their kind and time in ISO form."""
    return warnings.orderBy(F.col("created_at").desc_nulls_first(), "id").limit(limit).select("id", first_match(F.col("message"), kinds, "general").alias("category"), iso_z(F.col("created_at")).alias("created_at"))


def scaled_by_group(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Each value as a share of the largest in its group."""
    top = rows.groupBy(group).agg(F.max(value).alias("__top"))
    return rows.join(top, group).withColumn("scaled", F.col(value) / F.nullif(F.col("__top"), F.lit(0))).drop("__top")


def search(rows: DataFrame, column: str, query: str | None) -> DataFrame:
    """Rows whose text has the query in it, in lower case on both sides; blank: all. % and _ are ordinary characters."""
    return rows.where(F.contains(F.lower(column), F.lower(F.lit(query.strip())))) if query and query.strip() else rows


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows that agree with all given values; a None is no condition. Only plain comparisons, so they reach the scan."""
    for k, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return rows


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """A page of a total order, with the page's number and the numbers of rows and pages."""
    limit = max(1, min(limit, most))
    total = rows.agg(F.count("*").alias("total_items"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total_items") / limit)).withColumn("current_page", F.lit(offset // limit + 1))  # one row


def two_stage_top(rows: DataFrame, time: list[Column], score: list[Column], limit: int) -> DataFrame:
    """The best of the latest: 5 * limit by time, then limit by score."""
    return rows.orderBy(*time).limit(5 * limit).orderBy(*score).limit(limit)
