"""Calendars: zero-filled series, gaps, incident histories, quotas, latest and previous rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import unused


def calendar(spark, first: Column, last: Column, name: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias(name))


def zero_filled(usage: DataFrame, date: str, sums: list[str], as_of: Column, days: int = 28) -> DataFrame:
    """Sums of each of the last days up to as_of, zeros included: exactly max(1, days) rows."""
    n = max(1, days)
    frame = calendar(usage.sparkSession, F.date_sub(as_of, n - 1), as_of)
    per = usage.where(F.col(date).between(F.date_sub(as_of, n - 1), as_of)).groupBy(F.col(date).alias("day")).agg(*[F.sum(c).alias(c) for c in sums])
    return frame.join(per, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums])


def gaps(rows: DataFrame, kinds: DataFrame, date: str, kind: str, first: Column, last: Column) -> DataFrame:
    """(day, kind) pairs of the calendar that have no row: each kind is spread over the days where it lies."""
    wanted = kinds.select(kind, F.explode(F.sequence(first, last)).alias("day")).select("day", kind)
    seen = rows.where(F.col(date).between(first, last)).select(F.col(date).alias("day"), kind).distinct()
    return wanted.join(seen, ["day", kind], "left_anti")


def incident_history(incidents: DataFrame, components: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """(component, day, status) of the last days: the impact of the earliest incident (by start, id) that covers the day, an
    open one until as_of, else 'active'. Only incidents that began in the frame count.

    Each incident becomes its days, at most `days` rows, so the range join is an equality join."""
    first = F.date_sub(as_of, days - 1)
    start, end = F.to_date("created_at"), F.least(F.coalesce(F.to_date("resolved_at"), as_of), as_of)
    spread = incidents.where((F.col("created_at") >= F.date_sub(as_of, days)) & (start <= end)).select("component", "impact", "created_at", "id", F.explode(F.sequence(F.greatest(start, first), F.greatest(end, first))).alias("day"))
    per = spread.groupBy("component", "day").agg(F.min_by("impact", F.struct("created_at", "id")).alias("impact"))
    frame = components.select("component", F.explode(F.sequence(first, as_of)).alias("day"))
    return frame.join(per, ["component", "day"], "left").select("component", "day", F.coalesce("impact", F.lit("active")).alias("status"))


def overall_health(incidents: DataFrame) -> DataFrame:
    """One row: 'outage' if an unresolved incident is one, else 'slow' if any is unresolved, else 'active'."""
    worst = F.max(F.when(F.col("status") != "resolved", F.when(F.col("impact") == "outage", 2).otherwise(1)).otherwise(0))
    n = F.count_if(F.col("status") != "resolved").alias("n_open")
    return incidents.agg(worst.alias("w"), n).select(F.when(F.col("w") == 2, "outage").when(F.col("w") == 1, "slow").otherwise("active").alias("status"), "n_open")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order. One partial maximum could do it for a single column; ties need the window."""
    n = unused("n", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The value of the row strictly before, in the order (an as-of lookup without a range join)."""
    return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def within_quota(requests: DataFrame, key: str, time: str, limit: Column, order: list[str]) -> DataFrame:
    """Requests with whether they are within the key's daily quota; refused ones don't count."""
    w = Window.partitionBy(key, F.to_date(time)).orderBy(*order)
    n = F.row_number().over(w)
    return requests.withColumn("nth", n).withColumn("allowed", F.col("nth") <= limit)


def cooldown(requests: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Whether enough time has passed since the same key's request before."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    gap = F.unix_timestamp(time) - F.unix_timestamp(before)
    return requests.withColumn("ready", F.coalesce(gap >= seconds, F.lit(True)))


def micro_batches(requests: DataFrame, key: str, time: str, width: str = "10 seconds") -> DataFrame:
    """Counts of each key in each window, as a counter flushed at that interval writes them."""
    return requests.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")
