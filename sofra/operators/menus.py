"""Menus: prices by tiers, documents, source priorities, synchronisation, merges and splits. All return new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import unused


def period_of(rows: DataFrame, periods: DataFrame, date: str, start: str, end: str, out: list[str]) -> DataFrame:
    """rows with the columns `out` of the period that contains their date; without one they stay with nulls.

    periods is the caller's table of price periods, a few a year; how the range join is done is left to Spark."""
    a, b = unused("period_start", rows), unused("period_end", rows)
    inside = (F.col(date) >= F.col(a)) & (F.col(date) <= F.col(b))
    return rows.join(periods.select(F.col(start).alias(a), F.col(end).alias(b), *out), inside, "left").drop(a, b)


def tiered_price(items: DataFrame, tiers: list[tuple[str, DataFrame]], out: str = "price") -> DataFrame:
    """items with the price of the first tier that knows them: each tier is a key column of items and a table (key, price)."""
    names = []
    for i, (key, prices) in enumerate(tiers):
        k, p = unused(f"key{i}", items), unused(f"price{i}", items)
        names.append(p)
        items = items.join(prices.select(F.col("key").alias(k), F.col("price").alias(p)), F.col(key) == F.col(k), "left").drop(k)
    return items.withColumn(out, F.coalesce(*names)).drop(*names)


def blackout(date: Column, price: Column, months: tuple[int, ...] = (7, 8)) -> Column:
    """No price in the months without service."""
    return F.when(~F.month(date).isin(*months), price)


def diet_bucket(package: Column, dish_ok: Column, celiac_mode: bool) -> Column:
    """Where an item of a menu goes: 'items', 'takeaways' or null. The celiac mode keeps celiac packages, and normal items
    whose dish is suitable, all as items; the standard mode drops celiac packages; packages other than NORMAL are takeaways."""
    celiac = F.coalesce(F.contains(F.upper(package), F.lit("COLYAK")) | F.contains(F.upper(package), F.lit("ÇÖLYAK")), F.lit(False))
    normal = F.coalesce(package, F.lit("NORMAL")) == "NORMAL"
    if celiac_mode:
        return F.when(celiac | (normal & F.coalesce(dish_ok, F.lit(False))), "items")
    return F.when(~celiac, F.when(normal, "items").otherwise("takeaways"))


def documents(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], fields: list[str], out: str = "items") -> DataFrame:
    """Each parent with its children as an ordered array; an empty one without children. A menu's items are few."""
    k = unused("parent_key", parents)
    per = children.groupBy(F.col(child_key).alias(k)).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(out))
    empty = F.array().cast(per.schema[out].dataType)
    return parents.join(per, F.col(key) == F.col(k), "left").drop(k).withColumn(out, F.coalesce(out, empty))


def calories(children: DataFrame, keys: list[str], own: str, estimate: str) -> DataFrame:
    """Sum of each item's own calories, or else its dish's estimate; null if nothing is above zero."""
    total = F.sum(F.coalesce(own, estimate, F.lit(0)))
    return children.groupBy(*keys).agg(F.when(total > 0, total).alias("calories"))


def priority_upsert(candidates: DataFrame, keys: list[str], priority: str, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(state, history): per key the candidate of the highest priority, of equal ones the latest, and all others."""
    w = Window.partitionBy(*keys).orderBy(F.col(priority).desc(), *[F.col(c).desc() for c in arrival])
    n = unused("n", candidates)
    ranked = candidates.withColumn(n, F.row_number().over(w))
    return ranked.where(F.col(n) == 1).drop(n), ranked.where(F.col(n) > 1).drop(n)


def sync_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, op (insert, update, delete, keep) and the new fields (the old ones of a deleted row)."""
    a = old.select(*keys, F.struct(*fields).alias("__old"))
    b = new.select(*keys, F.struct(*fields).alias("__new"))
    both = a.join(b, keys, "full_outer")
    op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update").otherwise("keep")
    return both.select(*keys, op.alias("op"), *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{f}")).otherwise(F.col(f"__old.{f}")).alias(f) for f in fields])


def merge_ids(rows: DataFrame, mapping: DataFrame, column: str, unique: list[str] | None = None) -> DataFrame:
    """rows with ids replaced by those of (old_id, new_id); of rows that then agree in `unique`, one stays."""
    old, new = unused("old_id", rows), unused("new_id", rows)
    moved = rows.join(mapping.select(F.col("old_id").alias(old), F.col("new_id").alias(new)), F.col(column) == F.col(old), "left")
    moved = moved.withColumn(column, F.coalesce(new, column)).drop(old, new)
    return moved.dropDuplicates(unique) if unique else moved


def split_names(rows: DataFrame, key: str, name: str, separator: str) -> DataFrame:
    """(key, part, place): the trimmed, non-empty parts of a name, the first one at place 0."""
    parts = F.filter(F.transform(F.split(name, separator), F.trim), lambda x: x != "")
    return rows.select(key, F.posexplode(parts).alias("place", "part"))


def nearest(points: DataFrame, places: DataFrame, distance: Column, key: str, place: str, most: float | None = None) -> DataFrame:
    """Each point with its nearest place, null beyond `most`. places is a table of cities, 81 in the domain; whether it is
    broadcast is left to Spark."""
    pairs = points.join(places).select(key, F.struct(distance.alias("d"), F.col(place).alias("place")).alias("at"))
    best = pairs.groupBy(key).agg(F.min("at").alias("b"))
    found = F.col("b.place")
    return best.select(key, (F.when(F.col("b.d") <= most, found) if most is not None else found).alias(place))


def first_source(candidates: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The candidate of the first source in a fallback chain, for each gap."""
    r = unused("r", candidates)
    return priority_upsert(candidates.withColumn(r, -F.col(rank)), keys, r, [])[0].drop(r)
