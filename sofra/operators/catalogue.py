"""The dish catalogue: names to stable ids over repeated batches, repair of aliases, merges by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Names in a range of new ids.
RANGE_ROWS = 1_000_000


def numbered(rows: DataFrame, order: list[str], start: Column | int = 1, out: str = "id") -> DataFrame:
    """rows with start, start + 1, ... by `order`, without a window over all of them: ranges are dealt and counted, a range's
    numbers follow those before it. rows is read three times, so it should be cheap or settled."""
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = settled(rows.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()))
    along = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(along), F.lit(0)).alias("before_"))  # one row a range
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return ranged.join(before, "part_").withColumn(out, (F.col("before_") + own - 1 + F.lit(start)).cast("long")).drop("part_", "before_")


def get_or_create(batch: DataFrame, dishes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (dishes, aliases) after a batch of (name, category): id, name, category and id, name, dish_id.

    Names are compared as they are. An unknown name becomes a dish and an alias with the next ids, in order of names. A known
    alias keeps its dish; one without a dish gets the dish of its own name, made if need be. A dish's category stays once it
    has one, else it is the smallest that the batch gives for a name that leads to it. Null names are left out; repeated ones
    count once. The same batch again changes nothing. Empty tables will do for each."""
    given = settled(batch.where("name IS NOT NULL").groupBy("name").agg(F.min("category").alias("category")))
    needed = given.select("name").join(aliases.select("name"), "name", "left_anti").unionByName(aliases.where("dish_id IS NULL AND name IS NOT NULL").select("name")).distinct()
    missing = settled(needed.join(dishes.select("name"), "name", "left_anti"))
    top = lambda t: t.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # noqa: E731  one number
    made = numbered(missing, ["name"], top(dishes) + 1).select("id", "name", F.lit(None).cast("string").alias("category"))
    all_dishes = settled(dishes.select("id", "name", "category").unionByName(made))
    by_name = all_dishes.groupBy("name").agg(F.min("id").alias("found"))
    repaired = aliases.select("id", "name", "dish_id").join(by_name, "name", "left").select("id", "name", F.coalesce("dish_id", "found").alias("dish_id"))
    fresh = settled(given.select("name").join(aliases.select("name"), "name", "left_anti"))
    more = numbered(fresh, ["name"], top(aliases) + 1).join(by_name, "name").select("id", "name", F.col("found").alias("dish_id"))
    all_aliases = settled(repaired.unionByName(more))
    told = given.where("category IS NOT NULL").join(all_aliases, "name").groupBy("dish_id").agg(F.min("category").alias("told"))
    kept = all_dishes.join(told, F.col("id") == F.col("dish_id"), "left").select("id", "name", F.coalesce("category", "told").alias("category"))
    return kept, all_aliases


def resolved(renames: DataFrame) -> DataFrame:
    """(old_id, new_id) with chains followed to their ends. An id that is renamed twice goes to the smaller target; ids on a
    cycle and those that lead into one are left out, so nothing is merged in a circle.

    Each round doubles the steps that a pointer has gone, so chains of n renames need log2(n) rounds, however they lie. Its
    joins are merges: renames grow with the catalogue, and nothing of them passes the driver."""
    at = settled(renames.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id")))
    sources = at.select(F.col("old_id").alias("new_id"))
    for _ in range(at.count().bit_length()):
        further = at.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"))
        at = settled(at.join(further.hint("merge"), "new_id", "left").select("old_id", F.coalesce("further", "new_id").alias("new_id")))
        if at.join(sources.hint("merge"), "new_id", "left_semi").isEmpty():
            break
    return at.join(sources.hint("merge"), "new_id", "left_anti").select("old_id", "new_id")


def by_patterns(dishes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(old_id, new_id): dishes whose name is like a pattern of (pattern, target) lead to the dish named target, which may be
    its own alias of the same name in any case. Of several patterns the smallest target's id counts; a target never leads to itself."""
    targets = patterns.join(dishes.select(F.col("id").alias("new_id"), F.col("name").alias("target")), "target")
    hits = dishes.select("id", "name").join(targets, F.expr("name ILIKE pattern"))
    return hits.where("id <> new_id").groupBy(F.col("id").alias("old_id")).agg(F.min("new_id").alias("new_id"))


def merge_dishes(dishes: DataFrame, children: dict[str, tuple[DataFrame, str, list[str]]], renames: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(dishes without the merged ones, children with their dish ids moved): children: name -> (table, dish column, unique
    columns); of rows that agree in the unique columns after the move one stays, an unmoved one first."""
    ends = settled(resolved(renames))
    moved = {}
    for name, (table, column, unique) in children.items():
        own = ends.select(F.col("old_id").alias("old_"), F.col("new_id").alias("new_")).hint("merge")
        out = table.join(own, F.col(column) == F.col("old_"), "left").withColumn(column, F.coalesce("new_", column)).withColumn("was_", F.col("old_").isNotNull())
        if unique:
            rest = [c for c in table.columns if c not in unique]
            out = out.groupBy(*unique).agg(F.min(F.struct("was_", *rest)).alias("row_")).select(*unique, *[F.col(f"row_.{c}") for c in rest])
        moved[name] = out.select(*table.columns)
    return dishes.join(ends.select(F.col("old_id").alias("id")).hint("merge"), "id", "left_anti"), moved
