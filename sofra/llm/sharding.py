"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

The key of a row is (hash of its text, doc_id, a row number), so equal texts are neighbours and still can be parted. A
size-weighted sample of keys gives quantile boundaries; binary search places each row in a range. Ranges with more than
twice their share are sampled again and subdivided. Within the exact weights of all ranges, a row goes to the shard
that holds the middle of its bytes, so shards differ by about one row's size.

Eight rounds of subdivision at most: a range that is then still over twice its share stays, and is sorted by one task.
That takes keys far from evenly spread, which hashes are not, or one row as heavy as the range. The splitters, about
RANGES a shard and one for RANGE_ROWS rows, travel in the plan as one literal.

A null or empty text has size 1. Null ids count as the smallest; ids that are not whole numbers order by their hash.
Repeated rows are placed each. A very long text is a heavy row: its shard holds it whole. An empty table gives no rows.
Other columns are not looked at, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Ranges a shard, rows a range at most on average, sampled keys a range.
RANGES, RANGE_ROWS, SAMPLED = 64, 500_000, 24
NO_ID = -(1 << 63)


def range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most the row's key: a binary search in codegen-free array functions, log2 steps a row."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    h, i, u = (F.array(*[F.lit(s[j]).cast("long") for s in splitters]) if n < 64 else F.from_json(F.lit(str([s[j] for s in splitters])), "array<bigint>") for j in range(3))
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def go(at: Column, step: Column) -> Column:
        to = at + step
        there = F.least(to, F.lit(n))
        below = (F.element_at(h, there) < F.col("h")) | ((F.element_at(h, there) == F.col("h")) & ((F.element_at(i, there) < F.col("id")) | ((F.element_at(i, there) == F.col("id")) & (F.element_at(u, there) <= F.col("u")))))
        return F.when((to <= n) & below, to).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def sampled_splitters(rows: DataFrame, wanted: float, total: int, ranges: int, salt: int) -> list[tuple[int, int, int]]:
    """Boundaries of `ranges` equal parts of a size-weighted sample of about `wanted` keys."""
    chance = F.col("size") * (wanted / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("h", "id", "u", F.lit(salt)), F.lit(1 << 40)) < chance * float(1 << 40)).select("h", "id", "u", F.greatest(chance, F.lit(1.0)).alias("w"))
    along = Window.orderBy("h", "id", "u")  # over the sample only
    part = drawn.withColumn("c", F.sum("w").over(along)).withColumn("all", F.sum("w").over(Window.partitionBy()))
    cut = part.withColumn("part", F.least(F.floor(F.col("c") * ranges / F.col("all")), F.lit(ranges - 1))).groupBy("part").agg(F.min(F.struct("h", "id", "u")).alias("k"))
    return sorted((r["k"]["h"], r["k"]["id"], r["k"]["u"]) for r in cut.collect())[1:]


def shards(documents: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce("text", F.lit(""))
    whole = isinstance(documents.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = materialise(documents.select("doc_id", F.coalesce(number, F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("u"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES * n, -(-count // RANGE_ROWS))
    splitters = sampled_splitters(rows, SAMPLED * ranges, total, ranges, 1)
    for again in range(1, 9):
        placed = rows.withColumn("range", range_of(splitters))
        weights = placed.groupBy("range").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
        over = [r["range"] for r in weights.where((F.col("w") > 2.0 * total / ranges) & (F.col("c") > 1)).collect()]
        if not over:
            break
        share = placed.where(F.col("range").isin(over))
        mass = share.agg(F.sum("size")).first()[0]
        parts = max(2, 2 * round(mass * ranges / max(1, total)))
        finer = sampled_splitters(share, SAMPLED * parts * 2, mass, parts, 1 + again)
        merged = sorted(set(splitters) | set(finer))
        if merged == splitters:
            break
        splitters = merged
    placed = rows.withColumn("range", range_of(splitters))
    along = Window.orderBy("range")  # over the ranges' sums only
    before = placed.groupBy("range").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
    before = before.select("range", (F.sum("w").over(along) - F.col("w")).alias("bytes_before"), (F.sum("c").over(along) - F.col("c")).alias("rows_before"))
    within = Window.partitionBy("range").orderBy("h", "id", "u")
    numbered = placed.withColumn("rn", F.row_number().over(within)).withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(F.broadcast(before), "range")  # one row per range
    middle = 2 * (F.col("bytes_before") + F.col("run")) - F.col("size")
    numbered = numbered.withColumn("shard", F.least(F.floor(middle * n / (2.0 * max(1, total))), F.lit(n - 1)).cast("int")).withColumn("place", F.col("rows_before") + F.col("rn") - 1)
    numbered = materialise(numbered.select("doc_id", "size", "text_crc32", "shard", "place"))
    first = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))  # n rows
