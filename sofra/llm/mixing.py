"""Mixing of sources to target weights by pivotal dependent rounding.

Sources in code point order (null last) weigh by a repeating cycle and share a total; a target above `limit` times its
source is cut there and the excess is shared anew by weight. A document's expected copies are target / source size. The
whole part is taken; fractions are rounded by weighted pivotal steps: two documents exchange words of expected mass, at
random and without bias, until one of them is whole. A step leaves a source's expected words as they were.

Rows that agree in id, text and source are one item with a number of copies, counted with partial sums. Items are dealt
to buckets of bounded size by a hash of all that, so neither a hot source, nor null ids, nor a repeated row make a large
bucket. In a bucket the largest documents settle first, and each source leaves one fractional item, which meet in a
reduction tree of fixed fan-in. At the root these meet RESERVED items of each size class (powers of two) that were kept
back, again the largest first: each class settles among documents of half its size. The one that stays open at last goes
to the nearer whole number, and what that misses is made up by whole kept-back documents, the largest that fits first, so
a source ends within about one of its smallest documents of its target. All draws come from hashes, so reruns and other partitionings agree.

Empty and null texts have size 0 and take no words. Sources without words have target 0. A null source is a source.
Repeated rows are documents of their own. Ids of any type will do, null too. A very long text is one step of its task. An
empty table gives no rows. Other columns may have any names. What the driver holds is one row per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, map_arrow, materialise, mix64, steps, utf8, whole_row

CYCLE, SHARE, LIMIT = (3, 1, 2), 1.5, 2.0
#: Items of a bucket, buckets that meet in a node of the tree, items of a source and size class kept back for the root; sources
#: of a range, as they are numbered.
BUCKET_ROWS, FAN_IN, RESERVED, SOURCE_ROWS = 2_000, 64, 128, 1_000_000


def word_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(len(at) - 1, np.int64)
    space = SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    start[firsts] = ~space[firsts]
    return np.diff(np.concatenate([[0], np.cumsum(start)])[at])


def sized(documents: DataFrame, row: bool = False) -> DataFrame:
    """(doc_id, source, size, text_hash, key) of every row, and the whole `row` if wanted; key: a hash of all that makes an item."""
    columns = [F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text", "source").alias("key")]
    own = documents.select(*columns, *([whole_row(documents).alias("row")] if row else []))
    names = [c for c in own.columns if c != "text"] + ["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            size = pa.array(word_counts(*utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([size if c == "size" else batch.column(c) for c in names], names=names)

    fields = {f.name: f for f in own.schema.fields} | {"size": T.StructField("size", T.LongType())}
    return map_arrow(own, run, T.StructType([fields[c] for c in names]))


def targets(sizes: dict[str | None, int], cycle: tuple = CYCLE, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Words that the mix is to take of each source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, full, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        mass = sum(weight[s] for s in open_)
        out = {s: limit * sizes[s] if s in full else rest * weight[s] / mass for s in names}
        over = [s for s in open_ if out[s] > limit * sizes[s]]
        if not over:
            return out
        full.update(over)


def source_targets(sizes: DataFrame, cycle: tuple = CYCLE, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(of, source_size, target, f) of (source, s): targets() for any number of sources; f is the target over the size.

    Sources are numbered in ranges by code point, null last. Full sources are those below a water level, rest over mass, that
    rises until no more are: each round is one aggregate, and the driver gets three numbers."""
    rows = sizes.count()
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialise(sizes.repartitionByRange(max(1, -(-rows // SOURCE_ROWS)), *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # one row a range
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod("place", F.lit(len(cycle))) + 1).cast("int"))
    known = materialise(ranged.join(starts, "part").withColumn("place", place).select("source", "s", weight.alias("w")))
    room = F.col("s") * limit / F.col("w")
    total, level, full = None, 0.0, -1
    while True:
        under = room < level
        every, inside, n, mass = known.agg(F.sum("s"), F.sum(F.when(under, F.col("s"))), F.count_if(under), F.sum(F.when(~under, F.col("w")))).first()
        total = share * (every or 0)
        if n == full or not mass:
            break
        full, level = n, (total - limit * (inside or 0)) / mass
    target = F.when(room < level, F.col("s") * limit).otherwise(F.col("w") * level)
    return known.select(F.col("source").alias("of"), F.col("s").alias("source_size"), target.alias("target"), F.when(F.col("s") > 0, target / F.col("s")).otherwise(0.0).alias("f"))


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(11)).astype(float) * 2.0**-53


def pivot(weight: list[int], p: list[float], draw: list[float]) -> tuple[list[float], int | None]:
    """Rounded p, and the place of the one that may still be a fraction."""
    p, open_ = list(p), None
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12 or weight[j] == 0:
            p[j] = float(p[j] > 1e-12 and p[j] > draw[j])
            continue
        if open_ is None:
            open_ = j
            continue
        i = open_
        up, down = min((1 - p[i]) * weight[i], p[j] * weight[j]), min(p[i] * weight[i], (1 - p[j]) * weight[j])
        move = up if draw[j] * (up + down) < down else -down
        p[i] += move / weight[i]
        p[j] -= move / weight[j]
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        open_ = next((k for k in (i, j) if 0 < p[k] < 1), None)
    return p, open_


def settle(weight: list[int], p: list[float], open_: int | None) -> list[float]:
    """The last fraction goes to one of its whole numbers, and the words that this misses are made up by whole documents,
    the largest that fits first, each changed once at most. Of the two ways, the one that misses less is taken."""
    if open_ is None:
        return list(p)
    by = sorted((k for k in range(len(p)) if k != open_ and weight[k] > 0), key=lambda k: -weight[k])
    best = None
    for end in (float(round(p[open_])), 1.0 - round(p[open_])):
        q, missing = list(p), (p[open_] - end) * weight[open_]
        q[open_] = end
        for most in (1.0, 2.0):  # what fits whole, then one that goes beyond by less than it mends
            for k in by:
                if weight[k] < most * abs(missing) + 1e-9 * (most < 2) and q[k] == p[k] == float(missing < 0):
                    q[k] = 1.0 - q[k]
                    missing += -weight[k] if q[k] else weight[k]
        if best is None or abs(missing) < best[0]:
            best = abs(missing), q
    return best[1]


_NODE = "bucket long, source string, key long, text_hash long, size long, p double, open boolean"


def _level(rows: DataFrame, salt: int, root: bool = False) -> DataFrame:
    """Pivotal rounding of each (bucket, source), the largest documents first; at the root nothing stays open."""

    def run(table: pa.Table) -> pa.Table:
        d = {n: table.column(n).to_numpy() for n in ("key", "text_hash", "size", "p")}
        by = np.lexsort((d["text_hash"], d["key"], _uniform(d["key"], salt), -d["size"]))
        draw = _uniform(d["key"] ^ d["text_hash"], salt + 1)
        p, open_ = pivot(d["size"][by].tolist(), d["p"][by].tolist(), draw[by].tolist())
        if root:
            p, open_ = settle(d["size"][by].tolist(), p, open_), None
        flag = np.zeros(len(by), bool)
        if open_ is not None:
            flag[open_] = True
        return table.take(pa.array(by)).set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).set_column(table.schema.get_field_index("open"), "open", pa.array(flag))

    return rows.groupBy("bucket", "source").applyInArrow(run, _NODE)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows of items with several copies of which some get one more: numbered through. A task's rows are counted first, so
    no window holds more than one task's rows of an item."""
    placed = materialise(rows.withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("key", "text_hash", "size", "part").agg(F.count("*").alias("c"))
    item = Window.partitionBy("key", "text_hash", "size")
    before = counts.select("key", "text_hash", "size", "part", (F.sum("c").over(item.orderBy("part")) - F.col("c")).alias("before"))
    own = Window.partitionBy("key", "text_hash", "size", "part").orderBy("whole")
    numbered = placed.withColumn("nth", F.row_number().over(own)).join(before, ["key", "text_hash", "size", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def _decided(documents: DataFrame, row: bool, cycle: tuple, share: float, limit: float) -> DataFrame:
    """Every row of sized() with source_size, target and copies."""
    rows = sized(documents, row)
    if not row:
        rows = materialise(rows)  # small, and read twice
    items = rows.groupBy("source", "key", "text_hash", "size").agg(F.count("*").alias("c"))
    items = materialise(items)
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("s"))
    buckets = max(1, -(-items.count() // BUCKET_ROWS))
    of = materialise(source_targets(sizes, cycle, share, limit))  # one row a source; whether it is broadcast is left to Spark
    whole = F.floor(F.col("f") + 1e-12)
    extra = F.col("c") * F.greatest(F.col("f") - whole, F.lit(0.0))  # copies of the item beyond the whole ones
    planned = items.join(of, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "text_hash", "size", "c", extra.alias("extra"))
    sure = F.floor(F.col("extra") + 1e-12)
    planned = planned.select("source", "key", "text_hash", "size", "c", sure.alias("sure"), F.greatest(F.col("extra") - sure, F.lit(0.0)).alias("p"))
    planned = materialise(planned.withColumn("bucket", F.pmod(F.xxhash64("key", "text_hash"), F.lit(buckets))))
    leaf = planned.select("bucket", "source", "key", "text_hash", "size", "p", F.lit(False).alias("open"))
    of_class = Window.partitionBy("source", F.floor(F.log2("size"))).orderBy(F.xxhash64("key", F.lit(5)), "key", "text_hash")
    reserved = leaf.where("size > 0 AND p > 0").withColumn("r", F.row_number().over(of_class)).where(F.col("r") <= RESERVED).drop("r")  # cut before the shuffle
    reserved = materialise(reserved)
    rest = leaf.join(reserved.select("key", "text_hash", "size"), ["key", "text_hash", "size"], "left_anti")
    level = materialise(_level(rest.select(leaf.columns), 11))
    decided, salt = level.where("not open"), 21
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        level = materialise(_level(level.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)), salt))
        decided, salt = decided.unionByName(level.where("not open")), salt + 10
    root = level.where("open").unionByName(reserved).withColumn("bucket", F.lit(0).cast("long"))
    decided = decided.unionByName(_level(root, salt, root=True)).select("key", "text_hash", "size", F.round("p").cast("long").alias("last"))
    known = materialise(planned.join(decided, ["key", "text_hash", "size"]).select("key", "text_hash", "size", "c", (F.col("sure") + F.col("last")).alias("more")))
    own = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).join(known, ["key", "text_hash", "size"]).withColumn("whole", whole.cast("long")).drop("of", "f")
    even = own.where("more = 0 OR more = c").withColumn("copies", F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0))
    if known.where("more > 0 AND more < c").isEmpty():
        return even
    odd = _ranked(own.where("more > 0 AND more < c"))
    return even.unionByName(odd.withColumn("copies", F.col("whole") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)).drop("rank"))


def mix(documents: DataFrame, cycle: tuple = CYCLE, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row."""
    out = _decided(documents, False, cycle, share, limit)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, cycle: tuple = CYCLE, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    out = _decided(documents, True, cycle, share, limit).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
