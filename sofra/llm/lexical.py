"""Ranked lexical search of many queries at once: TPUT over term-partitioned postings.

The documents are tokenised once, in blocks. A block gives one compact list for each term that a query may have; the lists
of a term over all blocks are its posting list, so a term of every document is many small lists. The lists are dealt and
sorted by (term, block), each by falling impact. All queries are then answered together in the three phases of the
three-phase uniform threshold:

1. the heads of all lists, `k` entries each, give partial scores. The `k` best documents of each query by these are looked
   up exactly; the lowest of their scores is the query's bound;
2. from every list comes what reaches the query's threshold, the same for all its lists. It is the highest one for which a
   document without any such entry stays below the bound: bound / terms, or more where lists end below it. Partial sums with
   the threshold (or a list's best entry, if lower) for what was not fetched are upper bounds; what can't reach the bound goes;
3. exact scores of the documents that remain are looked up in the lists.

Terms are maximal runs of digits, ASCII letters (lower-cased) and characters outside ASCII; a posting's impact and a term's
weight are integers, see impact() and weighted(). Equal lower-cased texts of a block share one entry that counts them all and
keeps their `k` lowest ids, so groups of copies shrink before anything is shuffled; no row is lost for the statistics.

Null and empty texts have no terms and are never found. A very long text is counted whole. Equal scores rank by ascending
doc_id, a null id first. Repeated document rows are documents of their own and take ranks of their own; rows of one item_id
make one query of the union of their terms. Queries without any term in a document give no rows, and so do empty tables.
Other columns are not looked at, whatever their names."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, materialise, steps, texts

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A block ends with so many bytes of text or documents; documents of a block are numbered in 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: Bits of the filter of query terms that tasks get (a false hit is dropped later); terms whose answer a task remembers.
FILTER_BITS, REMEMBERED = 1 << 24, 1 << 20
#: Postings in a partition of the lists, and queries whose wishes for one list travel in one row.
PARTITION_POSTINGS, SLICE = 4 << 20, 1024


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, of `documents` with `total` terms; integers."""
    m = 50 + (50 * n.astype(np.int64) * documents) // total
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def weighted(documents: int, df: Column) -> Column:
    """A term's integer weight by its number of documents."""
    return F.floor(1000 * F.log((2 * documents + 2) / (2 * df + 1))).cast("long")


def query_terms(items: DataFrame) -> DataFrame:
    """(item, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            each = [sorted(set(terms(t))) for t in texts(batch)]
            item = np.repeat(np.arange(batch.num_rows), [len(x) for x in each])
            yield pa.record_batch({"item": batch.column("item").take(pa.array(item)), "term": pa.array([t.decode() for x in each for t in x], pa.string())})

    return map_arrow(items.select("item", "text"), run, "item long, term string").distinct()


def term_filter(asked: DataFrame) -> bytes:
    """One bit for each hash of a query term, FILTER_BITS at most."""
    at = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1).alias("at")
    parts = asked.select("term").distinct().select(at).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out)]
        start = (r["part"] - 1) * 4096
        out[start : start + len(bits)] = bits[: len(out) - start]
    return np.packbits(np.unpackbits(out, bitorder="little")).tobytes()


class Wanted(dict):
    """term -> whether a query may have it."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        at = zlib.crc32(term) % FILTER_BITS
        out = self[term] = bool(self.bits[at >> 3] >> (7 - (at & 7)) & 1)
        return out


class Block:
    """Lists of one block of documents."""

    def __init__(self, number: int, k: int, most: int):
        self.number, self.k, self.most, self.size, self.docs = number, k, most, 0, 0
        self.place: dict[bytes, int] = {}
        self.n, self.ids, self.lists = array("q"), [], {}

    def add(self, doc_id, text: bytes, wanted: Wanted) -> None:
        low = text.lower()
        self.size += len(low)
        self.docs += 1
        key = hashlib.blake2b(low, digest_size=16).digest()
        if (at := self.place.get(key)) is not None:
            self.ids[at].append(doc_id)
            return
        counts = Counter(TERM.findall(low))
        if not counts:
            return
        at = self.place[key] = len(self.ids)
        self.n.append(counts.total())
        self.ids.append([doc_id])
        for term, tf in counts.items():
            if wanted[term]:
                own = self.lists.get(term)
                if own is None:
                    own = self.lists[term] = (array("H"), array("I"))
                own[0].append(at)
                own[1].append(tf)

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or self.docs >= self.most

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n, copies = np.array(self.n, np.int64), np.array([len(x) for x in self.ids], np.int64)
        lowest = [sorted(x, key=lambda i: (i is not None, i))[: self.k] for x in self.ids]
        rows = len(n)
        none = lambda f: pa.nulls(rows, schema.field(f).type)
        yield pa.record_batch([none("term"), pa.array([self.number] * rows, pa.int64()), none("places"), none("tf"), none("sizes"), none("docs"), pa.array(np.arange(rows, dtype=np.int32)), pa.array(n), pa.array(copies), pa.array(lowest, schema.field("ids").type)], schema=schema)
        names = sorted(self.lists)
        for first in range(0, len(names), 4096):
            part = names[first : first + 4096]
            places = [np.array(self.lists[t][0], "<u2") for t in part]
            rows = len(part)
            yield pa.record_batch([pa.array([t.decode() for t in part]), pa.array([self.number] * rows, pa.int64()), pa.array([p.tobytes() for p in places]), pa.array([np.array(self.lists[t][1], "<u4").tobytes() for t in part]),
                                   pa.array([n[p].astype("<u4").tobytes() for p in places]), pa.array([int(copies[p].sum()) for p in places], pa.int64()), none("place"), none("n"), none("copies"), none("ids")], schema=schema)


def index(documents: DataFrame, bits: bytes, k: int, most: int) -> DataFrame:
    """Rows of two kinds. Lists: term, block, places, tf and sizes (little-endian, 16, 32 and 32 bits), docs. Entries of a block,
    where term is null: block, place, n, copies, ids."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes
    ids = T.ArrayType(documents.schema["doc_id"].dataType)
    own = T.StructType().add("term", "string").add("block", "long").add("places", "binary").add("tf", "binary").add("sizes", "binary").add("docs", "long").add("place", "integer").add("n", "long").add("copies", "long").add("ids", ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, wanted = to_arrow_schema(own), Wanted(shared.value)
        number = TaskContext.get().partitionId() << 32
        block = Block(number, k, most)
        for batch in steps(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                block.add(doc_id, text, wanted)
                if block.full():
                    yield from block.batches(schema)
                    number += 1
                    block = Block(number, k, most)
        yield from block.batches(schema)

    return map_arrow(documents.select("doc_id", "text"), run, own)


def postings(lists: DataFrame, known: DataFrame, documents: int, total: int) -> DataFrame:
    """(term, block, places, impacts): the lists of known terms, dealt and sorted by term and block, each by falling impact."""
    own = lists.where("term IS NOT NULL").join(known.select("term"), "term", "left_semi")
    many = lists.where("term IS NOT NULL").agg(F.sum(F.octet_length("places"))).first()[0] or 0
    parts = max(1, -(-many // 2 // PARTITION_POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, impacts = [], []
            for p, tf, n in zip(*(batch.column(c).to_pylist() for c in ("places", "tf", "sizes"))):
                worth = impact(np.frombuffer(tf, "<u4"), np.frombuffer(n, "<u4"), documents, total)
                order = np.argsort(-worth, kind="stable")
                places.append(np.frombuffer(p, "<u2")[order].tobytes())
                impacts.append(worth[order].astype("<u4").tobytes())
            yield pa.record_batch({"term": batch.column("term"), "block": batch.column("block"), "places": pa.array(places, pa.binary()), "impacts": pa.array(impacts, pa.binary())})

    dealt = own.select("term", "block", "places", "tf", "sizes").repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block")
    return map_arrow(dealt, run, "term string, block long, places binary, impacts binary")


def heads(lists: DataFrame, k: int) -> DataFrame:
    """(term, block, place, impact): the `k` best entries of each term. A task merges the lists of a term that it has in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, held = None, (np.zeros(0, np.int64),) * 3

        def out() -> pa.RecordBatch:
            block, place, worth = held
            return pa.record_batch({"term": pa.array([term] * len(block), pa.string()), "block": pa.array(block), "place": pa.array(place.astype(np.int32)), "impact": pa.array(worth)})

        for batch in batches:
            for t, block, places, impacts in zip(*(batch.column(c).to_pylist() for c in ("term", "block", "places", "impacts"))):
                if t != term:
                    if term is not None:
                        yield out()
                    term, held = t, (np.zeros(0, np.int64),) * 3
                place, worth = np.frombuffer(places, "<u2")[:k].astype(np.int64), np.frombuffer(impacts, "<u4")[:k].astype(np.int64)
                merged = [np.concatenate(x) for x in zip(held, (np.full(len(place), block), place, worth))]
                best = np.argsort(-merged[2], kind="stable")[:k]
                held = tuple(x[best] for x in merged)
        if term is not None:
            yield out()

    best = Window.partitionBy("term").orderBy(F.desc("impact"), "block", "place")
    return map_arrow(lists, run, "term string, block long, place int, impact long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def top(scored: DataFrame, k: int, by: str) -> DataFrame:
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by), "block", "place"))).where(F.col("r") <= k)


def lookup(lists: DataFrame, asked: DataFrame, entries: DataFrame, slices: int) -> DataFrame:
    """(item, block, place, score): exact scores of the entries for their queries; asked: (item, term, weight)."""
    each = entries.select("item", "block", "place").join(asked.select("item", "term", "weight"), "item")
    wanted = each.groupBy("term", "block", F.pmod("item", F.lit(slices)).alias("slice")).agg(F.first("weight").alias("weight"), F.collect_list("item").alias("items"), F.collect_list("place").alias("wish"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, (block, places, impacts, weight) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "places", "impacts", "weight")))):
                items, wish = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("items", "wish"))
                have = np.zeros(BLOCK_DOCS, np.int64)
                have[np.frombuffer(places, "<u2")] = np.frombuffer(impacts, "<u4")
                worth = have[wish] * weight
                found = worth > 0
                for column, v in zip(out, (items[found], np.full(int(found.sum()), block), wish[found], worth[found])):
                    column.append(v)
            item, block, place, worth = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.record_batch({"item": pa.array(item.astype(np.int64)), "block": pa.array(block.astype(np.int64)), "place": pa.array(place.astype(np.int32)), "worth": pa.array(worth.astype(np.int64))})

    found = map_arrow(lists.join(wanted, ["term", "block"]).select("block", "places", "impacts", "weight", "items", "wish"), run, "item long, block long, place int, worth long")
    return found.groupBy("item", "block", "place").agg(F.sum("worth").alias("score"))


def thresholds(asked: DataFrame, bounds: DataFrame) -> DataFrame:
    """asked with bound, threshold, most (the highest an unfetched entry of the list may add) and rest (their sum over the query).

    The threshold is 1 more than the highest x with sum(min(list's best, x)) < bound, which is the best of
    (bound - 1 - sum of the j lowest bests) div (terms - j) over all j."""
    lower = Window.partitionBy("item").orderBy("best", "term")
    every = Window.partitionBy("item")
    given = asked.join(bounds, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    given = given.withColumn("before", F.coalesce(F.sum("best").over(lower.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    given = given.withColumn("left", F.count("*").over(every) - F.row_number().over(lower) + 1).withColumn("spare", F.col("bound") - 1 - F.col("before"))
    given = given.withColumn("level", F.when(F.col("spare") >= 0, F.expr("spare div left")).otherwise(0))
    given = given.withColumn("threshold", F.max("level").over(every) + 1)
    given = given.withColumn("most", F.least("best", F.col("threshold") - 1))
    return given.withColumn("rest", F.sum("most").over(every)).drop("before", "left", "spare", "level")


def fetch(lists: DataFrame, given: DataFrame, slices: int) -> DataFrame:
    """(item, block, place, low, high): entries that some list has at or above the query's threshold, and the bounds of their scores."""
    reach = given.where(F.col("best") >= F.col("threshold")).withColumn("limit", F.expr("(threshold + weight - 1) div weight"))
    wish = ("item", "limit", "weight", "most", "rest", "bound")
    wanted = reach.groupBy("term", F.pmod("item", F.lit(slices)).alias("slice")).agg(F.collect_list(F.struct(*wish)).alias("wish"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (block, places, impacts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "places", "impacts")))):
                worth = np.frombuffer(impacts, "<u4").astype(np.int64)
                asked = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(wish, batch.column("wish")[i].values.flatten())}
                many = np.searchsorted(-worth, -asked["limit"], side="right")
                for j in np.flatnonzero(many):
                    rows.append((int(asked["item"][j]), block, places[: 2 * many[j]], impacts[: 4 * many[j]], *(int(asked[c][j]) for c in wish[2:])))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=columns)

    columns = ["item", "block", "places", "impacts", *wish[2:]]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    cuts = map_arrow(lists.join(wanted, "term").select("block", "places", "impacts", "wish"), cut, "item long, block long, places binary, impacts binary, weight long, most long, rest long, bound long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        now = None

        def out() -> pa.RecordBatch:
            item, block, rest, bound = now
            at = np.flatnonzero((low > 0) & (high + rest >= bound))
            return pa.record_batch({"item": pa.array(np.full(len(at), item)), "block": pa.array(np.full(len(at), block)), "place": pa.array(at.astype(np.int32)), "low": pa.array(low[at]), "high": pa.array(high[at] + rest)})

        for batch in batches:
            for item, block, places, impacts, weight, most, rest, bound in zip(*(batch.column(c).to_pylist() for c in columns)):
                if now is None or now[:2] != (item, block):
                    if now is not None:
                        yield out()
                        low[:], high[:] = 0, 0
                    now = (item, block, rest, bound)
                at, worth = np.frombuffer(places, "<u2"), np.frombuffer(impacts, "<u4").astype(np.int64) * weight
                low[at] += worth
                high[at] += worth - most
        if now is not None:
            yield out()

    return map_arrow(cuts.repartition("item", "block").sortWithinPartitions("item", "block"), add, "item long, block long, place int, low long, high long")


def search(documents: DataFrame, items: DataFrame, k: int = 50, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item with a score above 0. block_docs: documents of a block, BLOCK_DOCS at most."""
    kind, of = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    names = materialise(items.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")))
    asked = materialise(query_terms(items.select("item_id", "text").join(names.withColumnRenamed("item_id", "own"), F.col("item_id").eqNullSafe(F.col("own")))))
    slices = max(1, -(-names.count() // SLICE))
    lists = materialise(index(documents, term_filter(asked), k, min(block_docs, BLOCK_DOCS)))
    n, total = lists.where("term IS NULL").agg(F.sum("copies"), F.sum(F.col("copies") * F.col("n"))).first()
    if not n:
        return documents.sparkSession.createDataFrame([], T.StructType().add("item_id", of).add("rank", "integer").add("doc_id", kind).add("score", "long"))
    df = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    known = materialise(df.select("term", weighted(n, F.col("df")).alias("weight")).where("weight > 0"))
    sorted_lists = materialise(postings(lists, known, n, total))
    first = materialise(heads(sorted_lists, k))
    best = first.groupBy("term").agg(F.max("impact").alias("best")).join(known, "term").select("term", "weight", (F.col("best") * F.col("weight")).alias("best"))
    given = materialise(asked.join(best, "term"))
    seen = first.join(given, "term").groupBy("item", "block", "place").agg(F.sum(F.col("impact") * F.col("weight")).alias("low"))
    seeds = lookup(sorted_lists, given, top(seen, k, "low"), slices)
    bounds = top(seeds, k, "score").where(F.col("r") == k).select("item", F.col("score").alias("bound"))
    fetched = materialise(fetch(sorted_lists, thresholds(given, materialise(bounds)), slices))
    second = top(fetched, k, "low").where(F.col("r") == k).select("item", F.col("low").alias("second"))
    open_ = fetched.join(second, "item", "left").where(F.col("second").isNull() | (F.col("high") >= F.col("second")))
    scored = lookup(sorted_lists, given, open_, slices)
    near = scored.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= k)
    entries = lists.where("term IS NULL").select("block", "place", "ids")
    found = near.join(entries, ["block", "place"]).select("item", "score", F.explode("ids").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    ranked = materialise(found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k))
    for table in (lists, sorted_lists, first, fetched):
        discard(table)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
