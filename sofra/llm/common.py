"""Helpers shared by the training-data operators: text buffers, words, folds, scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy step works on; bounds a Python worker's memory. One longer text is a step of its own.
STEP_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session, or an own one where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-sofra-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: later steps don't recompute it, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for made in _MADE:
        made.append(out)
    return out


_MADE: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that materialise() writes within, for drop(): a step that has its result written needs none of the others."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]


def drop(made: list[DataFrame], but: DataFrame) -> None:
    for table in made:
        if table is not but:
            discard(table)


def discard(df: DataFrame | None) -> None:
    """Remove a table of materialise() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(documents: DataFrame) -> Column:
    """All columns as one struct: names that an operator adds beside it can't clash with them."""
    return F.struct(*[named(c) for c in documents.columns])


#: What a null id counts as: the smallest.
NO_ID = -(1 << 63)


def ordered(documents: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns, and `num`: a long for each row's doc_id that orders as the ids do, NO_ID for null. Integral ids are their
    own numbers; the distinct ids of other types are sorted in ranges and numbered range by range."""
    kind = documents.schema["doc_id"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return documents.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("num"))
    ids = documents.select(F.col("doc_id").alias("of")).where("of IS NOT NULL").distinct().orderBy("of")
    ids = materialise(ids.select("of", F.monotonically_increasing_id().alias("num")))
    some = documents.where("doc_id IS NOT NULL")
    known = some.select(F.col("doc_id").alias("of"), F.struct(*columns).alias("own")).join(ids, "of").select("own.*", "num")
    return known.unionByName(documents.where("doc_id IS NULL").select(*columns, F.lit(NO_ID).alias("num")))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets into them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text has about `most` bytes at most; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.split() parts at just these six characters."""
    return text.lower().split()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    raw, at = utf8(batch.column(column))
    whole = raw.tobytes()
    at = at.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(f, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of texts laid end to end, and the n + 1 offsets of each text's words.

    A word's hash is the sum of its bytes' random values times powers of an odd number, then mixed with its length."""
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    space = SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    start[firsts] = ~space[firsts]
    begins = np.flatnonzero(start)
    counts = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(begins, at)))]).astype(np.int64)
    if not len(begins):
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        ends = np.flatnonzero(space)
        stop = np.minimum(np.append(begins[1:], len(raw)), len(raw))
        k = np.searchsorted(ends, begins)
        nearest = np.where(k < len(ends), ends[np.minimum(k, len(ends) - 1)] if len(ends) else len(raw), len(raw))
        stop = np.minimum(stop, nearest)
        long = np.searchsorted(at, begins, side="right")
        stop = np.minimum(stop, at[np.minimum(long, n)])
        size = stop - begins
        values = BYTE_VALUES[raw]
        values[space] = 0
        # position in the word: from the nearest word begin before each byte
        owner = np.cumsum(start) - 1
        place = np.arange(len(raw), dtype=np.int64) - begins[np.maximum(owner, 0)]
        values *= power(int(size.max()))[np.clip(place, 0, int(size.max()) - 1)]
        sums = np.add.reduceat(values, begins)
        return mix64(sums ^ (size.astype(np.uint64) << np.uint64(56)) + np.uint64(0x9E3779B97F4A7C15)), counts


def power(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), 0x5851F42D4C957F2D, np.uint64))
    return _POWERS


_POWERS = np.ones(0, np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit value for each byte; A-Z have those of a-z.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes, and their n + 1 offsets.

    A text with fewer than k words, but at least one, has its whole word sequence as its only shingle."""
    n = len(at) - 1
    count = np.diff(at)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for j in range(1, k):
            rolled[: len(hashes) - j] = mix64(rolled[: len(hashes) - j] * np.uint64(0x9E3779B97F4A7C15) + hashes[j:])
        owner = np.repeat(np.arange(n), count)
        inside = np.arange(len(hashes)) - at[owner] <= count[owner] - k
        short = np.flatnonzero((count < k) & (count > 0))
        for i in short:
            h = np.uint64(0x2545F4914F6CDD1D) + np.uint64(int(count[i]))
            for x in hashes[at[i] : at[i + 1]]:
                h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64))[0]
            rolled[at[i]] = h
            inside[at[i]] = True
    owner, rolled = owner[inside], rolled[inside]
    order = np.lexsort((rolled, owner))
    owner, rolled = owner[order], rolled[order]
    first = np.ones(len(rolled), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (rolled[1:] != rolled[:-1])
    owner, rolled = owner[first], rolled[first]
    return rolled, np.searchsorted(owner, np.arange(n + 1))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet") if "://" not in sf_dir else f"{sf_dir.rstrip('/')}/{table}.parquet")
