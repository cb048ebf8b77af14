"""Importance resampling of documents towards a target collection.

Every run of 1 to `grams` words is a feature; its bucket is the crc32 of its UTF-8 bytes modulo `buckets`. The gain of a
bucket is the logarithm of its smoothed share in the target against its share in the documents, in integer thousandths; a
document's weight is the sum of its features' gains, looked up in one array. Its score adds integer Gumbel noise drawn from a
hash of its id, so the highest scores are a sample without replacement by exp(weight).

The draw needs no sort of all rows: a histogram counts each integer score, its counts summed from the highest score down
give the rank that a score's first document has, the lowest score with a rank in the draw is the cutoff, and only rows at or
above it are numbered, by doc_id within each score. The histogram is dealt in ranges of scores, and sums of whole ranges are
added up before the sums within each, so no task sees all of it.

Null and empty texts have no features and weight 0; a null id is hashed as an empty text and comes before others at equal
scores. A very long text is counted whole, word by word. Repeated rows are documents of their own: equal in id and text they
have equal scores and take neighbouring ranks in any order. Empty tables: no documents give no rows, an empty target gains by
smoothing alone. Other columns are not looked at, whatever their names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialise, steps, texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bucket numbers that a task remembers, and distinct scores in a range of the histogram.
REMEMBERED, RANGE_SCORES = 1 << 20, 1 << 20


def words(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters a-z after lower-casing A-Z, and bytes outside ASCII."""
    return WORD.findall(text.lower())


def features(found: list[bytes], grams: int) -> Iterator[bytes]:
    """All runs of 1 to `grams` words, joined by one space, repeats included."""
    yield from found
    for n in range(2, grams + 1):
        for at in range(len(found) - n + 1):
            yield b" ".join(found[at : at + n])


class Buckets(dict):
    """feature -> bucket; forgets all when it holds too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at


def bucket_counts(table: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; one sum a bucket leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in steps(batches):
            seen: Counter = Counter()
            for text in texts(batch):
                seen.update(features(words(text), grams))
            for feature, n in seen.items():
                total[bucket[feature]] += n
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    for bucket, n in map_arrow(table.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The integer gain of each bucket."""
    size, source, target = len(have), int(have.sum()), int(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (source + size) / ((s + 1) * (target + size)))) for s, t in zip(have.tolist(), want.tolist())], np.int64)


def noise(doc_id: str, seed: int) -> int:
    """Integer Gumbel noise of an id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(documents: DataFrame, gain: np.ndarray, grams: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        each, bucket = gain.tolist(), Buckets(len(gain))
        for batch in steps(batches):
            n_words, n_features, weight, score = [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch)):
                found = words(text)
                seen = Counter(features(found, grams))
                n_words.append(len(found))
                n_features.append(seen.total())
                weight.append(sum(n * each[bucket[f]] for f, n in seen.items()))
                score.append(weight[-1] + noise(key, seed))
            columns = {"n_words": n_words, "n_features": n_features, "weight": weight, "score": score}
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {c: pa.array(v, pa.int64()) for c, v in columns.items()})

    own = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]])
    return map_arrow(documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")), run, own)


def offsets(scored: DataFrame, rows: int) -> DataFrame:
    """(score, above): how many rows have a higher score, for each score there is."""
    histogram = scored.groupBy("score").agg(F.count("*").alias("n"))
    parts = max(1, -(-rows // RANGE_SCORES))
    ranged = materialise(histogram.repartitionByRange(parts, F.desc("score")).withColumn("part", F.spark_partition_id()))  # written, so that a range stays what it is
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a range
    higher = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select("part", "score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("inside")).join(whole, "part").select("score", (F.col("start") + F.col("inside")).alias("above"))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored and `rank`: 1, 2, 3... for the drawn share of the rows that have enough words, null for all others."""
    able = F.col("n_words") >= least_words
    rows = scored.where(able).count()
    draw = percent * rows // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return none
    above = materialise(offsets(scored.where(able), rows))
    cutoff = above.where(F.col("above") < draw).agg(F.min("score")).first()[0]
    inside = able & (F.col("score") >= cutoff)
    kept = scored.where(inside).join(above.where(F.col("score") >= cutoff), "score")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first()))
    numbered = kept.withColumn("place", place).select(*scored.columns, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return none.where(~inside).unionByName(numbered)


def resample(documents: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; `percent` of those with `least_words` words or more are drawn."""
    gain = gains(bucket_counts(documents, grams, buckets), bucket_counts(target, grams, buckets))
    return drawn(materialise(scores(documents, gain, grams, seed)), percent, least_words)
