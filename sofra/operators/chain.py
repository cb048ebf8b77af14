"""Tamper-evident hash chains over daily records.

A link is sha256("date:key...:ids:previous"), where previous is the link before in the same chain, or GENESIS. The chain
is a sequential fold: a chain's records are dealt to one task, sorted and streamed with the previous link in memory, so
chains may be of any length. Ties of the order are broken by the payload and the other columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS, EMPTY = "GENESIS", "GENESIS_STATE"
#: Bytes of heads that are hashed at once.
BLOCK_BYTES = 1 << 20


def links(records: DataFrame, keys: list[str], order: list[str], payload: str, out: str = "hash") -> DataFrame:
    """records with the recomputed link and the expected previous one (null for the first). payload: the text before the last colon."""
    names = [*keys, *order, payload, *[c for c in records.columns if c not in {*keys, *order, payload}]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            made, before = [], []
            # a NaN is the same key as another
            ids = zip(*[["NaN" if x != x else (x,) for x in batch.column(c).to_pylist()] for c in keys])
            for key, text in zip(ids, batch.column("__text").to_pylist()):
                before.append(last if key == now else None)
                last = last if key == now else GENESIS
                # a link on an unknown payload or link is unknown
                last = None if text is None or last is None else hashlib.sha256(text + b":" + last.encode()).hexdigest()
                now = key
                made.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(made, pa.string()), pa.array(before, pa.string())], [*names, out, f"previous_{out}"])

    kinds = StructType([*[StructField(c, records.schema[c].dataType) for c in names], StructField(out, StringType()), StructField(f"previous_{out}", StringType())])
    return records.select(*names, F.col(payload).cast("binary").alias("__text")).repartition(*keys).sortWithinPartitions(*names).mapInArrow(run, kinds)


def verify(records: DataFrame, keys: list[str], order: list[str], payload: str, stored: str, stored_previous: str) -> DataFrame:
    """records with is_corrupted: the stored link or its stored predecessor differs from the recomputed ones. One change
    breaks its own link; all later ones differ as well, as they build on the recomputed predecessor only if theirs was
    stored from the changed one."""
    made = links(records, keys, order, payload, "expected")
    bad = F.coalesce(F.col(stored) != F.col("expected"), F.lit(True)) | ~F.col(stored_previous).eqNullSafe(F.col("previous_expected"))
    return made.withColumn("is_corrupted", bad)


def fingerprint(heads: DataFrame, column: str) -> DataFrame:
    """One row: the hash of all known heads in order, or EMPTY. Heads are one per chain.

    Heads are dealt by their first two characters, sorted, and joined to blocks; one task streams the blocks in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for start, head in zip(batch.column("start").to_pylist(), batch.column("head").to_pylist()):
                if parts and (start != now or size >= BLOCK_BYTES):
                    yield block(parts)
                    parts, size = [], 0
                now = start
                parts.append(head)
                size += len(head) + 1
        if parts:
            yield block(parts)

    def block(parts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch({"low": pa.array([parts[0]], pa.binary()), "high": pa.array([parts[-1]], pa.binary()), "block": pa.array([b":".join(parts)], pa.binary())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, some = hashlib.sha256(), False
        for batch in batches:
            for part in batch.column("block"):
                made.update(b":" + part.as_py() if some else part.as_py())
                some = True
        if some:
            yield pa.record_batch({"fingerprint": pa.array([made.hexdigest()], pa.string())})

    known = heads.where(F.col(column).isNotNull()).select(F.substring(column, 1, 2).alias("start"), F.col(column).cast("binary").alias("head"))
    blocks = known.repartition("start").sortWithinPartitions("head").mapInArrow(join, "low binary, high binary, block binary")
    whole = blocks.repartition(1).sortWithinPartitions("low", "high").mapInArrow(digest, "fingerprint string")
    return whole.agg(F.coalesce(F.max("fingerprint"), F.lit(EMPTY)).alias("fingerprint"))


def heads(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def menu_payload(date: str, city: str, meal: str, ids: str):
    """The text of a menu's record: date, city, meal and dish ids joined by commas."""
    return F.concat_ws(":", F.date_format(date, "yyyy-MM-dd"), F.col(city).cast("string"), F.col(meal), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
