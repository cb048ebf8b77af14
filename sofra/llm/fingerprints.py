"""Homomorphic multiset fingerprints of documents.

A fingerprint is a wide vector: the sum of the vectors of the text's paragraphs (lines). The first EXACT lanes of a
paragraph's vector are 1,024 bits of SHAKE-128 of its bytes, added lane by lane modulo 2**32: equal multisets of
paragraphs have equal sums in any order, others practically never, as no lane follows from another. Beside them, the
other SKETCH lanes add +1 or -1 for each word pair in the paragraph, modulo
2**32: the scalar product of two texts' lanes estimates what they share. Fingerprints of texts can be added and
subtracted, so a paragraph is inserted or deleted without the rest.

The likeness is such an estimate: for texts of many pairs its standard error is about 1 / sqrt(SKETCH), 0.07, and it is
exactly 1 for equal fingerprints.

A null text is an empty one: one empty paragraph. Two texts without word pairs are alike if their exact lanes agree.
Documents follow each other by doc_id, a null id first, and rows of one id by a hash of their texts; after the last comes the
first, and a single document follows itself; repeated rows follow each other. A very long text is a step of its own. An empty table gives no rows. Ids
may have any type that sorts; other columns are not looked at, whatever their names."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sharding
from .common import map_arrow, materialise, mix64, ordered, word_hashes

EXACT, SKETCH = 32, 192
#: Text in a range of ids, and the most ranges there are, however much text; text that one step works on, and that a task holds.
PARTITION_BYTES, RANGES, STEP, HELD = 4 << 20, 16384, 1 << 19, 2 << 20
_WIDE = mix64(np.arange(8001, 8001 + SKETCH // 64, dtype=np.uint64))


def paragraph(line: bytes) -> bytes:
    """The exact lanes of one paragraph, 32 bits each."""
    return hashlib.shake_128(line).digest(4 * EXACT)


def vectors(docs: list[bytes]) -> np.ndarray:
    """The fingerprint vector of each text, one row each."""
    out = np.zeros((len(docs), EXACT + SKETCH), np.uint32)
    start = 0
    while start < len(docs):
        stop, size = start, 0
        while stop < len(docs) and (stop == start or size + len(docs[stop]) <= STEP):
            size += len(docs[stop])
            stop += 1
        out[start:stop] = _vectors(docs[start:stop])
        start = stop
    return out


def _vectors(docs: list[bytes]) -> np.ndarray:
    n = len(docs)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    raw = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)  # every text ends with a line end, and so does every line
    at = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.flatnonzero(raw == 10)
    line_doc = np.searchsorted(at, ends, side="right") - 1
    out = np.zeros((n, EXACT + SKETCH), np.uint32)
    lanes = np.frombuffer(b"".join([paragraph(line) for d in docs for line in d.split(b"\n")]), "<u4").reshape(-1, EXACT)
    first = np.searchsorted(line_doc, np.arange(n))
    with np.errstate(over="ignore"):
        out[:, :EXACT] = np.add.reduceat(lanes, first, axis=0, dtype=np.uint32)
        words, per_line = word_hashes(raw, np.concatenate([[0], ends + 1]))
        count = np.diff(per_line)
        if len(words):
            line = np.repeat(np.arange(len(ends)), count)
            pair = words.copy()
            pair[:-1] = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
            last = per_line[1:][count > 0] - 1
            keep = np.ones(len(words), bool)
            keep[last] = count[count > 0] == 1  # a line of one word has it as its only unit
            pair[last] = words[last]
            pair, owner = pair[keep], line_doc[line[keep]]
            begins = np.searchsorted(owner, np.arange(n))
            have = np.flatnonzero(np.diff(np.append(begins, len(owner))))
            total = np.diff(np.append(begins, len(owner)))[have]
            for j in range(SKETCH // 64):
                bits = np.unpackbits(mix64(pair ^ _WIDE[j]).view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, begins[have], axis=0, dtype=np.int32)
                out[have, EXACT + 64 * j : EXACT + 64 * (j + 1)] = (2 * ones - total[:, None].astype(np.int32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of word pairs in common, rows against rows: 1 for equal sketches, 0 for nothing shared."""
    x, y = a[:, EXACT:].view(np.int32).astype(float), b[:, EXACT:].view(np.int32).astype(float)
    both = (x * x).sum(1) + (y * y).sum(1)
    same = (a == b).all(1)
    return np.where(same, 1.0, np.where(both > 0, np.clip(2 * (x * y).sum(1) / np.maximum(both, 1e-9), 0, 1), 0.0))


def encoded(v: np.ndarray) -> str:
    """A vector as text: the exact lanes, then the sketch lanes, in 16 bits each if all fit (s) or in 32 (l)."""
    sketch = v[EXACT:].view(np.int32)
    short = np.abs(sketch.astype(np.int64)).max() < 1 << 15
    body = v[:EXACT].astype("<u4").tobytes() + (sketch.astype("<i2") if short else sketch.astype("<i4")).tobytes()
    return ("s" if short else "l") + base64.b64encode(body).decode()


def decoded(text: str) -> np.ndarray:
    body = base64.b64decode(text[1:])
    sketch = np.frombuffer(body[4 * EXACT :], "<i2" if text[0] == "s" else "<i4").astype(np.int32)
    return np.concatenate([np.frombuffer(body[: 4 * EXACT], "<u4"), sketch.view(np.uint32)])


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of both texts, or (sign -1) of the first without those of the second."""
    with np.errstate(over="ignore"):
        x, y = decoded(a), decoded(b)
        return encoded(x + y if sign > 0 else x - y)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: pa.Array, docs: list[str], nexts: list[str], mine: np.ndarray, theirs: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(docs, nexts)]
    after = vectors([c.encode() for c in changed])
    return pa.record_batch({
        "doc_id": ids, "n_chars": pa.array([len(d) for d in docs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
        "fingerprint": pa.array([encoded(v) for v in mine]), "edited_fingerprint": pa.array([encoded(v) for v in after]),
        "near_edited": pa.array(likeness(mine, after)), "near_next": pa.array(likeness(mine, theirs)),
    })


def _ends(keyed: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of the last document of each range, with the first text of the range that follows."""
    key = F.struct("h", "id")
    ends = keyed.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))  # one row a range
    along = Window.orderBy("part")
    ends = materialise(ends.withColumn("following", F.coalesce(F.lead("first").over(along), F.min("first").over(Window.partitionBy()))))
    wanted = ends.select("last.*").unionByName(ends.select("following.*")).distinct()
    rows = keyed.join(F.broadcast(wanted), ["h", "id"]).groupBy("h", "id").agg(F.min(F.struct("text", "doc_id")).alias("row"))  # two keys a range, RANGES ranges at most
    rows = materialise(rows.select(key.alias("key"), "row.*"))
    last = ends.select("last", "following").join(rows.withColumnRenamed("key", "last"), "last")
    return last.select("doc_id", "text", "following").join(rows.select(F.col("key").alias("following"), F.col("text").alias("next_text")), "following").select("doc_id", "text", "next_text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ranges of (id, hash of the text) are cut at splitters of a sample, so that a row's range follows from the row alone, and the
    texts are dealt once by range. A task streams its ranges in order; each document but a range's last one has its next one
    beside it. The last ones are paired with the first ones of the ranges that follow, found by their keys."""
    keyed = ordered(documents, [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")])
    keyed = keyed.select("doc_id", "text", F.col("num").alias("h"), F.xxhash64("text").alias("id"), F.lit(0).cast("long").alias("u"), (F.octet_length("text") + 1).cast("long").alias("size"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(RANGES, -(-total // PARTITION_BYTES)))
    splitters = sharding.sampled_splitters(keyed, sharding.SAMPLED * parts, total, parts, 3) if parts > 1 else []
    keyed = keyed.withColumn("part", sharding.range_of(splitters))
    strings = ("edited_sha256", "fingerprint", "edited_fingerprint")
    fields = [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in strings]]
    schema = T.StructType([*fields, T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (part, doc_id, text), the first one without its row yet
        size = 0

        def flush(kind) -> Iterator[pa.RecordBatch]:
            v = vectors([t.encode() for _, _, t in held])
            at = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0]]
            if at:
                after = [i + 1 for i in at]
                yield _rows(pa.array([held[i][1] for i in at], kind), [held[i][2] for i in at], [held[i][2] for i in after], v[at], v[after])

        for batch in batches:
            kind = batch.column("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                held.append(row)
                size += len(row[2])
                if size > HELD:
                    yield from flush(kind)
                    held, size = held[-1:], len(held[-1][2])
        if held:
            yield from flush(kind)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                a, b = row.column("text")[0].as_py(), row.column("next_text")[0].as_py()
                v = vectors([a.encode(), b.encode()])
                yield _rows(row.column("doc_id"), [a], [b], v[:1], v[1:])

    dealt = keyed.select("part", "doc_id", "text", "h", "id").repartition(parts, "part").sortWithinPartitions("part", "h", "id", "text")
    return map_arrow(dealt.select("part", "doc_id", "text"), inner, schema).unionByName(map_arrow(_ends(keyed), outer, schema))
