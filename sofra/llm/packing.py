"""Hierarchical packing of token sequences into windows of several lengths.

Every scan task packs its own documents, a chunk at a time; nothing is shuffled. A document's full windows of the longest
tier stand alone. Its rest goes to the shortest tier that holds it. From the longest tier down, each rest opens a window
of its tier and the gap is filled from shorter tiers: whole rests that fit, the largest first, then one that is cut to
the gap. What a chunk cannot fill goes on to the next chunk; a task's last tokens are cut into windows of powers of two.
So windows are full and need no padding.

Step groups are balanced over all tasks: the windows of each length are numbered through (a count for each task and
length, then running sums of these counts) and dealt to groups of STEP_TOKENS tokens in turn, so all groups of a length
have equal tokens but for the last one. Only piece rows are written for this; texts are read once and not shuffled.

A null text is an empty one, a piece of the end token alone. Repeated rows are packed each, as are rows that share an id.
A very long text fills windows of its own and holds its ids in memory until they are written. An empty table gives no
rows. Ids may have any type; other columns are not looked at, whatever their names. Ids are those of the tokenizer file;
they come from the library that runs the same vocabulary and merges faster (held against the other in the tests)."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialise, steps

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that a task gathers before it packs them; tokens of a step group.
CHUNK_TOKENS, STEP_TOKENS = 1 << 20, 1 << 16


def encoder(path: str):
    """text -> ids, for a byte-level BPE file of the tokenizers library. Texts of its added tokens are these tokens, as there."""
    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.load(open(path, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level BPE: these show themselves, the others follow from 256
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in special}
    made = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode(text, allowed_special="all")


class Packer:
    """Windows of one task. A piece is (document number, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.rests, self.windows = tiers, [], []

    def add(self, doc: int, size: int) -> None:
        top, full = self.tiers[-1], size // self.tiers[-1]
        self.windows += [(top, [(doc, i * top, top)]) for i in range(full)]
        if size % top:
            self.rests.append((size % top, doc, full * top))

    def pack(self, last: bool = False) -> None:
        pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        for rest in self.rests:
            pools[bisect.bisect_left(self.tiers, rest[0])].append(rest)
        for p in pools:
            p.sort()
        self.rests = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            window, pool = self.tiers[tier], pools[tier]
            while pool:
                size, doc, start = pool.pop()
                pieces, gap = [(doc, start, size)], window - size
                while gap:
                    found = self._fit(pools[: tier + 1], gap)
                    if found is None:
                        break
                    size, doc, start = found
                    take = min(size, gap)
                    pieces.append((doc, start, take))
                    gap -= take
                    if take < size:
                        left = (size - take, doc, start + take)
                        bisect.insort(pools[bisect.bisect_left(self.tiers, left[0])], left)
                if gap:
                    self.rests += [(n, d, s) for d, s, n in pieces]
                else:
                    self.windows.append((window, pieces))
        if last:
            self._powers()

    @staticmethod
    def _fit(pools: list[list[tuple[int, int, int]]], gap: int) -> tuple[int, int, int] | None:
        """The largest rest that fits the gap, or the smallest of the longer ones, to be cut."""
        for pool in reversed(pools):
            at = bisect.bisect_right(pool, (gap, float("inf"), 0))
            if at:
                return pool.pop(at - 1)
        for pool in pools:
            if pool:
                return pool.pop(0)
        return None

    def _powers(self) -> None:
        queue, left = list(reversed(self.rests)), sum(n for n, _, _ in self.rests)
        self.rests = []
        while left:
            window = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            pieces, gap = [], window
            while gap:
                size, doc, start = queue.pop()
                take = min(size, gap)
                pieces.append((doc, start, take))
                gap -= take
                if take < size:
                    queue.append((size - take, doc, start + take))
            self.windows.append((window, pieces))
            left -= window


LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "nth")


def pack(documents: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's length) and
    step_group (a number within the tier). tokenizer: path of its file, the same on all executors."""
    if list(tiers) != [tiers[0] << i for i in range(len(tiers))] or tiers[0] & (tiers[0] - 1):
        raise ValueError("tiers are powers of two that follow each other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        packer, live, number, sequence, windows = Packer(tiers), {}, 0, 0, {}
        kind = None

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            for window, pieces in packer.windows:
                nth = windows.get(window, 0)
                windows[window] = nth + 1
                offset = 0
                for doc, start, size in pieces:
                    doc_id, ids = live[doc]
                    rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), (task << 36) + sequence, offset, task, nth, window))
                    offset += size
                sequence += 1
            packer.windows.clear()
            needed = {doc for _, doc, _ in packer.rests}
            for doc in [d for d in live if d not in needed]:
                del live[doc]
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch({"doc_id": pa.array(cols[0], kind)} | {n: pa.array(c, pa.int64()) for n, c in zip(LONGS, cols[1:9])} | {"tier": pa.array(cols[9], pa.int32())})

        gathered = 0
        for batch in steps(batches):
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(encode(text or "") + [END_ID], "<u4")
                live[number] = (doc_id, ids)
                packer.add(number, len(ids))
                number += 1
                gathered += len(ids)
            if gathered >= CHUNK_TOKENS:
                packer.pack()
                yield from emit()
                gathered = 0
        packer.pack(last=True)
        yield from emit()

    fields = [T.StructField("doc_id", documents.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in LONGS], T.StructField("tier", T.IntegerType())]
    pieces = materialise(map_arrow(documents.select("doc_id", "text"), run, T.StructType(fields)))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    counts = pieces.groupBy("tier", "task").agg((F.max("nth") + 1).alias("windows"))
    counts = counts.select("tier", "task", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("before"))
    group = F.floor((F.col("before") + F.col("nth")) * F.col("tier") / STEP_TOKENS).cast("long")
    return pieces.join(counts, ["tier", "task"]).select("doc_id", *LONGS[:6], "tier", group.alias("step_group"))
