"""Removal of repeated passages by deep-shallow sorting: every byte that lies in a `length`-byte string which also starts in
a document with a smaller id goes.

Hashes only choose what meets; what is equal is decided by the sort, on bytes.

1. Each scan task cuts its texts into runs of windows with a common mark (see windows.py) and sends the places of its
   runs, packed by mark bucket. Marks of very many documents, known from a bounded sample, are not gathered.
2. A bucket finds the marks that documents with different ids have. Only their runs are open: their texts are asked.
3. In buckets by document, the slices of the open runs are sorted (deep_shallow.py): of equal slices, one with the
   smallest id goes on, those with a greater id are settled.
4. In buckets by mark, the slices that are left are sorted once more; equal ones are compared by id, and of marks with
   several slices all windows are sorted and compared window by window. A mark with very many runs is dealt out by
   window from step 3 on, so that no mark must fit into one task.
5. The windows found meet their texts again, in the buckets by document, and the bytes they cover are removed.

All buckets hold about BUCKET_BYTES of text, so their number, and that of shuffle partitions, grows with the input and
their size does not. A task sends one row to each bucket it has something for, at most one for each run.

Null and empty texts, and texts shorter than `length`, lose nothing and are not shuffled. A null id counts as the
smallest. Rows with equal ids do not remove each other's bytes. Equal (id, text) rows give equal results and share a
bucket. Ids of any type that sorts will do. A very long text is one step of its task. An empty table gives no rows.
Other columns may have any names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import deep_shallow
from .common import NO_ID, map_arrow, mix64, ordered, steps, utf8, whole_row
from .windows import marks_at, runs

LENGTH = 50
#: Runs that a task gathers before it sends them on; bytes of text in a bucket; runs of a mark beyond which windows are dealt singly.
CHUNK_RUNS, BUCKET_BYTES, HOT_RUNS = 1 << 19, 8 << 20, 2048
#: The sample that finds marks of very many documents: one row in SAMPLE_SHARE, SAMPLE_ROWS at most, a mark counts from
#: SAMPLE_TIMES documents on, and the HOT_MARKS most frequent are kept. It changes the route of these marks, not results.
SAMPLE_SHARE, SAMPLE_ROWS, SAMPLE_TIMES, HOT_MARKS = 50, 200_000, 10, 65_536
ONE, DEALT = 1, 2
_KINDS = [np.dtype(x) for x in ("u1", "<u2", "<u4", "<u8", "<i8")]
_ROWS = "bucket int, target int, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    head = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        head.append(np.array([_KINDS.index(a.dtype), len(a)], "<u4").tobytes())
    return b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unpack(body: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    head = np.frombuffer(body, "<u4", 2 * n, 4).reshape(-1, 2)
    out, at = [], 4 + 8 * n
    for kind, size in head.tolist():
        d = _KINDS[kind]
        out.append(np.frombuffer(body, d, size, at))
        at += size * d.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers, none negative, in the narrowest type."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


class Docs:
    """Keys of documents: the number of the id and, where ids repeat, a hash of the text (else 0)."""

    def __init__(self, num: np.ndarray, tag: np.ndarray):
        self.num, self.tag = num.astype(np.int64), tag.astype(np.int64)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Docs:
        return cls(np.asarray(batch.column("num")), np.asarray(batch.column("tag")))

    def bucket(self, n: int) -> np.ndarray:
        return (mix64(self.num.view(np.uint64) ^ mix64(self.tag.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A))) % np.uint64(n)).astype(np.int64)

    def packed(self, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Arrays for the keys of the rows that `which` names, and each row's place among them."""
        used, local = np.unique(which, return_inverse=True)
        by = np.argsort(self.num[used], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        num, tag = self.num[used[by]], self.tag[used[by]]
        with np.errstate(over="ignore"):
            gaps = np.diff(num.view(np.uint64), prepend=num[:1].view(np.uint64))
        return [num[:1], small(gaps), tag if tag.any() else tag[:0]], small(place[local])

    @staticmethod
    def unpacked(bodies: list[list[np.ndarray]]) -> tuple[Docs, np.ndarray]:
        """The keys of all bodies in a row, and where each body's keys begin."""
        nums, tags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, gaps, tag in (b[:3] for b in bodies):
            with np.errstate(over="ignore"):
                nums.append((np.cumsum(gaps, dtype=np.uint64) + first[:1].view(np.uint64)).view(np.int64))
            tags.append(tag if len(tag) else np.zeros(len(gaps), np.int64))
        return Docs(np.concatenate(nums), np.concatenate(tags)), np.cumsum([0] + [len(x) for x in nums[1:]])


def _column(bodies: list[list[np.ndarray]], j: int, add: np.ndarray | None = None) -> np.ndarray:
    parts = [b[j].astype(np.int64) + (0 if add is None else add[i]) for i, b in enumerate(bodies)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _first(*keys: np.ndarray) -> np.ndarray:
    """In sorted arrays, where a new combination of the keys begins."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _dealt(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket, ascending, the rows that go there, in their order."""
    order = np.argsort(target, kind="stable")
    starts = np.flatnonzero(_first(target[order]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(target[order[a]]), order[a:b]


class Rows:
    """Output of a step: (bucket, target, body). A row with a target is handed on to that document bucket."""

    def __init__(self):
        self.bucket, self.target, self.body = [], [], []

    def add(self, bucket: int, target: int | None, body: bytes) -> None:
        self.bucket.append(bucket)
        self.target.append(target)
        self.body.append(body)

    def batch(self, kind=pa.RecordBatch):
        return kind.from_arrays([pa.array(self.bucket, pa.int32()), pa.array(self.target, pa.int32()), pa.array(self.body, pa.binary())], names=["bucket", "target", "body"])


def mark_bucket(mark: np.ndarray, n: int) -> np.ndarray:
    return (((mark >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def _ask(out: Rows, bucket: int | None, docs: Docs, n_docs: int, doc: np.ndarray, lo: np.ndarray, many: np.ndarray, want: np.ndarray, route: np.ndarray) -> None:
    """Rows that ask the document buckets for the bytes of runs."""
    for target, pick in _dealt(docs.bucket(n_docs)[doc]):
        keys, local = docs.packed(doc[pick])
        row = pack(*keys, local, small(lo[pick]), small(many[pick]), want[pick].astype("u1"), small(route[pick]))
        out.add(target if bucket is None else bucket, None if bucket is None else target, row)


def _marked(texts: DataFrame, n: int, n_docs: int, length: int, hot: np.ndarray) -> DataFrame:
    """Step 1: packed places of the runs of one chunk in one mark bucket; runs with hot marks ask at once, through any bucket."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)  # HOT_MARKS at most

    def emit(parts: list[tuple], docs: Docs, chunk: int) -> pa.RecordBatch:
        doc, lo, many, mark = (np.concatenate(x) for x in zip(*parts))
        out, hot = Rows(), shared.value
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, mark), len(hot) - 1)] == mark
            h = np.flatnonzero(is_hot)
            if len(h):
                _ask(out, (chunk * 7919 + int(docs.num[0] & 0xFFFF)) % n, docs, n_docs, doc[h], lo[h], many[h], np.full(len(h), DEALT), np.zeros(len(h), np.int64))
            doc, lo, many, mark = doc[~is_hot], lo[~is_hot], many[~is_hot], mark[~is_hot]
        bucket, rest = mark_bucket(mark, n), mark & np.uint64(0xFFFFFFFF)
        by = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | rest)
        doc, lo, many, rest, bucket = doc[by], lo[by], many[by], rest[by], bucket[by]
        for b, pick in _dealt(bucket):
            keys, local = docs.packed(doc[pick])
            out.add(b, None, pack(*keys, local, small(lo[pick]), small(many[pick]), rest[pick].astype("<u4")))
        return out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nums, tags, docs, have, chunk = [], [], [], 0, 0, 0
        for batch in steps(batches):
            text, lo, many, mark = runs(*utf8(batch.column("text")), length)
            keys = Docs.of(batch)
            nums.append(keys.num)
            tags.append(keys.tag)
            if len(text):
                parts.append((text + docs, lo, many, mark))
            docs += batch.num_rows
            have += len(text)
            if have >= CHUNK_RUNS:
                yield emit(parts, Docs(np.concatenate(nums), np.concatenate(tags)), chunk)
                parts, nums, tags, docs, have, chunk = [], [], [], 0, 0, chunk + 1
        if have:
            yield emit(parts, Docs(np.concatenate(nums), np.concatenate(tags)), chunk)

    return map_arrow(texts.select("num", "tag", "text"), run, _ROWS)


def _split(table: pa.Table) -> tuple[list[list[np.ndarray]], list[tuple[int, bytes]]]:
    """The bodies for this bucket, and those that are only handed on."""
    own, on = [], []
    for target, body in zip(table.column("target").to_pylist(), table.column("body").to_pylist()):
        own.append(unpack(body)) if target is None else on.append((target, body))
    return own, on


def _opened(marked: DataFrame, n: int, n_docs: int) -> DataFrame:
    """Step 2: asks for the runs whose mark is shared by documents with different ids."""

    def run(table: pa.Table) -> pa.Table:
        own, on = _split(table)
        out = Rows()
        for target, body in on:
            out.add(target, None, body)
        if own:
            docs, start = Docs.unpacked(own)
            doc, lo, many, rest = _column(own, 3, start), _column(own, 4), _column(own, 5), _column(own, 6)
            by = np.argsort(rest, kind="stable")
            lead = _first(rest[by])
            at, of = np.flatnonzero(lead), np.cumsum(lead) - 1
            num = docs.num[doc[by]]
            shared = np.minimum.reduceat(num, at) < np.maximum.reduceat(num, at)
            often = np.diff(np.append(at, len(by))) > HOT_RUNS
            pick = np.flatnonzero(shared[of])
            bucket = table.column("bucket")[0].as_py()
            _ask(out, None, docs, n_docs, doc[by[pick]], lo[by[pick]], many[by[pick]], np.where(often[of[pick]], DEALT, ONE), np.full(len(pick), bucket))
        return out.batch(pa.Table)

    return marked.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, _ROWS)


class Bucket:
    """The texts of a document bucket in one buffer. Rows with equal keys, that is, equal rows, are one document."""

    def __init__(self, left: pa.Table):
        batches = left.combine_chunks().to_batches()
        row = pa.concat_arrays([b.column("row") for b in batches]) if batches else pa.array([], left.schema.field("row").type)
        self.fields = dict(zip([f.name for f in row.type], row.flatten()))
        self.raw, self.at = utf8(self.fields["text"])
        self.docs = Docs(np.asarray(left.column("num")), np.asarray(left.column("tag")))
        self.place: dict[tuple[int, int], int] = {}
        self.one = np.array([self.place.setdefault(k, i) for i, k in enumerate(zip(self.docs.num.tolist(), self.docs.tag.tolist()))], np.int64)

    def find(self, keys: Docs) -> np.ndarray:
        return np.array([self.place[k] for k in zip(keys.num.tolist(), keys.tag.tolist())], np.int64)


def _classes(order: np.ndarray, new: np.ndarray, num: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string its class, and for each class the smallest number, from a sort."""
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, np.minimum.reduceat(num[order], np.flatnonzero(new)) if len(order) else num[:0]


def _window_hash(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    words, out = deep_shallow.words_at(raw), np.zeros(len(at), np.uint64)
    for j in range(0, length, 8):
        out = mix64(out ^ words[at + max(0, min(j, length - 8))].astype(np.uint64))
    return out


def _slices(texts: DataFrame, asks: DataFrame, n: int, n_docs: int, length: int) -> DataFrame:
    """Step 3: the slices that are left of each document bucket, with their bytes, for the mark buckets; what is settled here is handed on."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = Rows()
        if not left.num_rows or not right.num_rows:
            return out.batch(pa.Table)
        here = Bucket(left)
        own = [unpack(x) for x in right.column("body").to_pylist()]
        keys, start = Docs.unpacked(own)
        doc = here.find(keys)[_column(own, 3, start)]
        lo, many, want, route = (_column(own, j) for j in (4, 5, 6, 7))
        place, num = here.at[doc] + lo, here.docs.num[doc]
        order, new = deep_shallow.sort(here.raw, place, many + length - 1, many)
        of, least = _classes(order, new, num)
        gone = num > least[of]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        stay = np.flatnonzero(~gone)
        stay = stay[np.lexsort((rank[stay], doc[stay], of[stay]))]
        lead = _first(of[stay], doc[stay])
        first = stay[lead]
        again, model = stay[~lead], first[np.cumsum(lead) - 1][~lead]
        settled = [(doc[gone], lo[gone], many[gone])]
        same = (doc[again], lo[model], lo[again], many[again])
        # marks of very many runs: windows of the slices that are left
        w = first[want[first] == DEALT]
        first = first[want[first] == ONE]
        items = [(doc[first], lo[first], many[first], np.full(len(first), ONE), route[first], place[first])]
        if len(w):
            of_w, inside = np.repeat(w, many[w]), np.arange(many[w].sum()) - np.repeat(np.cumsum(many[w]) - many[w], many[w])
            at = place[of_w] + inside
            order, new = deep_shallow.sort(here.raw, at, length)
            of, least = _classes(order, new, num[of_w])
            gone = num[of_w] > least[of]
            settled.append((doc[of_w[gone]], lo[of_w[gone]] + inside[gone], np.ones(int(gone.sum()), np.int64)))
            k = order[~gone[order]]
            lead = _first(of[k], doc[of_w[k]])
            again, model = k[~lead], k[lead][np.cumsum(lead) - 1][~lead]
            k = k[lead]
            place_of = lambda i: lo[of_w[i]] + inside[i]
            same = tuple(np.concatenate(x) for x in zip(same, (doc[of_w[again]], place_of(model), place_of(again), np.ones(len(again), np.int64))))
            target = (_window_hash(here.raw, at[k], length) % np.uint64(n)).astype(np.int64)
            items.append((doc[of_w[k]], place_of(k), np.ones(len(k), np.int64), np.full(len(k), DEALT), target, at[k]))
        doc, lo, many, want, route, place = (np.concatenate(x) for x in zip(*items))
        press = zstandard.ZstdCompressor(level=1)
        for bucket, pick in _dealt(route):
            keys, local = here.docs.packed(doc[pick])
            size = many[pick] + length - 1
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            body = here.raw[np.repeat(place[pick], size) + inside]
            out.add(bucket, None, press.compress(pack(*keys, local, small(lo[pick]), small(many[pick]), want[pick].astype("u1"), body)))
        d, a, m = (np.concatenate(x) for x in zip(*settled))
        me = left.column("bucket")[0].as_py()
        if len(d):
            keys, local = here.docs.packed(d)
            out.add(me % n, me, pack(*keys, local, small(a), small(m)))
        if len(same[0]):
            keys, local = here.docs.packed(same[0])
            out.add(me % n, me, pack(*keys, local, *[small(x) for x in same[1:]]))
        return out.batch(pa.Table)

    asks = asks.repartition(n_docs, "bucket")
    return texts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(run, _ROWS)


def _sorted(slices: DataFrame, n: int, n_docs: int, length: int) -> DataFrame:
    """Step 4: window ranges that the sort found in a document with a smaller id, for the document buckets."""

    def run(table: pa.Table) -> pa.Table:
        out, own, press = Rows(), [], zstandard.ZstdDecompressor()
        for target, body in zip(table.column("target").to_pylist(), table.column("body").to_pylist()):
            if target is None:
                own.append(unpack(press.decompress(body)))
            else:
                out.add(target, None, body)
        if not own:
            return out.batch(pa.Table)
        docs, start = Docs.unpacked(own)
        doc, lo, many, want = _column(own, 3, start), _column(own, 4), _column(own, 5), _column(own, 6)
        raw = np.concatenate([b[7] for b in own])
        size, num = many + length - 1, docs.num[doc]
        place = np.cumsum(size) - size
        order, new = deep_shallow.sort(raw, place, size, many)
        of, least = _classes(order, new, num)
        model = order[new]  # a slice of each class
        # marks with several different slices: their windows
        which = np.flatnonzero(want[model] == ONE)
        mark, count = np.unique(marks_at(raw, place[model[which]], length), return_inverse=True, return_counts=True)[1:]
        several = count[mark] > 1
        which, mark = which[several], mark[several]
        wide = np.zeros(len(model), bool)
        wide[which] = True
        where = np.zeros(len(model), np.int64)
        k = many[model[which]]
        where[which] = np.cumsum(k) - k
        inside = np.arange(k.sum()) - np.repeat(where[which], k)
        w_order, w_new = deep_shallow.sort(raw, np.repeat(place[model[which]], k) + inside, length, np.repeat(mark, k))
        w_of, w_least = _classes(w_order, w_new, np.repeat(least[which], k))
        lowest = w_least[w_of]
        plain = np.flatnonzero(~wide[of] & (num > least[of]))
        found = [(doc[plain], lo[plain], many[plain])]
        x = np.flatnonzero(wide[of])
        item = np.repeat(x, many[x])
        inside = np.arange(len(item)) - np.repeat(np.cumsum(many[x]) - many[x], many[x])
        hit = np.flatnonzero(lowest[where[of[item]] + inside] < num[item])
        if len(hit):  # neighbouring windows of a slice become one range
            begin = np.ones(len(hit), bool)
            begin[1:] = (hit[1:] != hit[:-1] + 1) | (item[hit[1:]] != item[hit[:-1]])
            s = np.flatnonzero(begin)
            found.append((doc[item[hit[s]]], lo[item[hit[s]]] + inside[hit[s]], np.diff(np.append(s, len(hit)))))
        doc, lo, many = (np.concatenate(x) for x in zip(*found))
        for target, pick in _dealt(docs.bucket(n_docs)[doc]):
            keys, local = docs.packed(doc[pick])
            out.add(target, None, pack(*keys, local, small(lo[pick]), small(many[pick])))
        return out.batch(pa.Table)

    return slices.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, _ROWS)


def _mask(here: Bucket, right: pa.Table, length: int) -> np.ndarray:
    """Step 5: which bytes of the bucket's buffer go."""
    bodies = [unpack(x) for x in right.column("body").to_pylist()]
    ranges, same = [b for b in bodies if len(b) == 6], [b for b in bodies if len(b) == 7]
    keys, start = Docs.unpacked(ranges)
    doc = here.find(keys)[_column(ranges, 3, start)]
    at, count = here.at[doc] + _column(ranges, 4), _column(ranges, 5)
    if same:  # what was found in a slice holds for the other places of the slice in the same text, too
        by = np.argsort(at, kind="stable")
        at, count = at[by], count[by]
        keys, start = Docs.unpacked(same)
        base = here.at[here.find(keys)[_column(same, 3, start)]]
        model, again, many = base + _column(same, 4), base + _column(same, 5), _column(same, 6)
        a, b = np.searchsorted(at, model), np.searchsorted(at, model + many)
        each = b - a
        pick = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(a, each)
        at, count = np.concatenate([at, at[pick] + np.repeat(again - model, each)]), np.concatenate([count, count[pick]])
    edge = np.bincount(at, minlength=len(here.raw) + 1)[: len(here.raw) + 1] - np.bincount(at + count + length - 1, minlength=len(here.raw) + 1)[: len(here.raw) + 1]
    mask = np.cumsum(edge[:-1]) > 0
    for i in np.flatnonzero(here.one != np.arange(len(here.one))).tolist():
        mask[here.at[i] : here.at[i + 1]] = mask[here.at[here.one[i]] : here.at[here.one[i] + 1]]
    return mask


def _whole_characters(raw: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The removed bytes without those that would leave a part of a character: such characters stay."""
    lead = (raw & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    gone = np.bincount(char, mask) == np.bincount(char)
    return gone[char] if len(raw) else mask


def hot_marks(texts: DataFrame, rows: int, length: int) -> np.ndarray:
    """Marks of very many documents, by the bounded sample."""
    share = max(SAMPLE_SHARE, -(-rows // SAMPLE_ROWS))
    sample = texts.where(F.pmod(F.xxhash64("num", "text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            text, _, _, mark = runs(*utf8(batch.column("text")), length)
            by = np.lexsort((mark, text))
            yield pa.record_batch({"mark": pa.array(mark[by][_first(mark[by], text[by])].view(np.int64))})

    often = map_arrow(sample.select("text"), run, "mark long").groupBy("mark").count().where(F.col("count") >= SAMPLE_TIMES)
    return np.sort(np.array([r["mark"] for r in often.orderBy(F.col("count").desc(), "mark").limit(HOT_MARKS).collect()], np.int64).view(np.uint64))


def _joined(documents: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long texts in document buckets, what was found of them, and the rows with short texts."""
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= length
    total, rows = documents.where(long).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_docs = max(1, -(-int(total) // BUCKET_BYTES), -(-int(rows) // 100_000))
    n = max(n_docs, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = ordered(documents.where(long), [whole_row(documents).alias("row"), F.col("text").alias("text")])
    twice = numbered.groupBy("num").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    texts = numbered.withColumn("tag", F.lit(0).cast("long") if twice else F.xxhash64("text"))
    asks = _opened(_marked(texts, n, n_docs, length, hot_marks(texts, int(rows), length)), n, n_docs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(Docs.of(batch).bucket(n_docs).astype(np.int32))], names=[*batch.schema.names, "bucket"])

    slim = texts.drop("text")
    dealt = map_arrow(slim, place, T.StructType([*slim.schema.fields, T.StructField("bucket", T.IntegerType())])).repartition(n_docs, "bucket")
    found = _sorted(_slices(dealt, asks, n, n_docs, length), n, n_docs, length).repartition(n_docs, "bucket")
    return dealt, found, documents.where(~long)


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    documents = documents.select("doc_id", "text")
    texts, found, short = _joined(documents, length)
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        here = Bucket(left)
        mask = _mask(here, right, length) if right.num_rows else np.zeros(len(here.raw), bool)
        begin = mask.copy()
        begin[1:] &= ~mask[:-1]
        begin[here.at[:-1]] = mask[here.at[:-1]]
        n = np.diff(here.at)
        gone, spans = np.add.reduceat(mask, here.at[:-1], dtype=np.int64), np.add.reduceat(begin, here.at[:-1], dtype=np.int64)
        kept, at = here.raw[~mask].tobytes(), np.concatenate([[0], np.cumsum(n - gone)]).tolist()
        return pa.table([here.fields["doc_id"], pa.array(n), pa.array(gone), pa.array(spans), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:])])], names=schema.names)

    whole = texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, schema)
    text = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    return whole.unionByName(short.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")))


def cleaned(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, with repeated passages cut out of the text; a character that is repeated only in part stays. A null text becomes empty."""
    texts, found, short = _joined(documents, length)
    names = documents.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        here = Bucket(left)
        if right.num_rows:
            mask = _whole_characters(here.raw, _mask(here, right, length))
            kept, size = here.raw[~mask].tobytes(), np.diff(here.at) - np.add.reduceat(mask, here.at[:-1], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(size)]).tolist()
            here.fields["text"] = pa.array([kept[a:b] for a, b in zip(at, at[1:])], pa.binary()).cast(pa.string())
        return pa.table([here.fields[c] for c in names], names=names)

    whole = texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, documents.schema)
    return whole.unionByName(short.withColumn("text", F.coalesce("text", F.lit(""))))
