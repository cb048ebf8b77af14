"""Near-duplicate components by a chosen-path similarity join on word shingles.

Documents with equal shingle sets are one node of the join from the start. Each of several independent trees branches the
documents by one minwise token of their sets, level by level. A tree node with few members is compared exhaustively and
ends there. A large one branches on: by its own path it draws BRANCHES of the tree's OWN further tokens and sends every
member down each of them. A pair of similarity J follows a token together with probability J, so with BRANCHES * J well
over 1 the share of pairs that a large node loses stays bounded however deep the recursion goes; the number of trees
follows from that share and from the wanted miss probability (see plan()). So depth adapts to the data: rare tokens end at
the first level.

Nodes of a bounded number of members branch within the task they are dealt to, all levels in one shuffle; larger ones, few
by their size, are split over tasks and branch level by level, until their parts are bounded.

A large node in which all members resemble its leader, or nearly all some levels down, is a cluster of near copies and
branches no further; neither does a node at the last level. Their members are compared with the leader, those unlike it
with a second leader, which each path draws anew; what is linked then is one component, and a node within one component is
done. In the others, members outside the largest component are compared with some of it. What is still apart after that,
such as documents around one common passage, is joined by their rarest shingles: two sets of similarity J share one of the
rarest (1 - J) part of their shingles, and what a pair can still share from there on is known from the places of that
shingle in both. All comparisons start with 128 one-bit minhash samples, natively, with six standard deviations to spare
(a true pair fails with probability 1e-9); what passes is confirmed on full sets. No comparison is made within a
component, so nothing grows with the square of a group of copies.

Documents without words have empty sets and no links; null texts are empty. A document is a distinct pair of id and text,
and its node in the join is a hash of both, so rows that share an id, or have none, are linked by their texts only. A
component is named after its smallest id, where a null counts as the smallest; its first document has that id and, of
several such, the smallest hash. Equal rows give equal results. Ids of any type that sorts will do; other columns may have
any names. A very long text is one step of its task. An empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, map_arrow, materialise, mix64, scratch, shingle_hashes, steps, utf8, whole_row, word_hashes
from .components import components

#: Minwise tokens of a set; further tokens of a tree, of which its nodes draw, at most; levels of a tree for up to a million
#: sets, and one more for each fifty times as many; branches of a large node; probability to miss a pair.
TOKENS, OWN, DEPTH, BRANCHES, MISS = 128, 8, 4, 2, 1e-7
#: A large node from this level on, in which this share resembles the leader, is a cluster.
CLUSTER_LEVEL, CLUSTER_SHARE = 3, 0.8
#: Members up to which a tree node is compared exhaustively; members up to which it branches within one task; rows that a task
#: works on at once.
SMALL, ROOM, STEP_ROWS = 16, 4096, 1 << 16
#: Members of a node's largest component that each of its others is compared with before the rarest shingles are; ratio of the
#: sizes of sets in one band of the join on these.
DRAWN, BAND = 4, 1.05
#: Bits of the filter that tells which texts a step may need; it spares shuffles, and decides nothing.
FILTER_BITS = 1 << 24
_MULT = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = mix64(np.arange(1001, TOKENS + 1001, dtype=np.uint64))


def plan(similarity: float, depth: int = DEPTH, miss: float = MISS) -> tuple[int, int]:
    """(trees, further tokens of each): so many trees that a pair of the similarity that stays in large nodes to the last
    level is missed with the probability; pairs that end in small nodes before are missed less often."""
    if not 0.5 < similarity <= 1:
        raise ValueError("two branches keep pairs of a similarity over 0.5")
    kept = 1.0  # probability that a pair in a node is compared below it
    for _ in range(depth - 1):
        kept = 1 - (1 - similarity * kept) ** BRANCHES
    trees = math.ceil(math.log(miss) / math.log(max(1e-12, 1 - similarity * kept)))
    own = min(OWN, TOKENS // trees - 1)
    if own < BRANCHES:
        raise ValueError("more tokens are needed for this similarity")
    return trees, own


def minwise(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 minwise values of each non-empty set (rows), from its 64-bit members."""
    out = np.empty((len(at) - 1, len(_MULT)), np.uint64)
    with np.errstate(over="ignore"):
        for j, (m, s) in enumerate(zip(_MULT, _SALT)):
            v = (sets ^ s) * m
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, j] = np.minimum.reduceat(v, at[:-1])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def node() -> Column:
    """The hash of a row's id and text."""
    return F.xxhash64("doc_id", "text")


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, id, n, digest, tokens, lo, hi): each row's node, the size and digest of its set, the set's minwise tokens, its one-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))), k)
            n = np.diff(at)
            some = np.flatnonzero(n)
            tokens = np.zeros((len(n), TOKENS), np.int32)
            lo, hi = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                v = mix64(minwise(sets, np.append(at[:-1][some], len(sets))))
                tokens[some] = (v >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bit = (v & np.uint64(1)) << (np.arange(TOKENS, dtype=np.uint64) % np.uint64(64))
                lo[some], hi[some] = np.bitwise_or.reduce(bit[:, :64], 1), np.bitwise_or.reduce(bit[:, 64:], 1)
            whole = sets.tobytes()
            digest = [hashlib.blake2b(whole[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TOKENS), pa.array(tokens.reshape(-1)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "id": batch.column("id"), "n": pa.array(n.astype(np.int64)), "digest": pa.array(digest, pa.binary()), "tokens": listed, "lo": _signed(lo), "hi": _signed(hi)})

    own = [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    own += [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]
    return map_arrow(documents.select("doc_id", "text", node().alias("id")), run, T.StructType(own))


def _may(similarity: float, y: str = "y") -> Column:
    """Whether rows x and y can have the similarity: by size, and by one-bit samples with six standard deviations to spare."""
    agree = (1 + similarity) / 2
    spare = 6 * (agree * (1 - agree) / TOKENS) ** 0.5
    differ = F.bit_count(F.col("x.lo").bitwiseXOR(F.col(f"{y}.lo"))) + F.bit_count(F.col("x.hi").bitwiseXOR(F.col(f"{y}.hi")))
    return (F.least("x.n", f"{y}.n") >= similarity * F.greatest("x.n", f"{y}.n") - 1e-9) & (differ <= int(TOKENS * (1 - agree + spare)))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def flagged(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows, and `may`: whether the column's value may be among the ids; never wrong about those that are, and about few others
    while the ids are fewer than FILTER_BITS. There is one bit for each id's last bits; every task gets all bits."""
    at = lambda c: F.pmod(F.col(c), F.lit(FILTER_BITS)) + 1
    named = ids.select(at(ids.columns[0]).alias("at"))
    bits = materialise(named.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))  # FILTER_BITS / 8 bytes
    place = F.bitmap_bit_position(at(column)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = rows.join(F.broadcast(bits), F.bitmap_bucket_number(at(column)) == F.col("part"), "left")
    return both.select(*rows.columns, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False)).alias("may"))


def shingle_sets(documents: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(id, s): the sets of the needed ids, and of a few others, six bytes a member. Texts stay in the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets, at = shingle_hashes(*word_hashes(*utf8(batch.column("text"))), k)
            blobs = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                s = np.unique(sets[a:b] >> np.uint64(16))
                blobs.append((s >> np.uint64(16)).astype("<u4").tobytes() + (s & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.record_batch({"id": batch.column("id"), "s": pa.array(blobs, pa.binary())})

    return map_arrow(flagged(documents.select(node().alias("id"), "text"), "id", needed).where("may").select("id", "text"), run, "id long, s binary")


def members(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return (np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(blob, "<u2", n, 4 * n)


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs whose full sets are as similar as that."""
    num = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                p, q = members(x), members(y)
                inter = np.searchsorted(q, p)
                inter = int((q[np.minimum(inter, len(q) - 1)] == p).sum())
                keep.append(100 * inter >= num * (len(p) + len(q) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    return map_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long")


def rarest(sets: DataFrame, ids: DataFrame, similarity: float) -> DataFrame:
    """(id, token, place, m) of the rarest (1 - similarity) part of the sets of the ids, and one more; place counts from 1
    in the order of rarity among these sets, m is the set's size. Tokens of one set only are counted, not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for batch in batches:
            for i, blob in zip(batch.column("id").to_pylist(), batch.column("s").to_pylist()):
                ids.append(i)
                parts.append(members(blob).view(np.int64))
                size += len(parts[-1])
                if size >= 1 << 18:
                    yield pack(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield pack(ids, parts)

    def pack(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        m = np.array([len(x) for x in parts])
        return pa.record_batch({"id": pa.array(np.repeat(np.array(ids, np.int64), m)), "m": pa.array(np.repeat(m, m)), "token": pa.array(np.concatenate(parts))})

    tokens = materialise(map_arrow(sets.join(ids.select("id").distinct(), "id", "left_semi").select("id", "s"), run, "id long, m long, token long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    per = Window.partitionBy("id")
    placed = tokens.join(often, "token").withColumn("place", F.col("m") - F.count("*").over(per) + F.row_number().over(per.orderBy("df", "token")))
    return placed.where(F.col("place") <= F.col("m") - F.ceil(F.col("m") * round(100 * similarity) / 100) + 1).select("id", "token", "place", "m")


def rare_pairs(near: DataFrame, similarity: float) -> DataFrame:
    """(a, b): ids of different components, one of them `minor`, that share a rare token and can be as similar as that by what
    is left of both sets from the token on.

    The smaller set of a pair has a largest partner: with `left` of its m members from the token on, one of
    left * (1 + similarity) / similarity - m members. So sizes are part of the key: the smaller set goes to the bands of sizes
    from its own to that one, the larger one to its band. Where the largest partner would be smaller than the set itself, as
    for documents with much of their own beside a common passage, it goes nowhere, however many share the token."""
    num = round(100 * similarity)
    band = lambda m: F.floor(F.log(m.cast("double")) / math.log(BAND)).cast("int")
    left = F.col("m") - F.col("place") + 1
    most = F.expr(f"((m - place + 1) * {100 + num}) div {num}") - F.col("m")
    rows = near.withColumn("left", left).withColumn("most", most)
    small = rows.where(F.col("most") >= F.col("m")).withColumn("band", F.explode(F.sequence(band(F.col("m")), band(F.col("most")))))
    large = rows.withColumn("band", band(F.col("m")))
    order = (F.col("x.m") < F.col("y.m")) | ((F.col("x.m") == F.col("y.m")) & (F.col("x.id") < F.col("y.id")))
    can = F.least("x.left", "y.left") * (100 + num) >= num * (F.col("x.m") + F.col("y.m"))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & order & can & (F.col("x.comp") != F.col("y.comp")) & _may(similarity)
    found = [x.alias("x").join(y.alias("y"), on).select(*_pair("x.id", "y.id")) for x, y in ((small.where("minor"), large), (small.where("NOT minor"), large.where("minor")))]
    return found[0].unionByName(found[1]).distinct()


def alike(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """_may() for the rows numbered x and y."""
    agree = (1 + similarity) / 2
    spare = 6 * (agree * (1 - agree) / TOKENS) ** 0.5
    out = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
    differ = np.bitwise_count(lo[x] ^ lo[y]).astype(np.int16) + np.bitwise_count(hi[x] ^ hi[y])
    return out & (differ <= int(TOKENS * (1 - agree + spare)))


def _starts(sorted_paths: np.ndarray) -> np.ndarray:
    """The first place of each run of equal paths, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_paths[1:] != sorted_paths[:-1])), len(sorted_paths))


def branch_out(path: np.ndarray, own: dict[str, np.ndarray], t: np.ndarray, level: int, depth: int, similarity: float, small: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Whole tree nodes, from their level down to the last: the pairs of ids that small nodes below them find, and the members
    of the large ones that end, as grown() has them. All nodes of a level are worked on together."""
    ids, n, lo, hi = (own[c] for c in ("id", "n", "lo", "hi"))
    row = np.arange(len(ids))
    pairs, many = [np.zeros((0, 2), np.int64)], []
    while level <= depth and len(row):
        order = np.lexsort((ids[row], path))
        row, path = row[order], path[order]
        at = _starts(path)
        size = np.repeat(np.diff(at), np.diff(at))
        keep = (size > 1) & (size <= small)
        few, key = row[keep], path[keep]
        for d in range(1, min(small, len(few))):
            same = np.flatnonzero(key[d:] == key[:-d])
            x, y = few[same], few[same + d]
            ok = alike(n, lo, hi, x, y, similarity)
            pairs.append(np.stack([ids[x[ok]], ids[y[ok]]], 1))
        row, path = row[size > small], path[size > small]
        if not len(row):
            break
        at = _starts(path)
        runs = np.diff(at)
        drawn = np.lexsort((mix64(path ^ mix64(ids[row].view(np.uint64))), path))
        y, z = np.repeat(row[at[:-1]], runs), np.repeat(row[drawn][at[:-1]], runs)
        near, near_z = ((row == l) | alike(n, lo, hi, row, l, similarity) for l in (y, z))
        share = np.maximum(np.add.reduceat(near.astype(np.int64), at[:-1]), np.add.reduceat(near_z.astype(np.int64), at[:-1])) / runs
        ended = np.repeat((share == 1) | (level == depth) | ((share >= CLUSTER_SHARE) & (level >= CLUSTER_LEVEL)), runs)
        e = row[ended]
        many.append({"path": path[ended].view(np.int64), "id": ids[e], "n": n[e], "lo": lo[e].view(np.int64), "hi": hi[e].view(np.int64), "y": ids[y[ended]], "z": ids[z[ended]], "near": near[ended], "near_z": near_z[ended]})
        row, path = row[~ended], path[~ended]
        width = np.uint64(t.shape[1])
        first = mix64(path) % width
        second = (first + np.uint64(1) + mix64(path ^ np.uint64(1)) % (width - np.uint64(1))) % width  # another one
        below = [mix64(mix64(path + np.uint64(b)) ^ t[row, k.astype(np.int64)].astype(np.uint64)) for b, k in ((1, first), (2, second))]
        row, path = np.concatenate([row, row]), np.concatenate(below)
        level += 1
    found = np.unique(np.concatenate(pairs), axis=0)
    return found, {c: np.concatenate([m[c] for m in many]) for c in many[0]} if many else {}


ENDS = "path long, id long, n long, lo long, hi long, y long, z long, near boolean, near_z boolean"


def bounded_nodes(live: DataFrame, level: int, depth: int, similarity: float, small: int) -> DataFrame:
    """What the nodes of `live` come to, none of which has over ROOM members: each is in one task, at most STEP_ROWS rows and
    one node at a time. Rows as grown() gives them for ended nodes; a pair has no path, its ids are `id` and `y`."""

    def flush(b: pa.Table) -> pa.RecordBatch:
        column = lambda c: b.column(c).to_numpy()
        own = {"id": column("id"), "n": column("n"), "lo": column("lo").view(np.uint64), "hi": column("hi").view(np.uint64)}
        t = b.column("t").combine_chunks().flatten().to_numpy().reshape(b.num_rows, -1)
        found, many = branch_out(column("path").view(np.uint64), own, t, level, depth, similarity, small)
        k, total = len(found), len(found) + (len(many["path"]) if many else 0)
        out = {}
        for field in schema:
            flag = pa.types.is_boolean(field.type)
            values = np.zeros(total, bool if flag else np.int64)
            if many:
                values[k:] = many[field.name]
            if k and field.name in ("id", "y"):
                values[:k] = found[:, 0 if field.name == "id" else 1]
            out[field.name] = pa.array(values, field.type, mask=np.arange(total) < k if field.name == "path" else None)
        return pa.record_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= STEP_ROWS:
                table = pa.Table.from_batches(held)
                path = table.column("path").to_numpy()
                whole = int(np.flatnonzero(path != path[-1])[-1]) + 1 if path[0] != path[-1] else 0  # the last node may go on
                if whole:
                    yield flush(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield flush(pa.Table.from_batches(held))

    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in ENDS.split(", ")])
    return map_arrow(live.repartition("path").sortWithinPartitions("path").select("path", "id", "n", "lo", "hi", "t"), run, ENDS)


def grown(nodes: DataFrame, similarity: float, small: int, depth: int = DEPTH, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """The trees over (id, n, lo, hi, tokens): the pairs (a, b) of the small nodes at which they end, and the members
    (path, id, n, lo, hi) of those large ones that branch no further, with the ids of their leaders `y` and `z` and whether
    they may resemble each (`near`, `near_z`). The leader y is the smallest node, often the same one in several trees; z is
    drawn by path. A node of up to `room` members branches in one task; one of more is split over tasks, level by level."""
    trees, own = plan(similarity, depth)
    ends, many = [], []
    # the tree's first token is its root's; its others stay with the row
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("tokens", t * (own + 1) + 1, own + 1))).alias("tree", "t")
    live = nodes.select("id", "n", "lo", "hi", each).select("id", "n", "lo", "hi", F.slice("t", 2, own).alias("t"), F.xxhash64("tree", F.col("t")[0]).alias("path"))
    for level in range(1, depth + 1):
        hot = materialise(live.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > room).select("path"))
        if hot.isEmpty():
            ends.append(bounded_nodes(live, level, depth, similarity, small))
            break
        ends.append(bounded_nodes(live.join(hot, "path", "left_anti"), level, depth, similarity, small))
        large = materialise(live.join(hot, "path", "left_semi"))
        who = F.struct("id", "n", "lo", "hi")
        leaders = materialise(large.groupBy("path").agg(F.min(who).alias("y"), F.min_by(who, F.struct(F.xxhash64("path", "id"), "id")).alias("z")))
        x = large.join(leaders, "path").select("path", F.struct("id", "n", "lo", "hi", "t").alias("x"), "y", "z")
        seen = x.select("path", "x.*", "y", "z", *[((F.col("x.id") == F.col(f"{y}.id")) | _may(similarity, y)).alias(name) for y, name in (("y", "near"), ("z", "near_z"))])
        share = seen.groupBy("path").agg(F.greatest(*[F.avg(F.col(c).cast("double")) for c in ("near", "near_z")]).alias("share"))
        cluster = (F.col("share") == 1) | F.lit(level == depth) | ((F.col("share") >= CLUSTER_SHARE) & F.lit(level >= CLUSTER_LEVEL))
        placed = materialise(seen.join(materialise(share.select("path", cluster.alias("ended"))), "path"))
        many.append(placed.where("ended").select("path", "id", "n", "lo", "hi", F.col("y.id").alias("y"), F.col("z.id").alias("z"), "near", "near_z"))
        large = placed.where("NOT ended")
        if large.isEmpty():
            break
        first = F.pmod(F.xxhash64("path"), F.lit(own))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(own - 1)), F.lit(own))  # another one
        drawn = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.element_at("t", (k + 1).cast("int")).alias("token")) for b, k in enumerate((first, second))])).alias("d")
        live = large.select("id", "n", "lo", "hi", "t", "path", drawn).select("id", "n", "lo", "hi", "t", F.xxhash64("path", "d.b", "d.token").alias("path"))
    ended = materialise(reduce(DataFrame.unionByName, ends))
    wide = reduce(DataFrame.unionByName, [ended.where("path IS NOT NULL"), *many])
    return ended.where("path IS NULL").select(*_pair("id", "y")), wide


def node_components(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, id, n, lo, hi, comp) of the members of tree nodes, and (path, main, ys) of the nodes that have several components:
    the largest one, and DRAWN of its members, drawn by path.

    A set is in a few nodes of each tree, and its component is the same in all: it is looked up once for each set, so the
    join has a row for each set and not for each node that it is in."""
    once = members.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "lo", "hi")], F.collect_list("path").alias("paths"))  # a few for each tree
    known = once.join(comp.hint("merge"), "id", "left").select(F.explode("paths").alias("path"), "id", "n", "lo", "hi", F.coalesce("comp", "id").alias("comp"))
    placed = materialise(known)  # read again
    who = F.struct("id", "n", "lo", "hi")
    draws = [F.min_by(who, F.struct(F.xxhash64("path", "id", F.lit(j)), "id")) for j in range(DRAWN)]
    per = placed.groupBy("path", "comp").agg(F.count("*").alias("c"), F.array(*draws).alias("ys"))
    main = per.groupBy("path").agg(F.count("*").alias("comps"), F.max_by(F.struct(F.col("comp").alias("main"), "ys"), F.struct("c", "comp")).alias("top")).where("comps > 1")
    return placed, materialise(main.select("path", "top.*"))


def mixed_nodes(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(path, id, n, lo, hi, comp, main) of the members of the tree nodes that have several components; main: the largest."""
    return in_mixed(*node_components(members, comp))


def in_mixed(placed: DataFrame, main: DataFrame) -> DataFrame:
    return materialise(placed.join(main.select("path", "main").hint("merge"), "path"))


def minor_members(placed: DataFrame, main: DataFrame) -> DataFrame:
    """(x, ys): the members outside their node's largest component, with what is drawn of that one. Members of the largest,
    which in a cluster of copies are nearly all, make no rows."""
    both = placed.alias("p").join(main.alias("m").hint("merge"), (F.col("p.path") == F.col("m.path")) & (F.col("comp") != F.col("main")))
    return both.select(F.struct("id", "n", "lo", "hi").alias("x"), "ys")


def drawn_pairs(minors: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the members outside a node's largest component with those that are drawn of it. In a cluster of near copies,
    one link of the many that such a member may have is enough to join it."""
    return minors.select("x", F.explode("ys").alias("y")).where(_may(similarity)).select(*_pair("x.id", "y.id")).distinct()


def merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """The components (id, comp) after more (a, b) links, settled between the components alone."""
    of = {c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp")) for c in "ab"}
    ends = found.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    cross = materialise(ends.where("a <> b").distinct())
    if cross.isEmpty():
        return comp
    top = components(cross)
    known = comp.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
    return materialise(known.unionByName(top.join(comp, "id", "left_anti").select("id", "comp")))


def placed_rows(documents: DataFrame, k: int, similarity: float, small: int) -> DataFrame:
    """(doc_id, id, n_shingles, first) of every row; first: doc_id and node of the first document of its component."""
    table = materialise(sketches(documents, k))
    # documents with equal sets are one node, the smallest of theirs
    once = table.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.min(F.struct("doc_id", "id")).alias("first"), *[F.first(c).alias(c) for c in ("n", "lo", "hi", "tokens")])
    nodes = materialise(once)
    rep = nodes.select("digest", F.col("id").alias("rep"), "first")
    depth = DEPTH + max(0, math.ceil(math.log(max(1, nodes.count()) / 1e6, 50)))
    near, many = grown(nodes, similarity, small, depth)
    star = many.where("near AND id <> y").select(*_pair("id", "y"))
    second = many.where("near_z AND NOT near AND id <> z").select(*_pair("id", "z"))
    pairs = materialise(near.union(star).union(second).distinct())
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(many.select("id")).distinct()
    sets = shingle_sets(documents, needed, k)
    if not table.groupBy("id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])  # repeated rows have one set
    sets = materialise(sets, "none")
    links = materialise(confirm(pairs, sets, similarity))
    comp = components(links)
    placed, main = node_components(many, comp)
    if not main.isEmpty():
        found = confirm(drawn_pairs(minor_members(placed, main), similarity).join(pairs, ["a", "b"], "left_anti"), sets, similarity)
        comp = merged(comp, found)
        placed, main = node_components(placed.join(main.select("path").hint("merge"), "path", "left_semi"), comp)
    if not main.isEmpty():
        mixed = in_mixed(placed, main)
        # one row a node; its component is the same on every path
        who = mixed.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "lo", "hi", "comp")], F.max(F.col("comp") != F.col("main")).alias("minor"))
        near = materialise(rarest(sets, mixed, similarity).join(who.hint("merge"), "id"))
        more = rare_pairs(near, similarity)
        comp = merged(comp, confirm(more.join(pairs, ["a", "b"], "left_anti"), sets, similarity))
    of = materialise(rep.join(comp.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("digest", "first", "comp"))
    # written before the join, so that the rows of a large component can be split over its tasks
    heads = materialise(of.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("head")))
    of = of.join(heads.hint("merge"), "comp", "left").select("digest", F.coalesce("head", "first").alias("first"))
    return table.join(of.hint("merge"), "digest", "left").select("doc_id", "id", F.col("n").alias("n_shingles"), F.coalesce("first", F.struct("doc_id", "id")).alias("first"))


def near_duplicates(documents: DataFrame, k: int = 5, similarity: float = 0.8, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = placed_rows(documents, k, similarity, small)
    return rows.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.id") == F.col("id")).alias("kept"))


def representatives(documents: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, that are the first of their component; of rows with equal id and text, the one whose
    columns hash lowest."""
    with scratch() as made:
        rows = placed_rows(documents, k, similarity, SMALL)
        per = materialise(rows.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("times"), F.max(F.col("first.id") == F.col("id")).alias("kept")))
    drop(made, per)
    # most rows are one of a kind and stay: they go on as they are read, and only the others are looked up
    doubt = per.where("NOT kept OR times > 1").select("key")
    own = flagged(documents.select(whole_row(documents).alias("row"), node().alias("key")), "key", doubt)
    asked, kept = own.where("may"), flagged(per.where("kept"), "key", doubt).where("may")
    out = own.where("NOT may").select("row").unionByName(asked.join(kept.where("times = 1"), "key", "left_semi").select("row"))
    often = kept.where("times > 1")
    if not often.isEmpty():
        again = asked.join(often, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(again.select("row"))
    return out.select("row.*")
