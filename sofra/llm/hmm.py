"""Hidden Markov language model over word classes, trained by distributed Baum-Welch.

Tokens are the lower-cased words and an end token for each text. A word's class is its own for the OWN most frequent
training words, else one of SHAPES made from its first two bytes and its last one. The model of a text is

    P(text) = P_hmm(classes of its tokens) * product of P(word | class)

P(word | class) = (1 - u) * (c + 0.5) / (N_class + 0.5 * V_class) for training words and u for an unknown one, where u is
the share of words seen once in the class (Good-Turing), so each class sums to 1 over its known words and one unknown.
The hidden Markov part has STATES states; each round of Baum-Welch takes expected counts of all training tokens in every
partition and adds them up with a shuffled sum. For these counts a long text is walked in pieces of PIECE tokens. Each
piece after the first begins WARM tokens early, from the states' overall shares, and these tokens count in the piece
before only, so every token and every move counts once, and starts are counted where texts start. The scaled forward
recursion of the score runs over whole texts. Both recursions keep a row for each state and are scaled every SCALED steps and
where a text ends, which doubles bear. Only initial emissions come from a bounded sample.

Arrow splits WORD_BYTES of text at a time and numbers the distinct words, so that a word is looked up once a step.

Counts of the LOCAL most frequent words (bounded) go to every task; the others meet the texts by a join on the word, so
no word's group is large. A null text is an empty one, an end token alone. Equal rows get equal results; two rows are
told apart by a 64-bit hash of id and text. Without training rows all words are unknown. Ties among frequent words go by
the word. A very long text is one step of its task. An empty table gives no rows. Ids of any type will do; other columns
are not looked at, whatever their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold, map_arrow, materialise, steps, utf8

OWN, LOCAL, STATES, PIECE, WARM, ROUNDS = 1024, 131_072, 12, 512, 16, 4
SCALED = 4  # steps of the recursions from one scaling to the next
FIRST, LAST = 64, 8
SHAPES = FIRST * LAST
CLASSES = 1 + OWN + SHAPES
FLUSH, WORD_BYTES, POOL_TOKENS, GROUP_TOKENS, SEED_ROWS = 200_000, 4 << 20, 2 << 20, 1 << 18, 512
_END_KIND = np.full(256, 7, np.int64)
_END_KIND[97:123] = 0
_END_KIND[[44, 46, 59, 58]] = 1
_END_KIND[[33, 63]] = 2
_END_KIND[[36, 37, 38, 42, 35]] = 3
_END_KIND[48:58] = 4
_END_KIND[128:192] = 5
_END_KIND[[124, 40, 41, 91, 93, 34, 39]] = 6
_HEADS = np.array([zlib.crc32(bytes([a, b][: 1 + (b < 256)])) % FIRST for a in range(256) for b in range(257)])  # of two bytes, or of one and 256
_COLUMNS = ("doc_id", "key", "train", "n_tokens", "n_known", "base", "inner")
_KINDS = (T.LongType(), T.BooleanType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())


def shapes(column: pa.Array) -> np.ndarray:
    """Class of each word (one byte at least) that has none of its own."""
    raw, at = utf8(column)
    begin, stop = at[:-1], at[1:]
    second = np.where(stop - begin > 1, raw[np.minimum(begin + 1, len(raw) - 1)].astype(np.int64), 256)
    return 1 + OWN + _HEADS[raw[begin].astype(np.int64) * 257 + second] * LAST + _END_KIND[raw[stop - 1]]


def coded(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the number among them of each token's word, and the n + 1 offsets of the texts' tokens.

    Words are those of common.words(): Arrow's ascii functions know the same six blanks and lower A-Z alone."""
    column = batch.column("text")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.view(pa.string() if pa.types.is_binary(column.type) else pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat, edges = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0  # blanks at an end leave an empty part
    if not some.all():
        flat, edges = flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[edges]
    found = flat.dictionary_encode()
    return found.dictionary.cast(pa.binary()), np.asarray(found.indices), edges


def among(found: pa.Array, names: pa.Array) -> np.ndarray:
    """The place of each word in names, or len(names)."""
    return np.asarray(pc.index_in(found, value_set=names).fill_null(len(names))).astype(np.int64)


def added(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the parts of values from each edge to the next."""
    out, some = np.zeros(len(edges) - 1, values.dtype), edges[:-1] < edges[1:]
    if some.any():
        out[some] = np.add.reduceat(values, edges[:-1][some])
    return out


def count_words(documents: DataFrame) -> DataFrame:
    """(word, c) over the rows of documents, without end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in steps(batches, most=WORD_BYTES):
            found, at, _ = coded(batch)
            parts.append(pa.table({"word": found, "n": np.bincount(at, minlength=len(found))}))
            size += len(found)
            if size > 2 * FLUSH:
                parts = [merged(parts)]
                size = len(parts[0])
                if size > FLUSH:
                    yield from parts[0].to_batches()
                    parts, size = [], 0
        if parts:
            yield from merged(parts).to_batches()

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": sums.column("word"), "n": sums.column("n_sum")}).combine_chunks()

    return map_arrow(documents.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The LOCAL most frequent words, ties by word. Words of too low a count, found from a histogram, are left out before
    the sort, so that all partitions together send little more than LOCAL rows to the driver."""
    level = F.floor(F.log2("c") * 16)
    found, least = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):  # 1,024 rows at most
        found, least = found + r["n"], r["level"]
        if found >= LOCAL:
            break
    rows = counts.where(level >= least).orderBy(F.col("c").desc(), "word").limit(LOCAL).collect()
    return [(bytes(r["word"]), r["c"]) for r in rows]


def class_sums(counts: DataFrame, own: dict[bytes, int]) -> dict[int, tuple[int, int, int]]:
    """class -> tokens, words, words seen once."""
    names = pa.array(sorted(own, key=own.get), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 3), np.int64)
        for batch in batches:
            c = np.asarray(batch.column("c"))
            if len(c):
                word = batch.column("word")
                k = among(word, names)
                k = np.where(k < len(names), k + 1, shapes(word))
                total += np.column_stack([np.bincount(k, v, CLASSES) for v in (c, np.ones(len(c)), c == 1)]).astype(np.int64)
        some = np.flatnonzero(total[:, 1])
        yield pa.record_batch({"k": pa.array(some), "n": pa.array(total[some, 0]), "v": pa.array(total[some, 1]), "once": pa.array(total[some, 2])})

    rows = map_arrow(counts, run, "k long, n long, v long, once long").groupBy("k").agg(*[F.sum(x).alias(x) for x in ("n", "v", "once")]).collect()  # one row a class
    return {r["k"]: (r["n"], r["v"], r["once"]) for r in rows}


def in_class(sums: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what every known word of a class gets besides c + 0.5, and log10 of the class's unknown word."""
    known, unknown = np.zeros(CLASSES), np.zeros(CLASSES)
    for k in range(1 + OWN, CLASSES):
        n, v, once = sums.get(k, (0, 0, 0))
        u = min(0.95, max(1e-6, (once + 0.5) / (n + 1.0))) if n else 1.0
        unknown[k] = np.log10(u)
        known[k] = np.log10((1 - u) / (n + 0.5 * v)) if n else 0.0
    return known, unknown


def sequences(documents: DataFrame, frequent: list[tuple[bytes, int]], known: np.ndarray, ends: int) -> DataFrame:
    """(doc_id, key, train, n_tokens, n_known, base, inner, seq): classes of each text's tokens, sums over its frequent words."""
    spark = documents.sparkSession
    names, tokens = pa.array([w for w, _ in frequent], pa.binary()), np.array([c for _, c in frequent], float)
    shared = spark.sparkContext.broadcast((names, tokens, known))  # LOCAL words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens, known = shared.value
        n = len(names)
        base_of, own_of = np.zeros(n + 1), np.zeros(n + 1, bool)  # the last place is that of all other words
        base_of[:n] = np.log10(tokens + 0.5)
        own_of[: min(n, OWN)] = True
        for batch in steps(batches, most=WORD_BYTES):
            found, at, edges = coded(batch)
            place = among(found, names)
            own, kind, base = own_of[place], shapes(found), base_of[place]
            kind = np.where(own, place + 1, kind)
            inner = np.where(own | (place == n), 0.0, base + known[kind])
            rows = np.arange(len(edges))
            seq = np.zeros(len(at) + batch.num_rows, "<u2")
            seq[np.arange(len(at)) + np.repeat(rows[:-1], np.diff(edges))] = kind[at]
            seqs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * (edges + rows)).astype(np.int32)), pa.py_buffer(seq)])
            a, b = np.diff(edges) + 1, added((place < n).astype(np.int64)[at], edges) + (ends > 0)
            c, d = added(base[at], edges) + np.log10(ends + 0.5), added(inner[at], edges)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "train": batch.column("train"), "n_tokens": pa.array(a), "n_known": pa.array(b), "base": pa.array(c), "inner": pa.array(d), "seq": seqs})

    own = [T.StructField(c, kind) for c, kind in zip(_COLUMNS, (documents.schema["doc_id"].dataType, *_KINDS))]
    return map_arrow(documents, run, T.StructType([*own, T.StructField("seq", T.BinaryType())]))


def rare_words(documents: DataFrame, frequent: list[tuple[bytes, int]]) -> DataFrame:
    """(word, key, k, n): the other words of each text, with class and number."""
    shared = documents.sparkSession.sparkContext.broadcast(pa.array([w for w, _ in frequent], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in steps(batches, most=WORD_BYTES):
            found, at, edges = coded(batch)
            some = (among(found, common) == len(common))[at]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(edges))[some]
            pair, many = np.unique(owner * len(found) + at[some], return_counts=True)
            owner, at = np.divmod(pair, max(1, len(found)))
            yield pa.record_batch({"word": found.take(pa.array(at)), "key": batch.column("key").take(pa.array(owner)), "k": pa.array(shapes(found)[at].astype(np.int32)), "n": pa.array(many.astype(np.int32))})

    return map_arrow(documents.select("key", "text"), run, "word binary, key long, k int, n int")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray | None = None):
        self.start, self.move, self.emit = start, move, emit  # emit: CLASSES x STATES
        self.share = start if share is None else share  # how often each state is, anywhere


def _mixture(histograms: np.ndarray, states: int, rounds: int = 30) -> np.ndarray:
    """Emissions of a mixture over whole texts, begun from texts far apart."""
    total = histograms.sum(0) + 1.0
    p = (histograms + 0.5 * total / total.sum() * 20) / (histograms.sum(1, keepdims=True) + 10)
    picked = [int(np.argmax(histograms.sum(1)))]
    root = np.sqrt(p)
    near = ((root - root[picked[0]]) ** 2).sum(1)
    while len(picked) < min(states, len(p)):
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, ((root - root[picked[-1]]) ** 2).sum(1))
    emit = np.stack([p[i] for i in picked] + [total / total.sum()] * (states - len(picked)))
    weight = np.full(states, 1 / states)
    for _ in range(rounds):
        odds = histograms @ np.log(emit).T + np.log(weight)
        post = np.exp(odds - odds.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        weight = (post.sum(0) + 0.1) / (len(p) + 0.1 * states)
        emit = post.T @ histograms + 2.0 * total / total.sum() + 1e-3
        emit /= emit.sum(1, keepdims=True)
    return emit.T


def begin(sample: list[bytes], states: int = STATES) -> Model:
    h = np.stack([np.bincount(np.frombuffer(s, "<u2"), minlength=CLASSES) for s in sample]).astype(float) if sample else np.ones((1, CLASSES))
    move = np.full((states, states), 0.15 / max(1, states - 1))
    np.fill_diagonal(move, 0.85)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), _mixture(h, states))


def _groups(seqs: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Numbers of sequences of like length, longest first, about `most` tokens each."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    group, size = [], 0
    for i in order:
        if group and size + len(seqs[i]) > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(seqs[i])
    if group:
        yield group


def _laid(seqs: list[np.ndarray], group: list[int]) -> tuple[np.ndarray, list[int]]:
    """Tokens step by step, and where each step begins; a step has the sequences that are as long, the longest first."""
    sizes = np.array([len(seqs[i]) for i in group])
    at = np.concatenate([[0], np.cumsum(len(group) - np.cumsum(np.bincount(sizes))[:-1])])
    flat = np.concatenate([seqs[i] for i in group])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tokens = np.empty(len(flat), np.int64)
    tokens[at[place] + np.repeat(np.arange(len(group)), sizes)] = flat
    return tokens, at.tolist()


def log_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 P of each whole class sequence by the scaled forward recursion, with a row for each state."""
    out = np.zeros(len(seqs))
    into, emit = model.move.T.copy(), model.emit.T.copy()
    for group in _groups(seqs, GROUP_TOKENS):
        tokens, at = _laid(seqs, group)
        total, a = np.zeros(len(group)), None
        for t, (lo, hi) in enumerate(zip(at, at[1:])):
            n, later = hi - lo, at[min(t + 2, len(at) - 1)] - hi
            a = (model.start[:, None] if a is None else into @ a[:, :n]) * emit.take(tokens[lo:hi], 1)
            if t % SCALED == SCALED - 1:
                scale = a.sum(0)
                total[:n] += np.log10(scale)
                a /= scale
            if later < n:  # these end here
                total[later:n] += np.log10(a[:, later:].sum(0))
        out[group] = total
    return out


def pieces(seq: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """Parts of a sequence, and whether each is its begin. All but the first begin WARM tokens early."""
    return [(seq[max(0, i - WARM) : i + PIECE], i == 0) for i in range(0, len(seq), PIECE)]


def expected(model: Model, parts: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (the E step) of the parts of pieces()."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
    into, emits, begins = model.move.T.copy(), model.emit.T.copy(), np.stack([model.share, model.start], 1)
    seqs, is_first = [s for s, _ in parts], np.array([f for _, f in parts], bool)
    for group in _groups(seqs, GROUP_TOKENS):
        tokens, edges = _laid(seqs, group)
        first = is_first[group]
        a, alpha, b, scale = None, [], [], {}
        for t, (lo, hi) in enumerate(zip(edges, edges[1:])):
            b.append(emits.take(tokens[lo:hi], 1))
            a = (begins.take(first.astype(np.int64), 1) if a is None else into @ a[:, : hi - lo]) * b[t]
            if t % SCALED == SCALED - 1:
                scale[t] = a.sum(0)
                a /= scale[t]
            alpha.append(a)
        gamma, beta = np.empty((k, len(tokens))), np.empty((k, 0))
        for t in range(len(alpha) - 1, -1, -1):
            a, n, later = alpha.pop(), edges[t + 1] - edges[t], beta.shape[1]
            if later < n:  # these end here; their states add up to 1 with what the last scaling left
                beta = np.concatenate([beta, np.repeat(1 / a[:, later:].sum(0)[None], k, 0)], 1)
            counts = np.multiply(a, beta, out=gamma[:, edges[t] : edges[t + 1]])
            if t < WARM:  # a token counts in the piece before; so does the move into it
                counts *= first[:n]
            after = b.pop()
            if t:
                after *= beta
                if t in scale:
                    after /= scale[t]
                before = alpha[-1][:, :n]
                move += before @ after.T if t >= WARM else before @ (after * first[:n]).T
                beta = model.move @ after
        start += gamma[:, : edges[1]].sum(1)
        for j in range(k):
            emit[j] += np.bincount(tokens, gamma[j], CLASSES)
    return start, move * model.move, emit.T


def _pools(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of several batches together, so that sequences of like length meet."""
    pool, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            pool.append(row)
            size += len(row[-1]) // 2
            if size >= most:
                yield pool
                pool, size = [], 0
    if pool:
        yield pool


def improve(model: Model, trained: DataFrame) -> Model:
    """One round of Baum-Welch over all training sequences."""
    shared = trained.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for pool in _pools(batches, POOL_TOKENS):
            parts = [p for (raw,) in pool for p in pieces(np.frombuffer(raw, "<u2"))]
            got = np.concatenate([x.ravel() for x in expected(shared.value, parts)])
            total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.record_batch({"i": pa.array(some), "x": pa.array(total[some])})

    rows = map_arrow(trained.select("seq"), run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # as many as the model has numbers
    k = len(model.start)
    flat = np.zeros(k + k * k + CLASSES * k)
    for r in rows:
        flat[r["i"]] = r["x"]
    start, move, emit = flat[:k] + 0.1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k :].reshape(CLASSES, k)
    share = emit.sum(0) + 0.1
    overall = emit.sum(1, keepdims=True) + 0.01
    emit = emit + 5.0 * overall / overall.sum()
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), share / share.sum())


def score(documents: DataFrame, folds: int = 5, held: int = 1, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), (fold(F.col("doc_id"), folds) != held).alias("train"))
    counts = materialise(count_words(keyed.where("train")))
    ends = keyed.where("train").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    frequent = most_frequent(counts)
    known, unknown = in_class(class_sums(counts, {w: i + 1 for i, (w, _) in enumerate(frequent[:OWN])}))
    table = materialise(sequences(keyed, frequent, known, ends))
    trained = table.where("train")
    keys = [r["key"] for r in trained.select("key").orderBy(F.xxhash64("key"), "key").limit(SEED_ROWS).collect()]
    picked = trained.where(F.col("key").isin(keys)).groupBy("key").agg(F.first("seq").alias("seq"))  # every partition sends keys only
    sample = picked.orderBy(F.xxhash64("key"), "key").collect()
    model = begin([bytes(r["seq"]) for r in sample], states)
    for _ in range(rounds):
        model = improve(model, trained)
    by_class = documents.sparkSession.createDataFrame([(k, float(known[k]), float(unknown[k])) for k in range(1 + OWN, CLASSES)], "k int, known double, unknown double")
    rare = rare_words(keyed, frequent).join(counts, "word", "left").join(F.broadcast(by_class), "k")  # one row a class
    seen, many = F.col("c").isNotNull(), F.col("n")
    base = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = rare.groupBy("key").agg(F.sum(F.when(seen, many).otherwise(0)).alias("r_known"), F.sum(many * base).alias("r_base"), F.sum(many * F.when(seen, F.col("known") + base).otherwise(F.col("unknown"))).alias("r_inner"))
    times = table.groupBy("key").agg(F.count("*").alias("times"))  # equal rows were summed together
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(batches, POOL_TOKENS):
            ll = log_likelihood(shared.value, [np.frombuffer(r[-1], "<u2") for r in pool])
            cols = list(zip(*pool))
            yield pa.record_batch({"doc_id": pa.array(cols[0], ids), "key": pa.array(cols[1], pa.int64()), "train": pa.array(cols[2], pa.bool_()), "n_tokens": pa.array(cols[3], pa.int64()), "n_known": pa.array(cols[4], pa.int64()), "base": pa.array(cols[5], pa.float64()), "inner": pa.array(cols[6], pa.float64()), "ll": pa.array(ll)})

    own = [T.StructField(c, kind) for c, kind in zip(_COLUMNS, (documents.schema["doc_id"].dataType, *_KINDS))]
    ids = to_arrow_type(own[0].dataType)
    chained = map_arrow(table, run, T.StructType([*own, T.StructField("ll", T.DoubleType())]))
    per_row = sums.join(times, "key").select("key", *[(F.col(x) / F.col("times")).alias(x) for x in ("r_known", "r_base", "r_inner")])
    both = chained.join(per_row, "key", "left").na.fill(0.0, ["r_known", "r_base", "r_inner"])
    whole = float(np.log10(n + 0.5 * (v + 1)))
    return both.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.round("r_known").cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.col("r_base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("ll") + F.col("inner") + F.col("r_inner")).alias("score"))
