"""Toxicity by weak supervision: voters, a generative label model with correlated voters, a linear classifier.

Voters look at a whole text and say toxic or nothing. The label model (latent class, EM over the counts of all vote
patterns of all documents, labelled training rows held at their labels) estimates each voter's accuracy and which
voters are correlated; strongly correlated pairs get one joint table instead of two independent ones. A logistic
regression is then trained on the posteriors of a bounded sample of labelled training rows.

Null and empty texts have no votes and get the classifier's score for them. Equal texts get equal scores. Repeated
label rows count once (the smallest label); labels without a document are harmless. Without any training label the
label model falls back to its priors. A very long text is one step of its task. Ties among mined words go by the word. An
empty table gives no rows. Ids of any type will do, and other columns may have any names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .common import fold, map_arrow, materialise, steps, texts, whole_row

#: Seed lexicon, lower case.
SEEDS = (
    "idiot moron stupid scum loser trash worthless pathetic disgusting clown dumb imbecile fool jerk garbage filth vermin "
    "hate kill bastard crap bitch shit fuck asshole retard slut whore "
    "dumm idioten arschloch scheisse abschaum wertlos versager "
    "imbécile crétin connard merde salaud ordure débile "
    "estúpido imbécil basura mierda asqueroso idiota inútil"
).split()
#: Bounds, parameters of train(): labelled training rows in the sample (rows) and mined words (most, those of the strongest
#: evidence; they travel to every task); words whose counts one task holds before it sends them on.
SAMPLE_ROWS, MINED, FLUSH = 20_000, 512, 200_000
#: Besides whole words, stems of so many bytes are mined: many languages put one insult into many endings.
STEMS = (4, 5, 6, 7, 8)
WORD = re.compile(rb"[a-z\x80-\xff]+(?:'[a-z]+)?")
VOTERS = ("seed", "two seeds", "two seed kinds", "seed density", "mined density", "two mined kinds, dense", "mined weight density", "high mined weight density", "seed in shout", "seed addressed")
N_FEATURES = 9


def labelled(documents: DataFrame, labels: DataFrame, folds: int, held: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most `rows` training ids that there are in documents, those that hash lowest."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    return known.join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def marks(word: bytes) -> list[bytes]:
    """The word and its stems, as lexicon entries; a stem ends with a star."""
    return [word] + [word[:k] + b"*" for k in STEMS if len(word) > k]


def mine(sample: DataFrame, most: int = MINED, evidence: float = 25.0, odds: float = 2.0) -> dict[bytes, float]:
    """Words and stems that tell toxic documents from clean ones, with their log odds: those for which the number of toxic
    documents times the log odds, close to a likelihood ratio test's statistic, is at least `evidence`. Copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in steps(batches):
            for text, y in zip(texts(batch), batch.column("y").to_pylist()):
                counts.update((m, y) for m in {m for w in set(WORD.findall(text.lower())) for m in marks(w)})
            if len(counts) > FLUSH:
                yield pack(counts)
                counts = Counter()
        yield pack(counts)

    def pack(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({"mark": pa.array([m for m, _ in counts], pa.binary()), "y": pa.array([y for _, y in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    once = sample.groupBy("text").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    by_mark = map_arrow(once, run, "mark binary, y int, n long").groupBy("mark").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    told = by_mark.where(F.col("t") >= 3).withColumn("odds", ratio).where((F.col("odds") >= odds) & (F.col("t") * F.col("odds") >= evidence))
    return {bytes(r["mark"]): r["odds"] for r in told.orderBy((F.col("t") * F.col("odds")).desc(), "mark").limit(most).collect()}


def features_of(docs: list[bytes], seeds: frozenset, mined: dict[bytes, float]) -> np.ndarray:
    """For each text: words; seed words, all and distinct; mined words, all and distinct; shouted and addressed seeds;
    log odds of the distinct mined words, and of all of them."""
    out = np.zeros((len(docs), N_FEATURES), np.float32)
    lengths = [k for k in STEMS if any(m.endswith(b"*") and len(m) == k + 1 for m in mined)]
    known: dict[bytes, float] = {}

    def weight(word: bytes) -> float:
        """The log odds of the word's best mark, 0 if it has none."""
        w = max([mined.get(word, 0.0), *(mined.get(word[:k] + b"*", 0.0) for k in lengths if len(word) > k)])
        if len(known) < FLUSH:
            known[word] = w
        return w

    for i, text in enumerate(docs):
        if not text:
            continue
        low = text.lower()
        found = WORD.findall(low)
        row = out[i]
        row[0] = len(found)
        counts = Counter(found)
        told = {w: o for w in counts if (o := known[w] if w in known else weight(w))}
        own = [w for w in counts if w in seeds]
        row[1], row[2] = sum(counts[w] for w in own), len(own)
        row[3], row[4] = sum(counts[w] for w in told), len(told)
        row[5] = sum(text.count(w.upper()) for w in own)
        row[6] = sum(low.count(b"you " + w) + low.count(b"you are " + w) + low.count(b"a " + w) for w in own)
        row[7], row[8] = sum(told.values()), sum(o * counts[w] for w, o in told.items())
    return out


def votes_of(f: np.ndarray) -> np.ndarray:
    n = np.maximum(f[:, 0], 1)
    weight = 1000 * f[:, 7] / n
    return np.column_stack([f[:, 1] >= 1, f[:, 1] >= 2, f[:, 2] >= 2, f[:, 1] / n >= 0.008, f[:, 3] / n >= 0.008, (f[:, 4] >= 2) & (f[:, 4] / n >= 0.006), weight >= 25, weight >= 60, f[:, 5] >= 1, f[:, 6] >= 1])


def inputs_of(f: np.ndarray) -> np.ndarray:
    """The classifier's inputs from the counts."""
    n = np.maximum(f[:, 0], 1)
    return np.column_stack([np.log1p(f[:, 1]), np.log1p(f[:, 2]), np.log1p(f[:, 3]), np.log1p(f[:, 4]), np.log1p(1000 * f[:, 1] / n), np.log1p(1000 * f[:, 3] / n), f[:, 1] > 0, f[:, 3] > 0, np.log1p(f[:, 0]) * (f[:, 3] == 0), np.log1p(f[:, 5]), np.log1p(f[:, 6]), np.log1p(f[:, 7]), np.log1p(f[:, 8]), np.log1p(1000 * f[:, 7] / n), np.log1p(1000 * f[:, 8] / n)]).astype(float)


def label_model(patterns: np.ndarray, known: np.ndarray, count: np.ndarray, link: float = 0.25, rounds: int = 60) -> dict:
    """EM over distinct vote patterns. known: 1 or 0, or -1 without label. The first fit has independent voters; its residual
    correlations pair the most dependent voters, each in one pair at most, and the second fit has a joint table for each pair."""
    m = patterns.shape[1]

    def fit(groups: list[list[int]]) -> tuple[float, list[np.ndarray], np.ndarray]:
        codes = [sum(patterns[:, j].astype(int) << k for k, j in enumerate(g)) for g in groups]
        post = np.where(known >= 0, known, np.clip(0.02 + 0.96 * patterns.mean(1), 0.02, 0.98))
        for _ in range(rounds):
            prior = float(np.clip((count * post).sum() / max(1e-9, count.sum()), 1e-4, 1 - 1e-4))
            tables, odds = [], np.full(len(patterns), np.log(prior / (1 - prior)))
            for g, code in zip(groups, codes):
                size = 1 << len(g)
                t = np.stack([np.bincount(code, count * (1 - post), size), np.bincount(code, count * post, size)]) + 0.1
                t /= t.sum(1, keepdims=True)
                tables.append(t)
                odds += np.log(t[1, code] / t[0, code])
            free = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            new = np.where(known >= 0, known, free)
            done = np.abs(new - post).max(initial=0.0) < 1e-7
            post = new
            if done:
                break
        return prior, tables, free

    alone = [[j] for j in range(m)]
    prior, tables, _ = fit(alone)
    prob = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + sum(np.log(t[1, patterns[:, j].astype(int)] / t[0, patterns[:, j].astype(int)]) for j, t in enumerate(tables)), -30, 30)))
    post = np.where(known >= 0, known, prob)
    corr = np.zeros((m, m))
    for y, w in ((0, count * (1 - post)), (1, count * post)):
        if w.sum() > 1:
            mean = (w[:, None] * patterns).sum(0) / w.sum()
            dev = patterns - mean
            cov = (w[:, None] * dev).T @ dev / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.maximum(corr, np.abs(cov / sd[:, None] / sd[None, :]) * (np.minimum(mean, 1 - mean) > 1e-4)[:, None])
    free_voters, groups = set(range(m)), []
    for i, j in sorted(((i, j) for i in range(m) for j in range(i + 1, m)), key=lambda p: -corr[p]):
        if corr[i, j] >= link and i in free_voters and j in free_voters:
            groups.append([i, j])
            free_voters -= {i, j}
    groups += [[j] for j in sorted(free_voters)]
    prior, tables, _ = fit(groups)
    return {"prior": prior, "groups": groups, "tables": tables, "correlations": corr}


def posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    odds = np.full(len(votes), np.log(model["prior"] / (1 - model["prior"])))
    for g, t in zip(model["groups"], model["tables"]):
        code = sum(votes[:, j].astype(int) << k for k, j in enumerate(g))
        odds += np.log(t[1, code] / t[0, code])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def featurise(documents: DataFrame, mined: dict[bytes, float]) -> DataFrame:
    """Every column of (doc_id, text), or of (row) with such a struct, but text, with pattern, the vote pattern as bits, and f,
    the counts. A text within a row is looked at where it is, so no batch holds it twice."""
    seeds = frozenset(w.encode() for w in SEEDS)
    names = [c for c in documents.columns if c != "text"]
    inside = documents.schema["row"].dataType.names.index("text") if names == ["row"] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if inside is not None:
            batches = (b.append_column("text", b.column("row").field(inside)) for b in batches)
        for batch in steps(batches):
            f = features_of(texts(batch), seeds, mined)
            bits = votes_of(f).astype(np.int64) @ (1 << np.arange(len(VOTERS)))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * N_FEATURES), pa.array(f.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bits), counts], names=[*names, "pattern", "f"])

    own = [documents.schema[c] for c in names]
    return map_arrow(documents, run, T.StructType([*own, T.StructField("pattern", T.LongType()), T.StructField("f", T.ArrayType(T.FloatType()))]))


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = SAMPLE_ROWS, most: int = MINED, packed: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The table of featurise() over documents or their packed rows, written, and what classify() needs: mined words, label model and linear model. Labels are
    read from training rows only."""
    picked = labelled(documents, labels, folds, held, rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `rows` ids at most
    mined = mine(sample, most)
    table = materialise(featurise(documents if packed is None else packed, mined))
    known = table.select("doc_id" if packed is None else F.col("row.doc_id").alias("doc_id"), "pattern", "f").join(F.broadcast(picked), "doc_id")
    # at most 2 ** len(VOTERS) patterns for each of three label states, whatever the number of documents
    everything = table.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    with_label = known.groupBy("pattern", "y").agg(F.count("*").alias("n")).collect()
    tally = {(r["pattern"], -1): r["n"] for r in everything}
    for r in with_label:
        tally[r["pattern"], r["y"]] = r["n"]
        tally[r["pattern"], -1] = max(0, tally[r["pattern"], -1] - r["n"])
    keys = sorted(tally)
    bits = np.array([[(p >> j) & 1 for j in range(len(VOTERS))] for p, _ in keys], float).reshape(-1, len(VOTERS))
    model = label_model(bits, np.array([k for _, k in keys], float), np.array([tally[k] for k in keys], float))
    got = known.select("f").toPandas()  # bounded by `rows`
    f = np.array(got["f"].tolist(), np.float32).reshape(-1, N_FEATURES)
    target = posterior(model, votes_of(f)) if len(f) else np.zeros(0)
    return table, {"mined": mined, "label": model, "linear": logistic.fit(inputs_of(f), target)}


def detect(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, predicted, posterior) of every document; labels are read from training rows only."""
    table, trained = train(documents.select("doc_id", "text"), labels, folds, held, rows)
    shared = documents.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = np.array(batch.column("f").to_pylist(), np.float32).reshape(-1, N_FEATURES)
                s = logistic.predict(shared.value["linear"], inputs_of(f))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32)), "posterior": pa.array(posterior(shared.value["label"], votes_of(f)))})

    own = [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("posterior", T.DoubleType())]
    return map_arrow(table, run, T.StructType(own))


def accepted(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns, that score below the threshold. They are looked at once: the training pass writes them
    beside their counts, and the classifier reads these."""
    table, trained = train(documents.select("doc_id", "text"), labels, folds, held, rows, packed=documents.select(whole_row(documents).alias("row")))
    shared = documents.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = np.array(batch.column("f").to_pylist(), np.float32).reshape(-1, N_FEATURES)
                keep = pa.array(logistic.predict(shared.value["linear"], inputs_of(f)) < threshold)
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep)], names=["row"])

    slim = table.select("f", "row")
    return map_arrow(slim, run, T.StructType([slim.schema["row"]])).select("row.*")
