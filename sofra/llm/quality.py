"""Quality scores from compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is compressed in small blocks, all of them, each one afresh with either dictionary; compressed as a whole, a long text
would be its own dictionary. The difference of the two total sizes, as a share of the text's bytes, is the only thing the
score looks at. It is calibrated on labelled texts that the dictionaries have not seen: pool-adjacent-violators
gives the share of good texts as a rising function of the difference, and a logistic curve of the same difference has a
tenth of the weight, so that texts within a flat stretch keep their order.

Empty and null texts have difference 0. Equal texts get equal scores. Labelled ids without a document and null labels are
left out before anything is counted; of repeated label rows the smallest label counts, of repeated ids the smallest text;
without labels every score is 0.5. A very long text is compressed whole, block by block, alone in its step. An empty table gives no rows. Ids of any type will do; other columns are not looked
at, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logistic
from .common import fold, map_arrow, materialise, steps, texts

#: The bound of what is collected: labelled training rows of each class, those whose ids hash lowest; whole texts, whatever
#: their length. Most bytes of a trained dictionary, and the blocks that texts are cut into, for training and for scores.
SAMPLE_ROWS, DICTIONARY_BYTES, BLOCK = 2000, 256 << 10, 512
LEVEL, CURVE = 3, 0.1


def labelled(documents: DataFrame, labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y): training labels of ids that there are in documents, one for each id."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    return known.join(documents.select("doc_id"), "doc_id", "left_semi")


def training_sample(documents: DataFrame, known: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y, text): at most `rows` labelled documents of each class, those whose ids hash lowest."""
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * rows ids at most
    return found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(size, [b for s in samples for b in blocks(s)]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)


class Scorer:
    """Compressed sizes of a text's blocks with either dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in (good, bad))

    def differences(self, docs: list[bytes]) -> np.ndarray:
        """How many bytes a byte of each text the good dictionary saves against the bad one."""
        bad, good = self.bad.compress, self.good.compress
        return np.array([sum(len(bad(b)) - len(good(b)) for b in blocks(t)) / len(t) if t else 0.0 for t in docs])


class Calibration:
    """A rising function from the difference to the probability of a good text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.line = logistic.fit(x[:, None], y, weight)
        pools: list[list[float]] = []  # first and last difference, weight of good texts, weight
        for a, good, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist())):
            pools.append([a, a, good * w, w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                last = pools.pop()
                pools[-1][1:] = [last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        self.at = np.array([(p[0] + p[1]) / 2 for p in pools])
        self.share = np.array([(p[2] + 0.25) / (p[3] + 0.5) for p in pools])  # half a text of either kind, so nothing is certain

    def __call__(self, x: np.ndarray) -> np.ndarray:
        curve = logistic.predict(self.line, x[:, None])
        return (1 - CURVE) * np.interp(x, self.at, np.maximum.accumulate(self.share)) + CURVE * curve if len(self.at) else np.full(len(x), 0.5)


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> dict:
    """Dictionaries from one half of the sample, calibration on the other; classes weigh as often as they are among all training labels."""
    known = materialise(labelled(documents, labels, "quality", folds, held))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = training_sample(documents, known, rows).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    made: dict[int, list[bytes]] = {0: [], 1: []}
    held_back: list[tuple[bytes, int]] = []
    for r in sorted(sample.toLocalIterator(), key=lambda r: (r["h"], r["text"])):  # 2 * rows texts at most
        text = r["text"].encode()
        made[r["y"]].append(text) if r["h"] % 2 == 0 else held_back.append((text, r["y"]))
    good, bad = dictionary(made[1]), dictionary(made[0])
    y = np.array([v for _, v in held_back], float)
    weight = np.where(y == 1, share.get(1, 0) / max(1, (y == 1).sum()), share.get(0, 0) / max(1, (y == 0).sum()))
    return {"good": good, "bad": bad, "curve": Calibration(Scorer(good, bad).differences([t for t, _ in held_back]), y, weight / max(1e-12, weight.mean()) if len(y) else y)}


def score(documents: DataFrame, trained: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(trained)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        scorer = Scorer(made["good"], made["bad"])
        for batch in steps(batches):
            s = made["curve"](scorer.differences(texts(batch)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    own = [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_arrow(documents.select("doc_id", "text"), run, T.StructType(own))
