"""The registered queries of the numbered operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hmm, lexical, media, mixing, near_dedup, packing, pii, quality, resampling, sharding, suffix_dedup, toxicity
from .common import fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "posterior")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    scored = quality.score(documents, quality.train(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=2, similarity=0.8)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hmm": op2_hmm,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_media": op7_media,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_search": op11_search,
    "op12_pii": op12_pii,
    "op13_resampling": op13_resampling,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS f FROM documents),
n AS (SELECT r, doc_id, len(f) AS n FROM d WHERE len(f) > 0), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(f) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, g),
v AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS v FROM p JOIN n USING (r) JOIN w USING (t), g),
s AS (SELECT item_id, r, sum(v)::BIGINT AS score FROM q JOIN v USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r) WHERE score > 0) WHERE rank <= 50"""

#: The crc32 of a feature goes byte by byte through a table of 256 entries, made bit by bit.
OP13 = rf"""WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS f FROM documents),
df AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(f) AS w FROM d) GROUP BY 1, 2),
tf AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM df UNION SELECT w FROM tf)),
b AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS b FROM words, tab),
s AS (SELECT b, sum(n)::BIGINT AS s FROM df JOIN b USING (w) GROUP BY 1), t AS (SELECT b, sum(n)::BIGINT AS t FROM tf JOIN b USING (w) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
w AS (SELECT r, sum(n * g)::BIGINT AS weight FROM df JOIN b USING (w) JOIN g USING (b) GROUP BY 1),
x AS (SELECT d.r, doc_id, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM k) // 100 THEN place END AS rank FROM x LEFT JOIN k USING (r)"""

ORACLES: dict[str, str] = {"op11_search": OP11, "op13_resampling": OP13}
