"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
sources are mixed to target weights, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, so a stage works on all that
its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sofra.llm import mixing, near_dedup, packing, suffix_dedup, toxicity
from sofra.llm.common import discard, drop, materialise, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of docs' training rows."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of documents that share 80 % of their five-word shingles."""
    return near_dedup.representatives(docs, k=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents, and their new lengths. A document may end up empty, but stays."""
    cut = suffix_dedup.cleaned(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return cut.withColumn("n_chars", F.length("text").cast(kind)) if kind else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL does not express trained models and packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again. Then its other tables go, and so
    does its predecessor's result."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as made:
            out = materialise(stage(spark, docs, sf_dir))
        drop(made, out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
