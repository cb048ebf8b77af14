import hashlib
from itertools import pairwise

from pyspark.sql import functions as F

from sofra.operators import chain

NO_ARRAYS = ("collect_list", "collect_set")


def plain(payloads):
    links = ["GENESIS"]
    for p in payloads:
        links.append(None if p is None or links[-1] is None else hashlib.sha256(f"{p}:{links[-1]}".encode()).hexdigest())
    return [(b, None if i == 0 else a) for i, (a, b) in enumerate(pairwise(links))]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_hot_chain_is_streamed(spark):
    """A key with nearly all rows is no array of one row."""
    n = 30_000
    records = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.col("id")).alias("key"), F.col("id").alias("at"), F.concat(F.lit("ğ"), F.col("id").cast("string")).alias("payload"), F.lit(1.5).alias("more")).repartition(7)
    out = chain.links(records, ["key"], ["at"], "payload")
    assert not any(x in plan(out) for x in NO_ARRAYS)
    assert out.columns == ["key", "at", "payload", "more", "hash", "previous_hash"]
    got = out.collect()
    hot = sorted((r["at"], r["hash"], r["previous_hash"]) for r in got if r["key"] is None)
    at = [i for i in range(n) if i % 100]
    assert hot == [(i, *x) for i, x in zip(at, plain(f"ğ{i}" for i in at))]
    assert len(got) == n and all(r["previous_hash"] is None for r in got if r["key"] is not None)


def test_ties_and_unknown_payloads(spark):
    rows = [("a", 1, "y"), ("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("b", 1, "x")]
    got = chain.links(spark.createDataFrame(rows, "k string, t int, p string"), ["k"], ["t"], "p").orderBy("k", "t", "p").collect()
    assert [(r["hash"], r["previous_hash"]) for r in got] == plain(["x", "y", None, "z"]) + plain(["x"])


def test_fingerprint_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(chain, "BLOCK_BYTES", 100)
    heads = [hashlib.sha256(str(i % 1500).encode()).hexdigest() for i in range(2000)] + ["", "a", "ğü", "ab", "ab", None]
    df = spark.createDataFrame([(h,) for h in heads], "h string").repartition(5)
    out = chain.fingerprint(df, "h")
    assert not any(x in plan(out) for x in NO_ARRAYS)
    known = sorted((h for h in heads if h is not None), key=str.encode)
    assert [r["fingerprint"] for r in out.collect()] == [hashlib.sha256(":".join(known).encode()).hexdigest()]
    assert [r["fingerprint"] for r in chain.fingerprint(df.where("h IS NULL"), "h").collect()] == [chain.EMPTY]
