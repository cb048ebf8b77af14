import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sofra.llm import queries, resampling
from tests.compare import connect
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, grams=1, buckets=10000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of each row, ranked by one sort."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), Counter(" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1))

    at = lambda f: zlib.crc32(f.encode()) % buckets
    have, want, made = Counter(), Counter(), []
    for t in target:
        for f, n in features(t)[1].items():
            want[at(f)] += n
    made = [(i, *features(t)) for i, t in rows]
    for _, _, c in made:
        for f, n in c.items():
            have[at(f)] += n
    s, t = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in have}
    out = []
    for i, n_words, c in made:
        weight = sum(n * gain[at(f)] for f, n in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("grams,buckets,percent,least", [(1, 10000, 10, 20), (2, 97, 35, 0), (1, 500, 100, 1)])
def test_equals_a_plain_sort(spark, grams, buckets, percent, least):
    rows = cases.texts()
    target = ["bir ay ham. FOO7", None, "kar kar gül3"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    made = resampling.resample(cases.documents(spark, rows), goal, grams, buckets, percent=percent, least_words=least)
    assert rows_of(made) == sorted(plain(rows, target, grams, buckets, percent, least), key=repr)


def test_ranges_of_the_histogram_add_up(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_SCORES", 50)  # twelve ranges
    scored = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), (F.col("id") * 7919 % 101 - 50).alias("score")).repartition(5)
    got = {r.doc_id: r["rank"] for r in resampling.drawn(scored, 40, 20).collect()}
    order = sorted(range(600), key=lambda i: (-(i * 7919 % 101 - 50), i))
    assert got == {i: k if k <= 240 else None for k, i in enumerate(order, 1)}


def test_one_score_of_all_rows_is_cut_by_id(spark):
    scored = spark.range(100).select((F.lit(99) - F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(5).cast("long").alias("score"))
    assert {r.doc_id: r["rank"] for r in resampling.drawn(scored, 10, 20).collect()} == {i: i + 1 if i < 10 else None for i in range(100)}


def test_repeated_rows_rank_next_to_each_other(spark):
    text = "ay " * 30
    made = resampling.resample(cases.documents(spark, [(1, text)] * 10 + [(2, "x")]), spark.createDataFrame([("ay",)], "text string"), percent=50)
    assert sorted(r["rank"] for r in made.where("rank IS NOT NULL").collect()) == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(cases.documents(spark, []), none).count() == 0
    assert rows_of(resampling.resample(cases.documents(spark), none)) == sorted(plain(cases.texts(), []), key=repr)


def test_query_equals_sql(spark, sf):
    got = rows_of(queries.op13_resampling(spark, sf))
    want = connect(sf).execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.ORACLES['op13_resampling']})").fetchall()
    assert got == sorted(want, key=repr) and any(r[4] for r in got)
