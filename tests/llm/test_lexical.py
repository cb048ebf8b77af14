import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sofra.llm import lexical, queries
from tests.compare import differences
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, rank int, doc_id string"


def plain(rows, items, k=50):
    """All documents scored against each item, one after the other."""
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    docs = [(i, c) for i, c in ((i, terms(t)) for i, t in rows) if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n // total
            scored.append((i, sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in want & set(c))))
        best = sorted((x for x in scored if x[1] > 0), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:k]
        out += [(item, r, *x) for r, x in enumerate(best, 1)]
    return sorted(out, key=repr)


def questions(spark, items):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in items], ITEMS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ASKED = [(1, "ay3 Bir4 FOO1, kar2 kar2!"), (2, None), (3, "nothing here"), (4, "one"), (None, "dört1 gül5 ham 7"), (5, cases.texts()[70][1]), (6, "ÜNÏ e0"), (6, "l1 ma8"), (7, "")]


@pytest.mark.parametrize("k,block_docs,postings", [(50, 65536, 4 << 20), (3, 7, 60), (1, 3, 10), (200, 11, 200)])
def test_equals_scoring_every_document(spark, monkeypatch, k, block_docs, postings):
    monkeypatch.setattr(lexical, "PARTITION_POSTINGS", postings)
    monkeypatch.setattr(lexical, "SLICE", 2)
    rows = cases.texts()
    assert rows_of(lexical.search(cases.documents(spark, rows), questions(spark, ASKED), k, block_docs)) == plain(rows, ASKED, k)


def test_copies_and_repeated_rows_take_ranks_of_their_own(spark):
    rows = [(i, "red fish") for i in range(200, 90, -1)] + [(5, "red fish")] * 3 + [(6, "Blue fish"), (7, "a b c"), (None, "red fish")] + [(300 + i, f"word{i}") for i in range(200)]
    items = [(1, "red"), (2, "fish blue")]
    assert rows_of(lexical.search(cases.documents(spark, rows), questions(spark, items), 20, 9)) == plain(rows, items, 20)


def test_terms_of_most_documents_weigh_nothing(spark):
    rows = [(i, "the " + "x" * (i % 3)) for i in range(30)]
    items = [(1, "the"), (2, "the x")]
    assert rows_of(lexical.search(cases.documents(spark, rows), questions(spark, items))) == plain(rows, items)


def test_filter_has_every_query_term(spark):
    asked = spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    wanted = lexical.Wanted(lexical.term_filter(asked))
    assert all(wanted[f"t{i}".encode()] for i in range(3000)) and sum(wanted[f"u{i}".encode()] for i in range(3000)) < 30


def test_thresholds_leave_nothing_out(spark):
    best = [5, 9, 9, 40, 41]
    given = spark.createDataFrame([(1, f"t{i}", 1, b) for i, b in enumerate(best)] + [(2, "t", 1, 7)], "item long, term string, weight long, best long")
    made = {r["item"]: r for r in lexical.thresholds(given, spark.createDataFrame([(1, 60)], "item long, bound long")).collect()}
    x = made[1]["threshold"] - 1
    assert sum(min(b, x) for b in best) < 60 <= sum(min(b, x + 1) for b in best) and made[1]["rest"] == sum(min(b, x) for b in best)
    assert (made[2]["threshold"], made[2]["rest"]) == (1, 0)  # no bound: everything is fetched


def test_empty_tables(spark):
    assert lexical.search(cases.documents(spark, []), questions(spark, ASKED)).count() == 0
    assert lexical.search(cases.documents(spark, [(1, None), (2, "")]), questions(spark, ASKED)).count() == 0
    assert lexical.search(cases.documents(spark), questions(spark, [])).count() == 0


def test_query_equals_sql(spark, sf):
    assert differences(spark, sf, queries.op11_search, queries.ORACLES["op11_search"]) == ""
