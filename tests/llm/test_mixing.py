"""Sources without end, and the tree of several levels."""

import math
import random
from collections import Counter

import pytest

from sofra.llm import mixing
from tests.llm import cases


@pytest.mark.parametrize("n,cycle,share,limit", [(1, (3, 1, 2), 1.5, 2.0), (40, (3, 1, 2), 1.5, 2.0), (300, (5, 1), 1.9, 2.0), (60, (1,), 0.1, 2.0)])
def test_targets_of_many_sources_equal_the_plain_loop(spark, monkeypatch, n, cycle, share, limit):
    monkeypatch.setattr(mixing, "SOURCE_ROWS", 17)
    r = random.Random(n)
    sizes = {None if i == 0 and n > 1 else f"s{r.randrange(10**6)}ğ{i}": int(10 ** r.uniform(0, 5)) if i % 9 else 0 for i in range(n)} | {"big": 10**6}
    made = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, s long"), cycle, share, limit).collect()
    want = mixing.targets(sizes, cycle, share, limit)
    assert {x["of"] for x in made} == set(want)
    assert all(math.isclose(x["target"], want[x["of"]], rel_tol=1e-9, abs_tol=1e-9) and x["source_size"] == sizes[x["of"]] for x in made)


@pytest.mark.parametrize("rows_a_bucket,fan", [(10, 4), (40, 64)])
def test_a_tree_of_several_levels_keeps_the_targets(spark, monkeypatch, rows_a_bucket, fan):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_a_bucket)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    r = random.Random(6)
    docs = cases.documents(spark, [(i, " ".join(["w"] * r.randrange(0, 300))) for i in range(900)]).cache()
    got = mixing.mix(docs).collect()
    assert len(got) == 900 and all(x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 2 for x in got)
    taken, target = Counter(), {}
    for x in got:
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    again = {(x["doc_id"], x["copies"]) for x in mixing.mix(docs).collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in got}


def test_copies_follow_their_shares_whatever_the_size(spark, monkeypatch):
    """Short, middle and long documents of one source are taken in the same share, so no length is favoured."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, " ".join(["w"] * (3 + 40 * (i % 3)))) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows] + [(9000 + i, "w " * 2000, "b") for i in range(30)], "doc_id long, text string, source string")
    got = [x for x in mixing.mix(docs).collect() if x["source"] == "a"]
    share = got[0]["target"] / got[0]["source_size"]
    for kind in range(3):
        mine = [x["copies"] for x in got if x["doc_id"] % 3 == kind]
        assert abs(sum(mine) / len(mine) - share) < 4 * 0.5 / math.sqrt(len(mine))
