import os
import random

import pytest

from sofra.llm import near_dedup
from sofra.llm.common import read
from tests.llm import brute, cases


def as_brute(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, sf, k):
    docs = read(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert as_brute(near_dedup.near_duplicates(docs, k=k)) == brute.components(rows, k)


def test_odd_rows(spark):
    rows = [x for x in cases.texts() if x[0] is not None]
    assert as_brute(near_dedup.near_duplicates(cases.documents(spark, rows), k=2)) == brute.components(rows, 2)


def test_large_nodes_of_unlike_documents(spark):
    """A passage that many share, groups of near copies around it, and pairs just above and below the limit."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(passage + [f"u{i}.{j}" for j in range(r.randrange(2, 14))])))
    for i in range(150, 220):
        base = passage + [f"v{i % 9}.{j}" for j in range(30)]
        for _ in range(r.randrange(6)):
            base[r.randrange(len(base))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    r.shuffle(rows)
    got = as_brute(near_dedup.near_duplicates(cases.documents(spark, rows), k=2))
    assert got == brute.components(rows, 2)


def test_null_id_and_repeated_rows(spark):
    text = "some words that are here more than once and again"
    got = near_dedup.near_duplicates(cases.documents(spark, [(None, text), (3, text), (3, text), (5, "else"), (6, None)]), k=2).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("3", None, False), ("3", None, False), ("5", 5, True), ("6", 6, True), ("None", None, True)]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(cases.documents(spark, [])).count() == 0


def test_representatives_keep_columns(spark):
    rows = cases.texts()
    docs = cases.documents(spark, rows)
    out = near_dedup.representatives(docs, k=5)
    assert out.columns == docs.columns
    known = brute.components([x for x in rows if x[0] is not None], 5)
    assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {i for i, (_, c) in known.items() if i == c}


def test_rows_that_share_an_id_or_have_none(spark):
    """Unlike texts stay, whatever their ids, and do not join what is near them."""
    far = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    near = lambda t: t + " more"
    rows = [(None, far[0]), (None, far[1]), (None, far[2]), (5, near(far[0])), (9, near(far[1])), (7, far[3]), (7, far[4]), (8, near(far[4])), (7, far[4]), (10, far[5]), (10, near(far[5]))]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(cases.documents(spark, rows), k=2).collect()}
    assert got == {(None, None, True), (5, None, False), (9, None, False), (7, 7, True), (8, 7, False), (10, 10, True), (10, 10, False)}
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_dedup.representatives(cases.documents(spark, rows), k=2).collect())
    assert [x for x in kept if x[0] != "10"] == sorted([("None", t) for t in far[:3]] + [("7", t) for t in far[3:5]])
    assert len(kept) == 6


def test_a_repeated_row_beside_a_near_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 40 + [(3, text + " more")] * 40
    got = near_dedup.near_duplicates(cases.documents(spark, rows), k=2)
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"], r["count"]) for r in got.groupBy("doc_id", "component_id", "kept").count().collect()) == [("3", None, False, 40), ("None", None, True, 40)]
    assert near_dedup.representatives(cases.documents(spark, rows), k=2).count() == 1


def test_trees_reach_their_recall(spark):
    """Pairs of just the similarity among many alike documents, by the trees alone: few are in no common node."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(300):
        base = r.sample(common, 8) + [f"u{i}.{j}" for j in range(60)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-7] + [f"v{i}.{j}" for j in range(7)]))]
    docs = cases.documents(spark, rows)
    nodes = near_dedup.sketches(docs, 1).select("doc_id", "id", "n", "tokens", "lo", "hi").cache()
    of = {x["id"]: x["doc_id"] for x in nodes.collect()}
    for room in (4096, 20):  # in single tasks; with nodes that are split over tasks
        pairs, many = near_dedup.grown(nodes, 0.8, 6, room=room)
        met = {of[x["a"]] // 2 for x in pairs.collect() if of[x["a"]] // 2 == of[x["b"]] // 2}
        by = {}
        for x in many.select("path", "id").collect():
            by.setdefault(x["path"], set()).add(of[x["id"]])
        met |= {i for members in by.values() for i in range(300) if {2 * i, 2 * i + 1} <= members}
        assert len(met) >= 297
    assert near_dedup.plan(0.8)[0] <= 16 and near_dedup.plan(0.95)[0] < near_dedup.plan(0.8)[0]


def test_nodes_over_several_steps_of_a_task(spark, sf, monkeypatch):
    """Nodes that begin in one batch of a task and end in another."""
    docs = read(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(near_dedup, "STEP_ROWS", 50)
    assert as_brute(near_dedup.near_duplicates(docs, k=2)) == brute.components(rows, 2)


def rare_rows(sets, similarity=0.8):
    """Prefix rows of sets of numbers, as rarest() gives them, each set a component of its own, all samples alike."""
    df = {}
    for s in sets:
        for t in s:
            df[t] = df.get(t, 0) + 1
    out = []
    for i, s in enumerate(sets):
        m = len(s)
        for place, t in enumerate(sorted(s, key=lambda t: (df[t], t)), 1):
            if df[t] > 1 and place <= m - -(-m * round(100 * similarity) // 100) + 1:
                out.append((i, t, place, m, m, 0, 0, i, i % 3 != 0))
    return out


RARE = "id long, token long, place long, m long, n long, lo long, hi long, comp long, minor boolean"


def test_rare_pairs_miss_no_similar_pair(spark):
    r = random.Random(4)
    bases = [r.sample(range(3000), r.randrange(3, 120)) for _ in range(12)]
    sets = [set(r.choice(bases)) for _ in range(160)]
    for s in sets:
        for t in r.sample(sorted(s), r.randrange(0, max(1, len(s) // 5))):
            s.remove(t)
        s.update(r.randrange(3000, 3400) for _ in range(r.randrange(0, max(1, len(s) // 6))))
    found = {(x["a"], x["b"]) for x in near_dedup.rare_pairs(spark.createDataFrame(rare_rows(sets), RARE), 0.8).collect()}
    near = {(i, j) for i in range(160) for j in range(i + 1, 160) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and (i % 3 or j % 3)}
    assert len(near) > 300 and near <= found
    assert all(i % 3 or j % 3 for i, j in found)


def test_documents_around_one_passage_pair_with_none(spark):
    """However many share the passage: their own words leave too little of it for a pair."""
    for n in (300, 1200):
        sets = [set(range(40)) | {1000 + 20 * i + j for j in range(6 + i % 4)} for i in range(n)]
        assert near_dedup.rare_pairs(spark.createDataFrame(rare_rows(sets), RARE), 0.8).count() == 0


def test_components_are_looked_up_once_for_each_set(spark, monkeypatch):
    """However many nodes a set is in, the join with components has one row for it."""
    import random

    from sofra.llm import near_dedup as nd

    r = random.Random(2)
    rows = [(p, i, 9, i, -i) for p in range(40) for i in r.sample(range(30), 12)]
    comp = {i: i % 2 for i in range(24)}  # the others have none, and are their own
    plans, plain = [], nd.materialise
    monkeypatch.setattr(nd, "materialise", lambda df, *codec: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *codec))[1])
    made = nd.mixed_nodes(spark.createDataFrame(rows, "path long, id long, n long, lo long, hi long"), spark.createDataFrame(list(comp.items()), "id long, comp long"))
    want = []
    for p in range(40):
        of = {i: comp.get(i, i) for q, i, *_ in rows if q == p}
        main = max((list(of.values()).count(c), c) for c in of.values())[1]
        want += [(p, i, 9, i, -i, c, main) for i, c in of.items() if len(set(of.values())) > 1]
    assert sorted(tuple(x[c] for c in ("path", "id", "n", "lo", "hi", "comp", "main")) for x in made.collect()) == sorted(want)
    assert plans[0].index("Generate explode") < plans[0].index("Join LeftOuter") < plans[0].index("Aggregate")


def test_filter_misses_none(spark):
    """Of what it was made of all pass, and few others; sets of needed texts are made without a shuffle by id."""
    ids = spark.range(-3000, 3000).selectExpr("xxhash64(id) AS id")
    other = spark.range(10000, 30000).selectExpr("xxhash64(id) AS id")
    among = lambda rows, of: near_dedup.flagged(rows, "id", of).where("may").count()
    assert among(ids, ids) == 6000 and among(other, ids) < 40 and among(ids, ids.limit(0)) == 0
    docs = cases.documents(spark, [(i, f"some words of text number {i}") for i in range(50)])
    sets = near_dedup.shingle_sets(docs, docs.where("doc_id < 5").select(near_dedup.node().alias("id")), 2)
    assert sets.count() == 5 and "SortMergeJoin" not in sets._jdf.queryExecution().executedPlan().toString()


def test_representatives_leave_no_tables(spark, tmp_path):
    """Of the tables written on the way only those that say which documents stay are left: one of ids, two of bits."""
    before = set(near_dedup_tables(spark))
    rows = [(i, f"some words of text number {i % 30} that come back, and then some more of them {i % 30}") for i in range(90)] + [(7, "twice"), (7, "twice")]
    out = near_dedup.representatives(cases.documents(spark, rows), k=2)
    assert len(set(near_dedup_tables(spark)) - before) == 3
    assert sum(r["text"] == "twice" for r in out.collect()) == 1


def near_dedup_tables(spark):
    from sofra.llm.common import scratch_dir

    return os.listdir(scratch_dir(spark).removeprefix("file://").removeprefix("file:"))
