from sofra.llm import suffix_dedup
from sofra.llm.common import read
from tests.llm import brute, cases


def as_brute(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert as_brute(suffix_dedup.digests(docs)) == brute.repeated(rows)


def test_odd_rows(spark):
    rows = cases.texts()
    got = as_brute(suffix_dedup.digests(cases.documents(spark, rows)))
    known = [(-1 if i is None else i, t) for i, t in rows]  # a null id is the smallest
    want = brute.repeated(known)
    want[None] = want.pop(-1)
    assert got == want


def test_repeated_rows_keep_their_bytes(spark):
    text = "the same long text of more than fifty bytes, given twice under one id"
    got = suffix_dedup.digests(cases.documents(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, len(text))]


def test_empty_table(spark):
    assert suffix_dedup.digests(cases.documents(spark, [])).count() == 0
    assert suffix_dedup.cleaned(cases.documents(spark, [])).count() == 0


def test_cleaned_keeps_columns_and_characters(spark):
    rows = cases.texts()
    docs = cases.documents(spark, rows)
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs).collect()}
    for r in out.collect():
        before = next(t for i, t in rows if i == r["doc_id"]) or ""
        lost = len(before.encode()) - len(r["text"].encode())
        assert 0 <= removed[r["doc_id"]] - lost <= 6 * 4 or lost == removed[r["doc_id"]]


def test_ids_of_text_and_clashing_names(spark):
    """Text ids order as texts do; columns may be called as the operator's own."""
    passage = " ".join(f"shared{i}" for i in range(20))
    rows = [("b", f"{passage} one tail"), ("a", f"head of a {passage}"), (None, f"x {passage} y"), ("c", "short"), ("d", None)]
    data = [(i, t, n, "x", b"y", "z", "w") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id string, text string, num int, tag string, body binary, bucket string, row string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs).collect()}
    want = brute.repeated([({None: 0, "a": 1, "b": 2, "c": 3, "d": 4}[i], t) for i, t in rows])
    assert got == {i: want[{None: 0, "a": 1, "b": 2, "c": 3, "d": 4}[i]][1] for i, _ in rows}
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert sorted((r["num"], r["tag"], r["bucket"], r["row"]) for r in out.collect()) == [(n, "x", "z", "w") for n in range(5)]


def test_marks_dealt_by_window(spark, monkeypatch):
    """Every mark by the route of the very frequent ones."""
    rows = [x for x in cases.texts() if x[0] is not None]
    monkeypatch.setattr(suffix_dedup, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_TIMES", 2)
    assert as_brute(suffix_dedup.digests(cases.documents(spark, rows))) == brute.repeated(rows)
