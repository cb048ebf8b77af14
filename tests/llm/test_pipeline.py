import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sofra.llm import toxicity
from sofra.llm.common import materialise
from tests.llm import brute, cases

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows):
    data = [(i, t, "en", None if n % 7 == 0 else f"s{n % 4}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grumblefrotz" in (t or ""))) for i, t in rows[:200] if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on its predecessor's result: who goes, what is cut, what is taken, what is packed."""
    toxic = [(1000 + n, " ".join("grumblefrotz" if k % 4 == 0 else f"word{(n * k) % 31}" for k in range(40))) for n in range(90)]
    rows = toxic + cases.texts() + [(400, None), (103, "one")]
    folder = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"]

    scored = {(r["doc_id"]): r["predicted"] for r in toxicity.detect(docs, labels).collect()}
    clean = materialise(stages["toxicity"](spark, docs, folder))
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if not scored[i])
    assert not any("grumblefrotz" in (r["text"] or "") for r in clean.collect())

    unique = materialise(stages["near_dedup"](spark, clean, folder))
    nodes = sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in clean.collect()}, key=str)
    number = {k: n for n, k in enumerate(sorted(nodes, key=lambda k: (k[0], str(k[1]))))}
    groups: dict = {}
    for n, (_, comp) in brute.components([(number[k], k[1]) for k in nodes], 5).items():
        groups.setdefault(comp, []).append(n)
    back = {n: k for k, n in number.items()}
    kept = {(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in unique.collect()}
    assert unique.columns == docs.columns and unique.count() == len(groups) == len(kept)
    for members in groups.values():  # one of each, and it has the smallest id
        own = [back[n] for n in members if back[n] in kept]
        assert len(own) == 1 and own[0][0] == min(back[n][0] for n in members)

    cut = materialise(stages["suffix_dedup"](spark, unique, folder))
    by_id = {-1 if r["doc_id"] is None else r["doc_id"]: r["text"] for r in unique.collect()}
    want = brute.repeated(list(by_id.items()))
    assert cut.columns == docs.columns and cut.count() == unique.count()
    for r in cut.collect():
        i = -1 if r["doc_id"] is None else r["doc_id"]
        left = len(r["text"].encode()) - (want[i][0] - want[i][1])
        assert 0 <= left <= 6 * want[i][2] and r["n_chars"] == len(r["text"])  # a cut character stays whole

    mixed = materialise(stages["mixing"](spark, cut, folder))
    words = lambda t: len((t or "").encode().split())
    sizes = [words(r["text"]) for r in cut.collect()]
    taken = sum(words(r["text"]) for r in mixed.collect())
    assert mixed.columns == docs.columns and abs(taken - 1.5 * sum(sizes)) <= max(sizes)  # one text has most of the words
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2

    packed = stages["packing"](spark, mixed, folder)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == tokens == corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
