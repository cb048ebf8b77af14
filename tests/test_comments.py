from sofra.operators import comments


def test_deep_chains_orphans_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 999), (1001, 1000), (2000, 2001), (2001, 2000), (2002, 2001), (2003, 2003)]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in comments.forest(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert got == {i: (0, i) for i in range(300)} | {1000: (1000, 0), 1001: (1000, 1)} | {i: (None, None) for i in range(2000, 2004)}
