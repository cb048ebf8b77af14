"""Menus' operators on frames that have columns of any name, and edge rows of prices and periods."""

import datetime as dt

from pyspark.sql import functions as F

from sofra.operators import calendar, comments, menus


def test_columns_of_the_operators_own_names(spark):
    odd = ["key0", "price0", "parent_key", "n", "r", "old_id", "new_id", "period_start", "period_end", "__id", "__k", "up", "id"]
    frame = spark.range(3).select(F.col("id").alias("k"), *[F.lit(i).alias(c) for i, c in enumerate(odd) if c != "id"], F.col("id"))
    assert menus.tiered_price(frame, [("k", spark.createDataFrame([(1, 5)], "key long, price int"))]).orderBy("k").select("price").collect() == [(None,), (5,), (None,)]
    made = menus.documents(frame, spark.createDataFrame([(1, 2, "x")], "k long, at int, f string"), "k", "k", ["at"], ["f"])
    assert [len(r["items"]) for r in made.orderBy("k").collect()] == [0, 1, 0] and made.columns == [*frame.columns, "items"]
    state, history = menus.priority_upsert(frame, ["n"], "k", ["r"])
    assert state.columns == frame.columns and [r["k"] for r in state.collect()] == [2] and history.count() == 2
    assert sorted(r["k"] for r in menus.merge_ids(frame, spark.createDataFrame([(0, 1)], "old_id long, new_id long"), "k", ["k"]).collect()) == [1, 2]
    assert menus.first_source(frame, ["n"], "k").first()["k"] == 0
    assert calendar.latest(frame, ["n"], [F.col("k")]).columns == frame.columns
    tree = frame.select(F.col("k").alias("__id"), (F.col("k") - 1).alias("up"), "id", "__k")
    assert sorted(tuple(r) for r in comments.forest(tree, "__id", "up").collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_periods_and_blackout(spark):
    D = dt.date
    rows = spark.createDataFrame([(1, D(2026, 7, 1)), (2, D(2026, 9, 1)), (3, D(2030, 1, 1)), (4, None)], "id int, day date")
    periods = spark.createDataFrame([(D(2026, 1, 1), D(2026, 8, 31), 10), (D(2026, 9, 1), D(2026, 12, 31), 20)], "a date, b date, price int")
    got = menus.period_of(rows, periods, "day", "a", "b", ["price"]).select("id", "price", menus.blackout(F.col("day"), F.col("price")).alias("open")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 10, None), (2, 20, 20), (3, None, None), (4, None, None)]


def test_nearest_place_within_a_limit(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 90.0), (3, 1000.0)], "p int, x double")
    places = spark.createDataFrame([("a", 10.0), ("b", 80.0)], "name string, y double")
    got = {r["p"]: r["name"] for r in menus.nearest(points, places, F.abs(F.col("x") - F.col("y")), "p", "name", 150.0).collect()}
    assert got == {1: "a", 2: "b", 3: None}


def test_packages_of_both_diets(spark):
    rows = [("NORMAL", True), (None, False), ("COLYAK", None), ("Paket 1", True)]
    df = spark.createDataFrame(rows, "package string, ok boolean")
    of = lambda mode: [r["b"] for r in df.select(menus.diet_bucket(F.col("package"), F.col("ok"), mode).alias("b")).collect()]
    assert of(True) == ["items", None, "items", None] and of(False) == ["items", "items", None, "takeaways"]
