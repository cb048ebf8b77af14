"""Streams with state, report moves, the catalogue and trays."""

import datetime as dt
import itertools
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sofra.operators import catalogue, moderation, picks
from sofra.streaming import buckets, limits

START = dt.datetime(2026, 5, 1)
REQUESTS = "key string, ts timestamp, id long"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def decisions(df):
    return sorted((r["key"], r["id"], r["allowed"], round(r["wait_s"], 6)) for r in df.collect())


def test_stream_goes_on_from_its_checkpoint_and_forgets_idle_keys(spark):
    folder = tempfile.mkdtemp(prefix="spark-sofra-")
    r = random.Random(3)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            rows.append((r.choice(["a", "a", "a", "b", "c" if b in (0, 3) else "a"]), at(b * 1000 + r.randrange(990)), n))
            n += 1
        batches.append(rows)
    batches[2].append((None, at(2500), 9999))
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1)
    made = None
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if b in (1, 3):  # two runs of two micro-batches each
            made = buckets.run_limited(spark, stream.parquet(f"{folder}/in"), "key", "ts", "id", 2, 60.0, folder)
    whole = spark.createDataFrame([x for rows in batches for x in rows], REQUESTS)
    got = decisions(made)
    assert got == decisions(limits.token_bucket(whole, "key", "ts", "id", 2, 60.0)) and {x[2] for x in got} == {True, False}
    states = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{folder}/checkpoint")
    assert {x["key"]["key"] for x in states.collect()} <= {"a", "b", "c"}
    early = spark.read.format("statestore").option("stateVarName", "bucket").option("batchId", "2").load(f"{folder}/checkpoint")
    assert "c" not in {x["key"]["key"] for x in early.collect()}  # idle since the first micro-batch


def test_a_bucket_has_one_timer_that_looks_at_the_last_request():
    """Three round trips for a new key, two for a known one; none for timers that move."""
    from types import SimpleNamespace

    calls, state = [], {}
    put = lambda x: (calls.append("update"), state.update(x=x))
    bucket = SimpleNamespace(get=lambda: calls.append("get") or state.get("x"), update=put, clear=lambda: state.clear())
    one = buckets.Buckets(("key", "id"), 2, 60.0)
    one.init(SimpleNamespace(getValueState=lambda *_: bucket, registerTimer=lambda ms: calls.append(ms)))
    ask = lambda *at: [x for df in one.handleInputRows(("a",), iter([pd.DataFrame({"at": list(at), "order": range(len(at))})]), None) for x in df["allowed"]]
    assert ask(1_000_000, 0, 2_000_000) == [True, True, False] and calls == ["get", "update", 62_000]
    calls.clear()
    assert ask(40_000_000) == [True] and calls == ["get", "update"]
    seen = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    list(one.handleExpiredTimer(("a",), seen(70_000), None))
    assert calls[-1] == 100_000 and state
    list(one.handleExpiredTimer(("a",), seen(100_000), None))
    assert not state


def test_stream_without_input(spark):
    folder = tempfile.mkdtemp(prefix="spark-sofra-")
    spark.createDataFrame([], REQUESTS).write.parquet(f"{folder}/in")
    assert buckets.run_limited(spark, spark.readStream.schema(REQUESTS).parquet(f"{folder}/in"), "key", "ts", "id", 5, 60.0, folder).count() == 0


@pytest.mark.parametrize("method,path,key,kind", [
    ("POST", "/api/v1/comments/5/vote", False, "vote"), ("GET", "/api/v1/comments/5", False, "general"), ("PUT", "/api/v1/comments/5", False, "comment"), ("POST", "/api/v1/auth/login", False, "login"),
    ("POST", "/api/v1/auth/passwordless-login", False, "login"), ("POST", "/api/v1/auth/passwordless", False, "passwordless"), ("POST", "/api/v1/auth/reset-password", False, "forgot_password"),
    ("POST", "/api/v1/ingestion/x", False, "ingestion"), ("POST", "/api/v1/ingestion/x", True, None), ("GET", "/static/a.css", False, None),
])
def test_categories(spark, method, path, key, kind):
    assert spark.range(1).select(buckets.category(F.lit(method), F.lit(path), F.lit(key)).alias("k")).first()["k"] == kind


def test_short_limit_of_the_address_comes_first(spark):
    rows = [(i, "ip", "u:1" if i % 2 else "u:2", "vote", at(0)) for i in range(14)] + [(20 + i, "ip2", "u:3", "comment", at(i)) for i in range(8)] + [(40, "ip", "u:1", None, at(0))]
    df = spark.createDataFrame(rows, "id long, ip string, client string, kind string, ts timestamp")
    got = {r["id"]: (r["allowed"], r["by"]) for r in buckets.admitted(df, "ip", "client", "kind", "ts", "id").collect()}
    assert [got[i] for i in range(14)] == [(True, None)] * 10 + [(False, "spike")] * 4
    assert [got[20 + i] for i in range(8)] == [(True, None)] * 5 + [(False, "comment")] * 3 and got[40] == (True, None)


def plain_states(rows):
    """State after all actions, one by one."""
    out = {}
    for key, t, _, action in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        s, closed, hidden = out.get(key, ("none", None, False))
        if s == "purged":
            continue
        if action in ("approve", "reject") and s == "pending":
            closed = t
        out[key] = (moderation.MOVES.get(action, {}).get(s, s), closed, moderation.HIDES.get(action, hidden))
    return {k: v for k, v in out.items() if v[0] not in ("none", "purged")}


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_report_states_over_many_stretches(spark, parts):
    r = random.Random(parts)
    kinds = ["report", "approve", "reject", "reset", "other"]
    rows = [(r.choice([1, 1, 1, 1, 2, None]), at(r.randrange(300)), i, r.choice(kinds)) for i in range(2000)] + [(3, at(1), 5000, "report"), (3, at(2), 5001, "purge"), (3, at(3), 5002, "report"), (4, at(1), 5003, "approve")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "key int, ts timestamp_ntz, id int, action string").repartition(5)
        got = moderation.report_states(df, ["key"], "action", "ts", ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {x["key"]: (x["status"], x["resolved_at"], x["hidden"]) for x in got} == plain_states(rows) and len(got) == 3


def test_functions_compose_in_any_grouping(spark):
    """Stretches joined before the rest give what all actions give."""
    r = random.Random(1)
    for _ in range(40):
        actions = [r.choice(list(moderation.MOVES)) for _ in range(9)]
        tables = [moderation.TABLE[list(moderation.MOVES).index(a)] for a in actions]
        cut = r.randrange(1, 8)
        fold = lambda ts: [__import__("functools").reduce(lambda s, t: t[s], ts, i) for i in range(len(moderation.STATES))]
        left, right = fold(tables[:cut]), fold(tables[cut:])
        assert [right[s] for s in left] == fold(tables)


def test_new_reports_once_for_each_reporter(spark):
    new = spark.createDataFrame([("u", 1, 5), ("u", 1, 4), ("u", 2, 6), ("v", 1, 7), (None, 1, 8)], "reporter string, post int, id int")
    old = spark.createDataFrame([("v", 1)], "reporter string, post int")
    assert sorted((r["reporter"] or "", r["post"], r["id"]) for r in moderation.open_reports(new, old, ["reporter", "post"], ["id"]).collect()) == [("", 1, 8), ("u", 1, 4), ("u", 2, 6)]


DISHES, ALIASES, BATCH = "id long, name string, category string", "id long, name string, dish_id long", "name string, category string"


def both(made):
    return tuple(sorted(tuple(r) for r in t.collect()) for t in made)


def test_get_or_create_twice_changes_nothing(spark):
    dishes = spark.createDataFrame([(1, "Ayran", None), (4, "Pilav", "main")], DISHES)
    aliases = spark.createDataFrame([(1, "Ayran", 1), (2, "pilaf", 4), (3, "Çorba", None), (7, "Pilav", None)], ALIASES)
    batch = spark.createDataFrame([("Ayran", "drink"), ("Ayran", "a drink"), ("pilaf", "other"), ("Su", "drink"), ("Su", None), (None, "x"), ("Börek", None), ("Çorba", "soup")], BATCH)
    once = catalogue.get_or_create(batch, dishes, aliases)
    want = ([(1, "Ayran", "a drink"), (4, "Pilav", "main"), (5, "Börek", None), (6, "Su", "drink"), (7, "Çorba", "soup")], [(1, "Ayran", 1), (2, "pilaf", 4), (3, "Çorba", 7), (7, "Pilav", 4), (8, "Börek", 5), (9, "Su", 6)])
    assert both(once) == want
    assert both(catalogue.get_or_create(batch, *once)) == want
    empty = spark.createDataFrame([], DISHES), spark.createDataFrame([], ALIASES)
    assert both(catalogue.get_or_create(spark.createDataFrame([("b", None), ("a", "x")], BATCH), *empty)) == ([(1, "a", "x"), (2, "b", None)], [(1, "a", 1), (2, "b", 2)])
    assert both(catalogue.get_or_create(spark.createDataFrame([], BATCH), *empty)) == ([], [])


def test_numbers_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "RANGE_ROWS", 50)
    names = spark.range(700).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).repartition(6)
    got = catalogue.numbered(names, ["name"], 11).collect()
    assert {r["name"]: r["id"] for r in got} == {n: 11 + i for i, n in enumerate(sorted(f"n{i}" for i in range(700)))}


def test_chains_circles_and_forks(spark):
    pairs = [(i, i - 1) for i in range(101, 130)] + [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 7), (6, 8), (9, 9), (10, 11), (11, 10)]
    got = {r["old_id"]: r["new_id"] for r in catalogue.resolved(spark.createDataFrame(pairs, "old_id long, new_id long")).collect()}
    assert got == {i: 100 for i in range(101, 130)} | {6: 7}


def test_merge_moves_children_once(spark):
    dishes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    votes = spark.createDataFrame([(2, "u", 5), (1, "u", 6), (3, "v", 7), (None, "w", 8)], "dish long, user string, n int")
    left, moved = catalogue.merge_dishes(dishes, {"votes": (votes, "dish", ["dish", "user"]), "log": (votes, "dish", [])}, spark.createDataFrame([(2, 1), (3, 2)], "old_id long, new_id long"))
    assert [r["id"] for r in left.collect()] == [1]
    assert sorted(tuple(r) for r in moved["votes"].where("dish IS NOT NULL").collect()) == [(1, "u", 6), (1, "v", 7)] and moved["votes"].where("dish IS NULL").count() == 1
    assert sorted(r["n"] for r in moved["log"].collect()) == [5, 6, 7, 8]


def test_renames_are_not_sent_to_the_driver(spark):
    dishes = spark.range(1, 40).select("id", F.lit("x").alias("name"))
    renames = dishes.where("id > 1").select(F.col("id").alias("old_id"), (F.col("id") - 1).alias("new_id"))
    ends = catalogue.resolved(renames)
    left, moved = catalogue.merge_dishes(dishes, {"n": (dishes, "id", ["id"])}, renames)
    for df in (ends, left, moved["n"]):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert ends.count() == 38 and [r["id"] for r in left.collect()] == [1] and [r["id"] for r in moved["n"].collect()] == [1]


def test_patterns_name_their_targets(spark):
    dishes = spark.createDataFrame([(1, "Ayran"), (2, "ayran 200 ml"), (3, "AYRAN büyük"), (4, "Su")], "id long, name string")
    patterns = spark.createDataFrame([("ayran%", "Ayran"), ("%", "nowhere")], "pattern string, target string")
    assert sorted(tuple(r) for r in catalogue.by_patterns(dishes, patterns).collect()) == [(2, 1), (3, 1)]


def test_four_items_near_a_budget(spark):
    r = random.Random(7)
    for n in range(0, 14):
        prices = np.array(sorted(r.randrange(1, 60) for _ in range(n)), np.int64)
        for budget in (3, 40, 90, 120, 400):
            sums = [sum(c) for c in itertools.combinations(prices.tolist(), 4) if sum(c) <= budget]
            found = picks.nearest_four(prices, budget)
            assert (found is None) == (not sums)
            if found:
                assert len(set(found)) == 4 and sum(prices[list(found)]) == max(sums)
    rows = [("m", i, p) for i, p in enumerate([10, 20, 30, 40, 50, None, 999])] + [("few", 1, 5), ("few", 2, 5)]
    got = {x["menu"]: (x["total"], x["items"]) for x in picks.trays(spark.createDataFrame(rows, "menu string, id int, price long"), "menu", "id", F.col("price"), 125).collect()}
    assert got["few"] == (None, None) and got["m"][0] == 120 and len(got["m"][1]) == 4


def test_four_of_very_many_items(spark):
    """48,000 items of 1,000 prices, some of which are needed twice; searches over all pairs of items take minutes."""
    prices = np.array([90000 + 10 * (i % 1000) for i in range(48000)], np.int64)
    for budget, total in ((399905, 399900), (360019, 360010), (359999, None), (10**9, 4 * 99990)):
        found = picks.nearest_four(prices, budget)
        assert (None if found is None else (len(set(found)), sum(prices[list(found)]))) == (None if total is None else (4, total))
    items = spark.range(4000).select((F.col("id") % 2).alias("menu"), "id", (F.col("id") % 20 * 10).alias("price"))
    assert {r["menu"]: (r["total"], len(set(r["items"]))) for r in picks.trays(items, "menu", "id", F.col("price"), 645).collect()} == {0: (640, 4), 1: (640, 4)}


def test_day_reviews(spark):
    from sofra.operators import cards

    rows = [("a", "dinner", 1, "sote nohut"), ("a", "breakfast", 2, "çay"), ("a", "lunch", 1, "zzz"), ("b", "dinner", 1, "xq"), ("c", "dinner", 1, None), ("d", "dinner", 1, "nohut")]
    items = spark.createDataFrame(rows, "day string, meal string, at int, name string")
    far = spark.createDataFrame([("d", 0.7), ("a", 0.65)], "day string, distance double")
    got = {r["day"]: (r["n_items"], r["trust"], r["text"], r["status"]) for r in cards.day_reviews(items, "day", "meal", "name", ["at"], ("nohut", "çay"), far, ("breakfast", "dinner")).collect()}
    assert got == {"a": (2, 75, "çay sote nohut", "approved"), "b": (1, 0, "xq", "needs_review"), "c": (0, 0, "", "needs_review"), "d": (1, 100, "nohut", "needs_review")}
    assert cards.day_reviews(items.limit(0), "day", "meal", "name", ["at"], ("x",)).count() == 0


def test_selection_of_menus(spark):
    from sofra.operators import cards

    df = spark.createDataFrame([(1, 1, dt.date(2026, 12, 31)), (2, 1, dt.date(2027, 1, 1)), (3, 2, dt.date(2026, 12, 1))], "id int, city_id int, serve_date date")
    ids = lambda **by: sorted(r["id"] for r in cards.selected(df, **by).collect())
    assert ids(year=2026, month=12) == [1, 3] and ids(city=1) == [1, 2] and ids(city=9) == [] and ids(year=2026) == [1, 2, 3]
    assert ids(day=dt.date(2027, 1, 1), year=2026, month=12) == [2]  # a day makes the month void
    x = spark.range(1).select(cards.adjacent_distinct(F.array(*[F.lit(v) for v in "aabba"])).alias("x")).first()["x"]
    assert x == ["a", "b", "a"]


def test_captions_and_slots(spark):
    from sofra.operators import cards

    menus = spark.createDataFrame([(1, "x", 100, 200), (2, "x", 300, None), (3, "y", None, None)], "id int, city string, calories_min int, calories_max int")
    items = spark.createDataFrame([(1, 0, False, "a"), (1, 2, True, "c"), (1, 2, False, "b"), (2, 0, False, "d")], "menu_id int, at int, alt boolean, name string")
    assert sorted(tuple(r) for r in cards.day_captions(menus, items, ["city"]).collect()) == [("x", 4, "100 - 200 kcal"), ("y", 0, None)]
    assert sorted((r["menu_id"], r["slot"], r["names"]) for r in cards.slots(items, "menu_id", "at", "alt", "name").collect()) == [(1, 0, ["a"]), (1, 1, ["b", "c"]), (2, 0, ["d"])]


SUBS = "id int, city_id int, breakfast_on boolean, breakfast_time string, dinner_on boolean, dinner_time string"


def test_notifier_stream_says_each_thing_once(spark):
    from sofra.streaming import notifier

    subs = spark.createDataFrame([(1, 5, True, "08:00", True, "17:30"), (2, 6, False, "08:00", True, "17:30"), (3, None, True, "08:00", True, "08:00"), (4, 7, True, "08:00", False, "08:00")], SUBS)
    D = dt.date(2026, 5, 1)
    menus = spark.createDataFrame([(5, D, "breakfast", ["Su böreği", "çay"]), (5, D, "dinner", ["Su", "Mercimek Çorbası", "Tavuk Sote"]), (6, D, "dinner", []), (7, D, "breakfast", ["ekmek"])], "city_id int, day date, meal string, dishes array<string>")
    cities = spark.createDataFrame([(5, "Iğdır")], "id int, name string")
    folder = tempfile.mkdtemp(prefix="spark-sofra-")
    minute = lambda h, m: [(dt.datetime(2026, 5, 1, h, m),)]
    spark.createDataFrame(minute(8, 0) + minute(8, 1), "tick timestamp").write.mode("append").parquet(f"{folder}/ticks")
    stream = lambda: spark.readStream.schema("tick timestamp").parquet(f"{folder}/ticks")
    first = notifier.run_notifier(spark, stream(), subs, menus, cities, folder).collect()
    assert sorted((r["id"], r["meal"], r["url"]) for r in first) == [(1, "breakfast", "/igdir"), (4, "breakfast", "/yurt")]
    spark.createDataFrame(minute(8, 0) + minute(17, 30), "tick timestamp").write.mode("append").parquet(f"{folder}/ticks")
    got = {(r["id"], r["meal"]): (r["title"], r["body"]) for r in notifier.run_notifier(spark, stream(), subs, menus, cities, folder).collect()}
    assert len(got) == 3 and got[1, "dinner"][0] == "Iğdır - akşam yemeği" and "Tavuk Sote" in got[1, "dinner"][1] and "Su böreği" in got[1, "breakfast"][1]


def test_notifier_writes_texts_before_subscriptions_meet_them(spark):
    """What a menu says is below the join with subscriptions in the plan, so it isn't written anew for each of them."""
    from sofra.streaming import notifier

    D = dt.date(2026, 5, 1)
    ticks, subs = spark.createDataFrame([(dt.datetime(2026, 5, 1, 8, 0),)], "tick timestamp"), spark.createDataFrame([(1, 5, True, "08:00", False, "17:30")], SUBS)
    menus, cities = spark.createDataFrame([(5, D, "breakfast", ["Börek", "çay"])], "city_id int, day date, meal string, dishes array<string>"), spark.createDataFrame([(5, "Iğdır")], "id int, name string")
    made = notifier.notifications(ticks, subs, menus, cities, {"plain": ("{all}",), "hot": ("{dish}!", "{dish}!")})
    top = made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Tavuk" not in top and "array_join" not in top and "contains" not in top.lower()
    assert [(r["title"], r["body"], r["url"]) for r in made.collect()] == [("Iğdır - kahvaltı", "Börek!", "/igdir")]


def test_dropzone_with_damaged_and_waiting_files(spark, tmp_path):
    import json

    from sofra.streaming import dropzone

    zone, folder = tmp_path / "zone", f"file://{tmp_path}/out"

    def put(city, name, body):
        (zone / city).mkdir(parents=True, exist_ok=True)
        (zone / city / name).write_text(body)

    sheet = lambda dish: json.dumps({"sheets": [{"name": "AKŞAM", "rows": [["5.5.2026"], [dish], ["su"]]}]})
    put("igdir", "a.json", sheet("nohut"))
    put("igdir", "bad.json", "{broken")
    put("igdir", "empty.json", " \n")
    put("mars", "m.json", sheet("toz"))
    cities = lambda *rows: spark.createDataFrame(list(rows), "id int, slug string")
    run = lambda c: [x.collect() for x in dropzone.run_dropzone(spark, f"file://{zone}", c, folder, F.lit("2026-05-20").cast("date"), str(tmp_path / "archive"))]
    menus, errors, queue = run(cities((76, "igdir")))
    names = lambda ms: sorted((r["city_id"], r["file"], r["alternatives"][0]["name"]) for r in ms)
    assert names(menus) == [(76, "a.json", "Nohut"), (76, "a.json", "Su")]
    assert sorted((r["file"], r["reason"]) for r in errors) == [("bad.json", "not the JSON of sheets"), ("empty.json", "empty file")] and [(r["city"], r["file"]) for r in queue] == [("mars", "m.json")]
    put("igdir", "b.json", json.dumps({"sheets": []}))
    menus, errors, queue = run(cities((76, "igdir")))
    assert len(menus) == 2 and {r["file"]: r["reason"] for r in errors}["b.json"] == "no sheets" and len(queue) == 1
    menus, errors, queue = run(cities((76, "igdir"), (99, "mars")))
    assert names(menus) == [(76, "a.json", "Nohut"), (76, "a.json", "Su"), (99, "m.json", "Su"), (99, "m.json", "Toz")] and len(errors) == 3 and not queue
