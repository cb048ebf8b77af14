"""All queries of the library's own operators, bound to the tables of a folder, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, guard, names, scalars
from ..operators import calendar, chain, comments, menus, stats, votes
from ..session import shared_folder, table
from ..sources import files
from ..streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIGN = {"A": 1, "R": -1}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def board(spark, d, lines, **options):
    top = votes.leaderboard(table(spark, d, "part").select("p_partkey", "p_name"), lines, "p_partkey", "l_partkey", sentiment="l_returnflag", sign=SIGN, **options)
    return top.select("p_partkey", "p_name", "n_votes", "n_up", "score", F.round("positive_ratio", 6).alias("positive_ratio"))


BOARD = """SELECT p_partkey, p_name, count(*) AS n_votes, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n_up,
CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS BIGINT) AS score,
round(sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 6) AS positive_ratio
FROM part JOIN lineitem ON p_partkey = l_partkey {where} GROUP BY p_partkey, p_name {having} ORDER BY score {way}, p_partkey LIMIT {limit}"""


@query(BOARD.format(where="", having="", way="DESC", limit=100))
def q01_dish_leaderboard(spark, d):
    return board(spark, d, table(spark, d, "lineitem"), limit=100)


@query(BOARD.format(where="JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3", having="", way="DESC", limit=50))
def q02_leaderboard_city(spark, d):
    of_city = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return board(spark, d, table(spark, d, "lineitem").join(of_city, "l_suppkey", "left_semi"), limit=50)


@query(BOARD.format(where="WHERE l_shipdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY", having="", way="DESC", limit=20))
def q03_leaderboard_window(spark, d):
    return board(spark, d, table(spark, d, "lineitem"), limit=20, timeframe="yearly", time="l_shipdate", as_of=moment("2000-01-01"))


@query(BOARD.format(where="", having="HAVING sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) < 0", way="ASC", limit=30))
def q04_worst_dishes(spark, d):
    return board(spark, d, table(spark, d, "lineitem"), limit=30, direction="asc", signed_only=True)


@query("""SELECT l_suppkey, count(*) AS n_votes, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS n_up, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_down,
CAST(count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS score FROM lineitem GROUP BY l_suppkey""")
def q05_vote_summary(spark, d):
    return votes.vote_summary(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", SIGN)


@query("""SELECT p AS pending, f AS resolved, o AS dismissed, p + f + o AS total, CASE WHEN p + f + o > 0 THEN (f + o) * 100 // (p + f + o) END AS resolution_rate
FROM (SELECT count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders)""")
def q06_status_rate(spark, d):
    return stats.status_counts(table(spark, d, "orders"), "o_orderstatus", {"pending": "P", "resolved": "F", "dismissed": "O"})


@query("""SELECT category, n, floor(n * 1000.0::DOUBLE / sum(n) OVER () + 0.5) / 10.0 AS percentage FROM (SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1)""")
def q07_category_share(spark, d):
    return stats.distribution(table(spark, d, "orders"), F.col("o_orderstatus"))


def _case(cases, default, column):
    parts = " ".join("WHEN " + " OR ".join(f"{column} ILIKE '%{w}%'" for w in ws) + f" THEN '{label}'" for label, ws in cases)
    return f"CASE {parts} ELSE '{default}' END"


@query(f"""SELECT category, n, floor(n * 1000.0::DOUBLE / sum(n) OVER () + 0.5) / 10.0 AS percentage FROM (SELECT {_case(scalars.REASONS, scalars.REASON_ELSE, "text")} AS category, count(*) AS n FROM documents GROUP BY 1)""")
def q08_reason_bucket(spark, d):
    return stats.reasons(table(spark, d, "documents"), "text")


@query("""SELECT event_type AS tag, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, tag LIMIT 4""")
def q09_trending(spark, d):
    events = table(spark, d, "events")
    tags = events.select(F.col("event_type").alias("tag")).distinct()
    return stats.trending(events, tags, "event_type", "tag", "ts", moment("2024-01-31"), limit=4).select("tag", "n")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Anonim' ELSE c_name END AS c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY n DESC, c_custkey LIMIT 5""")
def q10_contributors_masked(spark, d):
    top = stats.top_contributors(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")
    return top.select("c_custkey", stats.masked_contributor("c_name", "c_mktsegment", F.col("c_custkey") % 5 == 0)[0], "n")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate IS NOT NULL")
def q11_months(spark, d):
    return stats.months(table(spark, d, "orders"), "o_orderdate")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderdate IS NOT NULL")
def q12_years(spark, d):
    return stats.years(table(spark, d, "orders"), "o_orderdate")


@query("SELECT p_partkey, count(l_partkey) AS n_used FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def q13_usage_incl_zero(spark, d):
    return stats.usage_with_zero(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem"), "p_partkey", "l_partkey")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1, 2")
def q14_reactions(spark, d):
    return votes.reaction_summary(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", "click", "error", "user_id")


@query("""SELECT CAST(s.day AS DATE) AS day, count(event_id) AS requests FROM generate_series(DATE '2024-01-03', DATE '2024-01-30', INTERVAL 1 DAY) AS s(day) LEFT JOIN events ON CAST(ts AS DATE) = CAST(s.day AS DATE) AND user_id = 7 GROUP BY 1""")
def q15_zero_fill_usage(spark, d):
    usage = table(spark, d, "events").where("user_id = 7").select(F.to_date("ts").alias("date"), F.lit(1).alias("requests"))
    return calendar.zero_filled(usage, "date", ["requests"], F.lit("2024-01-30").cast("date"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES) + " UNION ALL SELECT 'total', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES))
def q16_table_counts(spark, d):
    return stats.table_counts({t: table(spark, d, t) for t in TABLES})


@query("""SELECT CAST(s.day AS DATE) AS day, user_id FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS s(day) CROSS JOIN (SELECT DISTINCT user_id FROM events)
EXCEPT SELECT CAST(ts AS DATE), user_id FROM events""")
def q17_gaps(spark, d):
    events = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    return calendar.gaps(events, events.select("user_id").distinct(), "date", "user_id", F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))


@query("""SELECT CAST(s.day AS DATE) AS day, kind FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS s(day) CROSS JOIN (SELECT DISTINCT (user_id % 500) || ':' || event_type AS kind FROM events)
EXCEPT SELECT CAST(ts AS DATE), (user_id % 500) || ':' || event_type FROM events""")
def q17b_gaps_by_group(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.concat_ws(":", (F.col("user_id") % 500).cast("string"), "event_type").alias("kind"))
    return calendar.gaps(events, events.select("kind").distinct(), "date", "kind", F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q18_latest_per_key(spark, d):
    return calendar.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM events")
def q19_prev_value(spark, d):
    return calendar.previous(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "previous_type").select("user_id", "event_id", "previous_type")


def chained(spark, d):
    records = table(spark, d, "events").select("user_id", "event_id", F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string"), "event_type").alias("payload"))
    return records, chain.links(records, ["user_id"], ["event_id"], "payload")


CHAIN = """WITH RECURSIVE r AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') || ':' || user_id || ':' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT user_id, event_id, i, sha256(payload || ':GENESIS') AS hash, CAST(NULL AS VARCHAR) AS previous_hash FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.event_id, r.i, sha256(r.payload || ':' || c.hash), c.hash FROM c JOIN r ON r.user_id = c.user_id AND r.i = c.i + 1) """


@query(CHAIN + "SELECT user_id, event_id, hash, previous_hash FROM c")
def q20_hash_chain(spark, d):
    return chained(spark, d)[1].select("user_id", "event_id", "hash", "previous_hash")


@query(CHAIN + ", h AS (SELECT hash FROM (SELECT hash, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS n FROM c) WHERE n = 1) SELECT CASE WHEN count(hash) > 0 THEN sha256(string_agg(hash, ':' ORDER BY hash)) ELSE 'GENESIS_STATE' END AS fingerprint FROM h")
def q21_fingerprint(spark, d):
    return chain.fingerprint(chain.heads(chained(spark, d)[1], ["user_id"], ["event_id"]), "hash")


@query("SELECT user_id, event_id, event_id % 97 = 0 AS is_corrupted FROM events")
def q22_chain_verify(spark, d):
    _, made = chained(spark, d)
    stored = made.select("user_id", "event_id", "payload", F.when(F.col("event_id") % 97 == 0, "changed").otherwise(F.col("hash")).alias("stored"), F.col("previous_hash").alias("stored_previous"))
    return chain.verify(stored, ["user_id"], ["event_id"], "payload", "stored", "stored_previous").select("user_id", "event_id", "is_corrupted")


@query("""SELECT p_partkey, round(coalesce(a.price, b.price, c.price), 2) AS price FROM part LEFT JOIN (SELECT p_name AS k, min(p_retailprice) AS price FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) a ON a.k = p_name
LEFT JOIN (SELECT p_brand AS k, min(p_retailprice) AS price FROM part WHERE p_size <= 10 GROUP BY 1) b ON b.k = p_brand LEFT JOIN (SELECT p_type AS k, min(p_retailprice) AS price FROM part GROUP BY 1) c ON c.k = p_type""")
def q23_price_lookup(spark, d):
    part = table(spark, d, "part")
    tier = lambda rows, key: (key, rows.groupBy(F.col(key).alias("key")).agg(F.min("p_retailprice").alias("price")))
    tiers = [tier(part.where("p_partkey % 3 = 0"), "p_name"), tier(part.where("p_size <= 10"), "p_brand"), tier(part, "p_type")]
    return menus.tiered_price(part, tiers).select("p_partkey", F.round("price", 2).alias("price"))


@query("""WITH i AS (SELECT event_id AS id, user_id % 5 AS component, ts AS created_at, CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL 2 DAY END AS resolved_at, CASE WHEN value > 50 THEN 'outage' ELSE 'slow' END AS impact FROM events WHERE event_type = 'error'),
g AS (SELECT CAST(s.day AS DATE) AS day, component FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS s(day) CROSS JOIN (SELECT DISTINCT component FROM i))
SELECT g.component, g.day, coalesce(arg_min(impact, (created_at, id)), 'active') AS status FROM g LEFT JOIN i ON i.component = g.component AND created_at >= TIMESTAMP '2023-12-31' AND CAST(created_at AS DATE) <= g.day AND coalesce(CAST(resolved_at AS DATE), DATE '2024-01-30') >= g.day GROUP BY 1, 2""")
def q24_incident_history(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    incidents = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("component"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 11 != 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("resolved_at"), F.when(F.col("value") > 50, "outage").otherwise("slow").alias("impact"))
    return calendar.incident_history(incidents, incidents.select("component").distinct(), F.lit("2024-01-30").cast("date"), 30)


@query("SELECT c_custkey, CAST(1 + floor(sqrt(greatest(c_acctbal, 0) / 10)) AS INT) AS level FROM customer")
def q25_level(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.level(F.col("c_acctbal")).alias("level"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q26_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q27_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH n AS (SELECT n_nationkey, n_nationkey * 1.5 + 36.0 AS la, n_nationkey * 0.7 + 26.0 AS lo FROM nation), s AS (SELECT s_suppkey, s_suppkey % 37 + 36.3 AS a, s_suppkey % 19 + 26.2 AS o FROM supplier)
SELECT s_suppkey, arg_min(n_nationkey, (2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(la - a) / 2), 2) + cos(radians(a)) * cos(radians(la)) * pow(sin(radians(lo - o) / 2), 2)))), n_nationkey)) AS n_nationkey FROM s CROSS JOIN n GROUP BY 1""")
def q28_nearest(spark, d):
    places = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 1.5 + 36.0).alias("la"), (F.col("n_nationkey") * 0.7 + 26.0).alias("lo"))
    points = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 37 + 36.3).alias("a"), (F.col("s_suppkey") % 19 + 26.2).alias("o"))
    return menus.nearest(points, places, scalars.haversine_km(F.col("a"), F.col("o"), F.col("la"), F.col("lo")), "s_suppkey", "n_nationkey")


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 4) AS distance FROM embeddings")
def q29_cosine_anomaly(spark, d):
    vectors = table(spark, d, "embeddings")
    base = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("base"))
    return vectors.crossJoin(F.broadcast(base)).select("vec_id", F.round(scalars.cosine_distance(F.col("embedding"), F.col("base")), 4).alias("distance"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(l_linenumber || '-' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def q30_menu_document(spark, d):
    made = menus.documents(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"], ["l_returnflag"])
    return made.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: F.concat_ws("-", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"))


@query("""SELECT l_orderkey, sum(coalesce(CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS INT) END, CASE WHEN l_suppkey % 2 = 0 THEN 10 END, 0))::BIGINT AS calories FROM lineitem GROUP BY 1""")
def q31_calories(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("int")).alias("own"), F.when(F.col("l_suppkey") % 2 == 0, 10).alias("estimate"))
    out = menus.calories(rows, ["l_orderkey"], "own", "estimate")
    return out.select("l_orderkey", F.coalesce("calories", F.lit(0)).cast("long").alias("calories"))


@query("""WITH RECURSIVE k AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 1 THEN conv_id * 1000 + turn - 2 WHEN turn = 1 THEN -7 END AS parent_id FROM conversations),
f AS (SELECT id, id AS root_id, 0 AS depth FROM k WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM k) UNION ALL SELECT k.id, f.root_id, f.depth + 1 FROM k JOIN f ON k.parent_id = f.id) SELECT id, root_id, depth FROM f""")
def q32_comment_forest(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "case when turn > 1 then conv_id * 1000 + turn - 2 when turn = 1 then -7 end as parent_id")
    return comments.forest(rows, "id", "parent_id")


@query("""WITH RECURSIVE k AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 7 = 4 THEN -1 - turn WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations),
f AS (SELECT id, id AS root_id, 0 AS depth FROM k WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM k) UNION ALL SELECT k.id, f.root_id, f.depth + 1 FROM k JOIN f ON k.parent_id = f.id) SELECT id, root_id, depth FROM f""")
def q32b_comment_forest_whole(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "case when turn % 7 = 4 then -1 - turn when turn > 0 then conv_id * 1000 + turn - 1 end as parent_id")
    return comments.forest(rows, "id", "parent_id")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '[deleted]' WHEN conv_id % 50 IN (1, 2) THEN '[blocked]' WHEN conv_id % 50 IN (2, 3) THEN '[hidden]' ELSE text END AS text FROM conversations""")
def q33_mask_comments(spark, d):
    rows = table(spark, d, "conversations").withColumn("author", F.col("conv_id") % 50)
    blocks = spark.createDataFrame([(7, 1), (7, 2), (2, 7), (3, 7), (8, 9)], "blocker_id long, blocked_id long")
    seen = comments.blocked_flags(rows, blocks, "author", F.lit(7))
    return seen.select("conv_id", "turn", comments.masked(F.col("text"), F.col("turn") % 5 == 4, F.col("i_blocked"), F.col("blocked_me")).alias("text"))


@query("SELECT event_id, value FROM (SELECT event_id, value, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY value DESC, event_id LIMIT 10")
def q34_two_stage_topk(spark, d):
    return stats.two_stage_top(table(spark, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], [F.col("value").desc(), F.col("event_id")], 10).select("event_id", "value")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_items, CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages, 4 AS current_page FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 60")
def q35_paging(spark, d):
    return stats.page(table(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20, 60).select("o_orderkey", "total_items", "total_pages", "current_page")


@query(r"""WITH t AS (SELECT doc_id, text, lower(text) AS low FROM documents), n AS (SELECT doc_id, octet_length(encode(text)) AS bytes, (length(low) - length(replace(low, 'http://', ''))) // 7 + (length(low) - length(replace(low, 'https://', ''))) // 8 + (length(low) - length(replace(low, 'www.', ''))) // 4 + (length(low) - length(replace(low, 'ftp://', ''))) // 6 AS links FROM t),
c AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\P{L}', '', 'g'), '') AS cs FROM t)),
g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM c WHERE c <> ''), r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM g GROUP BY doc_id, c, g HAVING count(*) > 10))
SELECT doc_id, links >= 2 OR (links >= 1 AND bytes < 50) OR doc_id IN (SELECT doc_id FROM r) AS is_spam FROM n""")
def q36_spam(spark, d):
    return table(spark, d, "documents").select("doc_id", guard.is_spam(F.col("text")).alias("is_spam"))


@query(r"""SELECT doc_id, coalesce(t = '' OR NOT regexp_matches(t, '\p{L}') OR len(list_filter([""" + ", ".join(f"'{w}'" for w in guard.JUNK) + r"""], lambda w: contains(lower(translate(t, 'İIışŞğĞüÜöÖçÇ', 'iiissgguuoocc')), w))) > 0, true) AS is_junk
FROM (SELECT doc_id, regexp_replace(text, '^[\p{Z}\s]+|[\p{Z}\s]+$', '', 'g') AS t FROM documents)""")
def q37_junk(spark, d):
    return table(spark, d, "documents").select("doc_id", guard.is_junk(F.col("text")).alias("is_junk"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '</?[a-zA-Z0-9]+(?:\s+[^>]*)?>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '[\p{Z}\s]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages""")
def q38_html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", guard.strip_html(F.col("html")).alias("text"))


@query()
def q39_normalize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", names.food_name(F.col("p_name")).alias("name"), names.alternatives(F.col("p_name")).alias("alternatives"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'dark') THEN 'r' WHEN contains(lower(p_name), 'tan') OR contains(lower(p_name), 'dark') THEN 't' WHEN regexp_matches(lower(p_name), 'par|ear|arc|mar|lar') THEN 'a' END AS category FROM part")
def q40_classify(spark, d):
    rules = spark.createDataFrame([(1, "r", ["red"], ["dark"]), (2, "t", ["tan", "dark"], []), (3, "a", ["par", "ear", "arc", "mar", "lar"], [])], "rule_idx int, category string, keywords array<string>, excludes array<string>")
    return classify.first_rule(table(spark, d, "part"), rules, "p_name").select("p_partkey", "category")


@query("SELECT doc_id, round(coalesce(len(list_filter(w, lambda x: list_contains(['the', 'und', 'les', 'los', 'and'], x))) * 100.0::DOUBLE / nullif(len(w), 0), 0), 6) AS ratio FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2) AS w FROM documents)")
def q41_match_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(classify.match_ratio(F.col("text"), ("the", "und", "les", "los", "and")), 6).alias("ratio"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_orderkey, (6 - CAST(left(o_orderpriority, 1) AS INT), o_orderdate, o_orderkey)) AS o_orderkey, count(*) - 1 AS n_history FROM orders GROUP BY 1, 2")
def q42_priority_upsert(spark, d):
    rows = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).withColumn("priority", 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    state, history = menus.priority_upsert(rows, ["o_custkey", "month"], "priority", ["o_orderdate", "o_orderkey"])
    lost = history.groupBy("o_custkey", "month").agg(F.count("*").alias("n"))
    return state.join(lost, ["o_custkey", "month"], "left").select("o_custkey", "month", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n_history"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), o AS (SELECT * FROM k WHERE l_orderkey % 10 <> 1), n AS (SELECT l_orderkey, l_linenumber, p, CASE WHEN l_linenumber = 3 THEN q + 1 ELSE q END AS q FROM k WHERE l_orderkey % 10 <> 2)
SELECT l_orderkey, l_linenumber, CASE WHEN o.p IS NULL THEN 'insert' WHEN n.p IS NULL THEN 'delete' WHEN o.q <> n.q THEN 'update' ELSE 'keep' END AS op, coalesce(n.p, o.p) AS p, coalesce(n.q, o.q) AS q FROM o FULL JOIN n USING (l_orderkey, l_linenumber)""")
def q43_sync_diff(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    new = k.where("l_orderkey % 10 <> 2").withColumn("q", F.when(F.col("l_linenumber") == 3, F.col("q") + 1).otherwise(F.col("q")))
    return menus.sync_diff(k.where("l_orderkey % 10 <> 1"), new, ["l_orderkey", "l_linenumber"], ["p", "q"])


@query("""WITH m AS (SELECT o_orderkey AS menu, o_custkey AS usr, CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'P' THEN 'negative' ELSE 'neutral' END AS s FROM orders), i AS (SELECT DISTINCT l_orderkey AS menu, l_partkey AS dish FROM lineitem),
e AS (SELECT l_orderkey AS menu, l_partkey AS dish, o_custkey AS usr, 'negative' AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL), h AS (SELECT menu, dish, usr, s FROM m JOIN i USING (menu) WHERE s <> 'neutral')
SELECT menu, dish, usr, coalesce(e.s, h.s) AS sentiment, e.s IS NOT NULL AS is_explicit FROM h FULL JOIN e USING (menu, dish, usr)""")
def q44_vote_fanout(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    given = orders.select(F.col("o_orderkey").alias("menu"), F.col("o_custkey").alias("usr"), F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "P", "negative").otherwise("neutral").alias("sentiment"))
    own = lines.where("l_returnflag = 'R'").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("menu"), F.col("l_partkey").alias("dish"), F.col("o_custkey").alias("usr"), F.lit("negative").alias("sentiment")).distinct()
    return votes.fan_out(given, lines.select(F.col("l_orderkey").alias("menu"), F.col("l_partkey").alias("dish")), own, "menu", "dish", "usr")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_type, i, true AS fav, true AS pin FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_type, e.i, NOT f.fav, CASE WHEN f.fav THEN false ELSE true END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT user_id, event_type, fav AS is_favourite, pin AS is_pinned FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) = 1""")
def q45_toggle_fold(spark, d):
    return votes.favourite_state(table(spark, d, "events"), ["user_id", "event_type"])


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER w AS i, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, g, count(*) AS n, max(i) AS last FROM e GROUP BY 1, 2, 3) SELECT user_id, CASE WHEN arg_max(n, last) % 2 = 1 THEN arg_max(event_type, last) END AS event_type FROM r GROUP BY 1""")
def q45b_reaction_state(spark, d):
    return votes.toggle_state(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 3 ELSE l_partkey END AS l_partkey FROM lineitem")
def q46_merge_ids(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    mapping = table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - 3).alias("new_id"))
    return menus.merge_ids(lines, mapping, "l_partkey", ["l_orderkey", "l_partkey"])


@query("SELECT p_partkey, CAST(i - 1 AS INT) AS place, w[i] AS part FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def q47_split_explode(spark, d):
    return menus.split_names(table(spark, d, "part"), "p_partkey", "p_name", " ")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, event_id, i, t, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, t, have >= 1.0 AS allowed, CASE WHEN have >= 1.0 THEN have - 1.0 ELSE have END AS tokens
FROM (SELECT e.user_id, e.event_id, e.i, e.t, least(3.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6::DOUBLE * (3 / 86400.0::DOUBLE)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)) SELECT user_id, event_id, allowed FROM b""")
def q48_token_bucket(spark, d):
    return limits.token_bucket(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86400.0).select("user_id", "event_id", "allowed")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def q49_quota(spark, d):
    return calendar.within_quota(table(spark, d, "events"), "user_id", "ts", F.lit(3), ["ts", "event_id"]).select("event_id", "allowed")


@query("SELECT event_type, CAST(time_bucket(INTERVAL '10 seconds', ts) AS VARCHAR) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def q50_microbatch_counts(spark, d):
    return calendar.micro_batches(table(spark, d, "events"), "event_type", "ts").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def q51_union_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def q52_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-12-01' AND o_orderdate < DATE '1997-01-01'")
def q53_month_range(spark, d):
    return table(spark, d, "orders").where(dates.month_range(F.col("o_orderdate"), 1996, 12)).select("o_orderkey")


@query("SELECT o_orderstatus, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def q54_export(spark, d):
    folder = f"{shared_folder(spark)}/export-{uuid4().hex}"
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    files.export_json(rows, folder, ["o_orderstatus", "y"])
    return files.read_export(spark, folder, "o_orderkey long, o_orderstatus string, y int").groupBy("o_orderstatus", "y").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def q55_streaming_usage(spark, d):
    folder = f"{shared_folder(spark)}/usage-{uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return limits.flushed_usage(spark, stream, "user_id", "ts", folder)


from . import content  # noqa: E402, F401  its queries are added to those above
