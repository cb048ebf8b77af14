"""Votes, reactions and leaderboards: one signed-sum kernel, and folds of toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import within

SIGN = {"positive": 1, "negative": -1}
MOST = 100


def signed(sentiment: Column, sign: dict[str, int] = SIGN) -> Column:
    out = F.lit(0)
    for k, v in sign.items():
        out = F.when(sentiment == k, v).otherwise(out)
    return out


def vote_summary(votes: DataFrame, keys: list[str], sentiment: str = "sentiment", sign: dict[str, int] = SIGN) -> DataFrame:
    """keys, n_votes, n_up, n_down, score. A partial aggregate before the shuffle; any key may be hot."""
    s = signed(F.col(sentiment), sign)
    return votes.groupBy(*keys).agg(F.count("*").alias("n_votes"), F.sum((s > 0).cast("long")).alias("n_up"), F.sum((s < 0).cast("long")).alias("n_down"), F.sum(s.cast("long")).alias("score"))


def leaderboard(dishes: DataFrame, votes: DataFrame, dish_key: str, vote_key: str, *, sentiment: str = "sentiment", sign: dict[str, int] = SIGN, direction: str = "desc", limit: int = 10, timeframe: str | None = None, time: str | None = None, as_of: Column | None = None, signed_only: bool = False) -> DataFrame:
    """The top dishes by signed score, with the share of positive votes. Ties are broken by the dish's key, so the set is stable.

    Votes are summed before they meet the dishes: what is joined is one row per dish. limit is at most 100; signed_only
    keeps positive scores of a top list and negative ones of a worst list."""
    if timeframe and time is not None:
        votes = votes.where(within(F.col(time), timeframe, as_of))
    sums = vote_summary(votes, [vote_key], sentiment, sign)
    ratio = F.col("n_up") / F.nullif(F.col("n_votes"), F.lit(0))
    out = dishes.join(sums, F.col(dish_key) == F.col(vote_key)).withColumn("positive_ratio", ratio)
    up = direction.lower() != "desc"
    if signed_only:
        out = out.where(F.col("score") < 0 if up else F.col("score") > 0)
    return out.orderBy(F.col("score").asc() if up else F.col("score").desc(), F.col(dish_key)).limit(min(limit, MOST))


def average_rating(votes: DataFrame, keys: list[str], points: dict[str, int], sentiment: str = "sentiment") -> DataFrame:
    """Mean points of the votes, one decimal."""
    p = F.lit(None).cast("int")
    for k, v in points.items():
        p = F.when(F.col(sentiment) == k, v).otherwise(p)
    return votes.groupBy(*keys).agg(F.round(F.avg(p), 1).alias("rating"))


def reaction_summary(reactions: DataFrame, keys: list[str], kind: str, up: str, down: str, user: str, me: Column | None = None) -> DataFrame:
    """keys, up, down and (for a user) my reaction."""
    aggs = [F.count_if(F.col(kind) == up).alias("up"), F.count_if(F.col(kind) == down).alias("down")]
    if me is not None:
        aggs.append(F.max(F.when(F.col(user) == me, F.col(kind))).alias("mine"))
    return reactions.groupBy(*keys).agg(*aggs)


def toggle_state(events: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """The reaction that stands after all events: the same one again takes it away, another one replaces it.

    An event's run of equal kinds counts from the last change; an odd number stands, an even one is off. Only window
    functions: no key's events are collected into an array."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(0))
    runs = events.withColumn("__run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("__run", kind, "n"))
    return runs.groupBy(*keys, "__run", kind).agg(F.count("*").alias("n")).groupBy(*keys).agg(last.alias("l")).select(*keys, F.when(F.col("l.n") % 2 == 1, F.col(f"l.{kind}")).alias(kind))


def favourite_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Favourites toggle on and off; a favourite is pinned as well. keys, is_favourite, is_pinned."""
    on = (F.count("*") % 2 == 1).alias("is_favourite")
    return events.groupBy(*keys).agg(on).withColumn("is_pinned", F.col("is_favourite"))


def fan_out(menu_votes: DataFrame, menu_dishes: DataFrame, explicit: DataFrame, menu: str, dish: str, user: str, sentiment: str = "sentiment") -> DataFrame:
    """Votes on dishes after votes on menus were handed down: an explicit vote wins, a neutral menu vote hands nothing down.

    (menu, dish, user, sentiment, is_explicit)."""
    handed = menu_votes.where(F.col(sentiment) != "neutral").join(menu_dishes.select(menu, dish).where(F.col(dish).isNotNull()).distinct(), menu).select(menu, dish, user, F.col(sentiment).alias("__handed"))
    own = explicit.select(menu, dish, user, F.col(sentiment).alias("__own"))
    both = handed.join(own, [menu, dish, user], "full_outer")
    return both.select(menu, dish, user, F.coalesce("__own", "__handed").alias(sentiment), F.col("__own").isNotNull().alias("is_explicit"))


def valid_comment(content: Column, sentiment: Column) -> Column:
    """A pure vote isn't neutral, and free text is."""
    blank = F.coalesce(F.trim(content), F.lit("")) == ""
    return F.when(blank, sentiment != "neutral").otherwise(sentiment == "neutral")


def deduplicated(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore: the first row of each key stays."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def added_up(state: DataFrame, more: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upsert: counters of both frames summed by key."""
    return state.select(*keys, *sums).unionByName(more.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
