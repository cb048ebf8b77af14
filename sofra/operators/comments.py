"""Comments: forests in flat form, masking by deletion and blocks, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

NIL = "00000000-0000-0000-0000-000000000000"


def forest(comments: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root_id, depth) of every comment; one whose parent is missing is a root. Comments on or below a cycle of
    parents have no root: both are null.

    Pointers to ancestors are doubled until all point to roots, so trees take the log2 of their depth in joins, whatever
    their width. After as many steps as there are comments, only those of cycles are left."""
    own = comments.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    up = own.join(own.select(F.col("id").alias("up")), F.col("parent") == F.col("up"), "left")
    # a root points to itself at no distance
    up = settled(up.select("id", F.coalesce("up", "id").alias("up"), F.col("up").isNotNull().cast("long").alias("far"), F.col("up").isNotNull().alias("open")))
    steps, n = 1, up.count()
    while steps <= 2 * n and not up.where("open").isEmpty():
        higher = up.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        up = settled(up.join(higher, "up").select("id", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("open")))
        steps *= 2
    return up.select(F.col("id").alias(key), F.when(~F.col("open"), F.col("up")).alias("root_id"), F.when(~F.col("open"), F.col("far")).cast("int").alias("depth"))


def blocked_flags(comments: DataFrame, blocks: DataFrame, author: str, me: Column) -> DataFrame:
    """comments with i_blocked and blocked_me for the viewer; blocks: (blocker_id, blocked_id)."""
    mine = blocks.where(F.col("blocker_id") == me).select(F.col("blocked_id").alias("__b")).distinct()
    theirs = blocks.where(F.col("blocked_id") == me).select(F.col("blocker_id").alias("__c")).distinct()
    both = comments.join(mine, F.col(author) == F.col("__b"), "left").join(theirs, F.col(author) == F.col("__c"), "left")
    return both.withColumn("i_blocked", F.col("__b").isNotNull()).withColumn("blocked_me", F.col("__c").isNotNull()).drop("__b", "__c")


def masked(text: Column, deleted: Column, i_blocked: Column, blocked_me: Column) -> Column:
    """What the viewer sees: deletion goes before one's own block, and that before the other's."""
    return F.when(deleted, "[deleted]").when(i_blocked, "[blocked]").when(blocked_me, "[hidden]").otherwise(text)


def masked_author(author: Column, deleted: Column) -> Column:
    return F.when(deleted, NIL).otherwise(author)


def is_edited(created: Column, updated: Column, seconds: int = 180) -> Column:
    return F.unix_timestamp(updated) - F.unix_timestamp(created) > seconds


def reply_allowed(forest_rows: DataFrame, most: int = 10) -> DataFrame:
    """Comments that may get a reply: those above the depth limit."""
    return forest_rows.withColumn("may_reply", F.col("depth") < most)
