"""Moderation of reported posts: states of reports folded from ordered actions.

Each action is a function on a report's state, and functions compose: what happened to a key in one stretch of its history is
one small table of state to state, however long the stretch. A stretch is folded where it lies, only its table travels, and
the tables of a key are composed in order. So the history of one hot report is spread over tasks like any other rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = ("none", "pending", "dismissed", "resolved", "purged")
#: What an action makes of each state; states that it does not name stay. A report is opened once, a purged post has none.
MOVES = {
    "report": {"none": "pending"},
    "approve": {"pending": "dismissed"},
    "reject": {"pending": "resolved"},
    "reset": {"dismissed": "pending", "resolved": "pending"},
    "purge": {"none": "purged", "pending": "purged", "dismissed": "purged", "resolved": "purged"},
}
#: Whether the post is hidden after an action; others leave that as it is.
HIDES = {"approve": False, "reject": True, "reset": False, "purge": True}
TABLE = [[STATES.index(MOVES.get(a, {}).get(s, s)) for s in STATES] for a in MOVES]
#: Actions that date a report when they close it.
CLOSES = {"approve", "reject"}


def partial_moves(actions: DataFrame, keys: list[str], action: str, time: str, order: list[str]) -> DataFrame:
    """keys, part, to, closed, hidden: each stretch of a key's ordered actions as one function. to[i] is the state that state i
    ends in, closed[i] when it was last closed on the way (null: not), hidden what the stretch makes of the post (null: nothing)."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = actions.where(F.col(action).isin(*MOVES)).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(time).alias("at"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(action).alias("action"))
    along = [*names, "at", *[f"o{i}" for i in range(len(order))]]
    schema = T.StructType([*[T.StructField(n, rows.schema[n].dataType) for n in names], T.StructField("to", T.ArrayType(T.IntegerType())), T.StructField("closed", T.ArrayType(rows.schema["at"].dataType)), T.StructField("hidden", T.BooleanType())])
    table, number = TABLE, {a: i for i, a in enumerate(MOVES)}
    closes, hides = CLOSES, HIDES
    start = tuple(range(len(STATES)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = lambda rows: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
        now, to, closed, hidden = None, start, [None] * len(start), None
        for batch in batches:
            done = []
            for *key, at, action in zip(*(batch.column(c).to_pylist() for c in (*names, "at", "action"))):
                if key != now:
                    if now is not None:
                        done.append((*now, list(to), closed, hidden))
                    now, to, closed, hidden = key, start, [None] * len(start), None
                moves = table[number[action]]
                if action in closes:
                    closed = [at if moves[s] != s else c for s, c in zip(to, closed)]
                to = tuple(moves[s] for s in to)
                hidden = hides.get(action, hidden)
            if done:
                yield made(done)
        if now is not None:
            yield made([(*now, list(to), closed, hidden)])

    dealt = rows.repartitionByRange(*along).sortWithinPartitions(*along).select(*names, "at", "action")
    made = dealt.mapInArrow(fold, schema)
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.spark_partition_id().alias("part"), "to", "closed", "hidden")


def composed(parts: Column, first: str = "none") -> Column:
    """The struct (state, resolved_at, hidden) that ordered stretches make of a state."""
    begin = F.struct(F.lit(STATES.index(first)).alias("state"), F.lit(None).cast("timestamp_ntz").alias("closed"), F.lit(None).cast("boolean").alias("hidden"))

    def step(acc: Column, part: Column) -> Column:
        at = acc["state"] + 1
        closed = F.coalesce(F.element_at(part["closed"], at).cast("timestamp_ntz"), acc["closed"])
        return F.struct(F.element_at(part["to"], at).alias("state"), closed.alias("closed"), F.coalesce(part["hidden"], acc["hidden"]).alias("hidden"))

    return F.aggregate(parts, begin, step)


def report_states(actions: DataFrame, keys: list[str], action: str, time: str, order: list[str]) -> DataFrame:
    """keys, status, resolved_at, hidden after all actions, for each key that was ever reported and is not purged.

    approve dismisses what is pending, reject resolves it, both date it; reset makes it pending again and keeps the date;
    purge takes the post and its reports away for good. Reporting again changes nothing. Unknown actions are left out; of
    actions at one time `order` decides. A null key is a key. An empty table gives no rows."""
    parts = partial_moves(actions, keys, action, time, order)
    each = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "to", "closed", "hidden"))).alias("parts"))  # at most one stretch a partition
    out = each.withColumn("end", composed(F.col("parts")))
    status = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("end.state") + 1)
    return out.select(*keys, status.alias("status"), F.col("end.closed").alias("resolved_at"), F.coalesce("end.hidden", F.lit(False)).alias("hidden")).where(~F.col("status").isin("none", "purged"))


def open_reports(reports: DataFrame, existing: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """New reports to be taken: one for each combination of `by` (reporter and post), the first by `order`, none that exists."""
    from .votes import deduplicated

    return deduplicated(reports, by, [F.col(c) for c in order]).join(existing.select(*by).distinct(), by, "left_anti")
