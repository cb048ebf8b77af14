"""The token bucket as a stateful stream: one bucket for each key, kept between micro-batches and restarts.

A bucket that nobody asked for `seconds` is full again, which is what a new bucket is. So an idle key's state is dropped by a
timer at just that time after its last request, and no decision changes; the state holds active keys only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .limits import LIMITS, token_bucket

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Which requests are of which kind, the first that fits; methods where only those count.
ROUTES = (
    ("contains", "/vote", None, "vote"), ("prefix", "/api/v1/comments", ("POST", "PUT"), "comment"), ("prefix", "/api/v1/auth/login", None, "login"),
    ("prefix", "/api/v1/auth/register", None, "register"), ("prefix", "/api/v1/auth/forgot-password", None, "forgot_password"),
    ("prefix", "/api/v1/auth/reset-password", None, "forgot_password"), ("prefix", "/api/v1/auth/passwordless-login", None, "login"),
    ("prefix", "/api/v1/auth/passwordless", None, "passwordless"), ("prefix", "/api/v1/ingestion", None, "ingestion"), ("prefix", "/api/v1/", None, "general"),
)


def category(method: Column, path: Column, has_api_key: Column | None = None) -> Column:
    """The kind of limit that a request counts against; null for requests without one: other paths, and ingestion by key."""
    out = F.lit(None).cast("string")
    for how, text, methods, kind in reversed(ROUTES):
        fits = F.contains(path, F.lit(text)) if how == "contains" else F.startswith(path, F.lit(text))
        out = F.when(fits & method.isin(*methods) if methods else fits, kind).otherwise(out)
    return F.when((out == "ingestion") & F.coalesce(has_api_key, F.lit(False)), None).otherwise(out) if has_api_key is not None else out


class Buckets(StatefulProcessor):
    """Decides on the requests of one key, in order of time within a micro-batch. Input: key, at (microseconds), order.

    Each call of the handle is a round trip, so a key has one timer at a time: it is not moved with each request, but looks
    at the last request when it goes off."""

    def __init__(self, names: tuple[str, str], capacity: int, seconds: float):
        self.names, self.capacity, self.seconds = names, float(capacity), seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last long")

    def due(self, last: int) -> int:
        """When a bucket is full again, in milliseconds."""
        return -(-(last + int(self.seconds * 1e6)) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        key_name, order = self.names
        parts = [(r["at"].to_numpy(), r["order"].to_numpy()) for r in rows]
        at, orders = (np.concatenate(x) for x in zip(*parts))
        sort = np.lexsort((orders, at))
        at, orders = at[sort].tolist(), orders[sort]
        kept = self.bucket.get()
        tokens, last = kept or (self.capacity, at[0])
        rate = self.capacity / self.seconds
        allowed, wait = np.zeros(len(at), bool), np.zeros(len(at))
        for i, t in enumerate(at):
            tokens = min(self.capacity, tokens + max(0, t - last) / 1e6 * rate)
            last = max(last, t)
            if tokens >= 1.0:
                allowed[i] = True
                tokens -= 1.0
            else:
                wait[i] = max(0.1, (1.0 - tokens) / rate)
        self.bucket.update((tokens, last))
        if not kept:
            self.handle.registerTimer(self.due(last))
        yield pd.DataFrame({key_name: [key[0]] * len(at), order: orders, "allowed": allowed, "wait_s": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.bucket.get()
        if kept and self.due(kept[1]) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self.due(kept[1]))
        else:
            self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, key: str, time: str, order: str, capacity: int, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, order, allowed, wait_s) of a stream of requests. Requests of a micro-batch are taken in order of time, those
    without key or time are left out, and those older than the watermark (the latest time less `late`) come too late."""
    kind = lambda c: T.StructField(c, requests.schema[c].dataType)
    out = T.StructType([kind(key), kind(order), T.StructField("allowed", T.BooleanType()), T.StructField("wait_s", T.DoubleType())])
    rows = requests.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(time).cast("timestamp").alias("seen"))
    rows = rows.withWatermark("seen", late).withColumn("at", F.unix_micros("seen"))
    return rows.groupBy("key").transformWithStateInPandas(Buckets((key, order), capacity, seconds), out, "Append", "EventTime")


def run_limited(spark: SparkSession, requests: DataFrame, key: str, time: str, order: str, capacity: int, seconds: float, folder: str, late: str = "0 seconds") -> DataFrame:
    """All decisions so far, after the stream's available input is used up. Called again with the same folder, it goes on
    from its checkpoint. A micro-batch that is repeated replaces its own file."""
    made = limited_stream(requests, key, time, order, capacity, seconds, late)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/decisions/epoch={epoch}")
        made.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.createDataFrame([], made.schema).write.mode("overwrite").parquet(f"{folder}/decisions/epoch=-1")  # an empty stream has no file
    return spark.read.schema(made.schema).parquet(f"{folder}/decisions")


def admitted(requests: DataFrame, address: str, client: str, kind: str, time: str, order: str, limits: dict[str, tuple[int, float]] = LIMITS) -> DataFrame:
    """(order, allowed, by, wait_s) of a batch: first the short limit of the address, then, only for what it lets through, the
    limit of the kind for the client. by: the kind that refused, null if allowed. Requests without a kind are allowed."""
    spike = token_bucket(requests.where(F.col(kind).isNotNull()), address, time, order, *limits["spike"]).select(order, F.col("allowed").alias("first"), F.col("wait_s").alias("first_wait"))
    through = requests.join(spike.where("first").select(order), order, "left_semi")
    decided = None
    for name, (capacity, seconds) in limits.items():
        if name != "spike":
            part = token_bucket(through.where(F.col(kind) == name), client, time, order, capacity, seconds).select(order, F.col("allowed").alias("second"), F.col("wait_s").alias("second_wait"))
            decided = part if decided is None else decided.unionByName(part)
    both = requests.select(order, F.col(kind).alias("__kind")).join(spike, order, "left").join(decided, order, "left")
    by = F.when(~F.col("first"), "spike").when(~F.col("second"), F.col("__kind"))
    return both.select(order, by.isNull().alias("allowed"), by.alias("by"), F.coalesce(F.when(~F.col("first"), F.col("first_wait")), F.col("second_wait"), F.lit(0.0)).alias("wait_s"))
