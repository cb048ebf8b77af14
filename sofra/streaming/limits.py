"""Rate limits and usage counters: batch twins and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens and seconds of each kind of request.
LIMITS = {
    "spike": (10, 1), "general": (240, 60), "login": (5, 60), "register": (3, 60), "forgot_password": (3, 3600), "passwordless": (3, 300),
    "ingestion": (10, 3600), "vote": (10, 60), "comment": (5, 60),
}


def client_key(user: Column, ip: Column, client: Column) -> Column:
    """Who is limited: the user, else address and client, else the address."""
    return F.coalesce(F.concat(F.lit("u:"), user), F.concat(F.lit("c:"), ip, F.lit(":"), client), F.concat(F.lit("i:"), ip))


def token_bucket(requests: DataFrame, key: str, time: str, order: str, capacity: int, seconds: float) -> DataFrame:
    """(key, order, allowed, wait_s) of each request: a bucket of `capacity` tokens that fills up within `seconds`.

    The decisions of one key follow each other. Rows are dealt by key, sorted by time and streamed with one bucket in
    memory, so that no key's rows are gathered, however many they are."""
    rate = capacity / seconds
    kinds = f"{key} {requests.schema[key].dataType.simpleString()}, {order} {requests.schema[order].dataType.simpleString()}, allowed boolean, wait_s double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, 0.0, 0
        for batch in batches:
            ok, wait = [], []
            for k, t in zip(batch[key], batch["__t"]):
                if now is None or k != now:
                    now, tokens, last = k, float(capacity), t
                tokens, last = min(float(capacity), tokens + (t - last) / 1e6 * rate), t
                ok.append(tokens >= 1.0)
                wait.append(0.0 if tokens >= 1.0 else max(0.1, (1.0 - tokens) / rate))
                tokens -= 1.0 if tokens >= 1.0 else 0.0
            yield pd.DataFrame({key: batch[key], order: batch[order], "allowed": ok, "wait_s": wait})

    rows = requests.select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("__t")).where(F.col(key).isNotNull() & F.col("__t").isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "__t", order).mapInPandas(run, kinds)


def windowed_usage(events: DataFrame, key: str, time: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts by key and window, for a stream with a watermark (rows later than that are dropped) or a batch."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def flushed_usage(spark: SparkSession, stream: DataFrame, key: str, time: str, folder: str) -> DataFrame:
    """Daily counters of a stream: each micro-batch writes its own sums, the state is their total. A repeated batch
    replaces its own file, so nothing counts twice. Runs until the available input is used up. An empty stream has no counters."""

    def flush(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(F.col(key), F.to_date(time).alias("day")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/epoch={epoch}")

    stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counted = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("day", T.DateType()), T.StructField("n", T.LongType())])
    spark.createDataFrame([], counted).write.mode("overwrite").parquet(f"{folder}/counts/epoch=-1")  # an empty stream has no file
    return spark.read.schema(counted).parquet(f"{folder}/counts").groupBy(key, "day").agg(F.sum("n").alias("n"))
