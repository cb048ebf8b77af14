"""Session settings that the library relies on: UTC, ANSI, adaptive execution. No locale-dependent function is used anywhere."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "sofra", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; anything else, such as memory, is the caller's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table of a base folder on any file system that Spark reads."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate files go: the session's spark.checkpoint.dir; on a local master without one, an own temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-sofra-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder; what is read later doesn't change, also if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base
