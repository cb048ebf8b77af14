"""A drop zone: menu files of cities arrive in a folder, are read once, and go to the archive, the errors or back to the queue.

Files are texts with the sheets of a menu as JSON, at <zone>/<city>/<file>. A file that can't be read is kept with its reason
among the errors. One whose city is not known yet stays in the queue and is tried again by each run. What was read is
archived by the stream itself. A repeated micro-batch replaces its own output, so nothing is taken twice. Spark's readers
pass over files of no bytes, so these stay where they are; blank ones are damaged."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from ..sources.files import SHEETS, path_part
from ..sources.grid import menus

FILE = "city string, file string, body string"


def arrivals(spark: SparkSession, zone: str, archive: str | None = None, at_once: int = 1000) -> DataFrame:
    """The stream of new files: city, file, body. With an archive, files that were read are moved there."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", at_once)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(f"{zone}/*/*").select(path_part(2).alias("city"), path_part(1).alias("file"), F.col("content").cast("string").alias("body"))


def sorted_out(files: DataFrame, cities: DataFrame) -> DataFrame:
    """files with `sheets`, `city_id` and `reason`: null for a file to be taken, 'unknown city' for one to be tried again, else
    why it is damaged."""
    parsed = F.from_json("body", SHEETS)["sheets"]
    rows = files.withColumn("sheets", parsed).join(cities.select(F.col("id").alias("city_id"), F.col("slug").alias("city")), "city", "left")
    reason = F.when(~F.coalesce("body", F.lit("")).rlike(r"\S"), "empty file").when(F.col("sheets").isNull(), "not the JSON of sheets").when(F.size("sheets") == 0, "no sheets").when(F.col("city_id").isNull(), "unknown city")
    return rows.withColumn("reason", reason)


def run_dropzone(spark: SparkSession, zone: str, cities: DataFrame, folder: str, as_of: Column, archive: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(menus, errors, queue) after all files that there are: rows of sources.grid.menus() with city_id and file, damaged files
    with their reason, and files that wait. Goes on from its checkpoint when called again, with the waiting files first."""

    def settle(files: DataFrame, out: str, again: bool = False) -> None:
        known = sorted_out(files, cities).persist()
        good = known.where("reason IS NULL").select("city_id", "city", "file", F.posexplode("sheets").alias("nth", "sheet"))
        keyed = good.select(F.struct("city_id", "file", "nth").alias("key"), F.col("sheet.name").alias("name"), F.col("sheet.rows").alias("rows"))
        menus(keyed, "key", "name", "rows", as_of).write.mode("overwrite").parquet(f"{folder}/menus/run={out}")
        known.where("reason <> 'unknown city'").select("city", "file", "reason").write.mode("overwrite").parquet(f"{folder}/errors/run={out}")
        if not again:
            known.where("reason = 'unknown city'").select("city", "file", "body").write.mode("overwrite").parquet(f"{folder}/queue/run={out}")
        good.select("city", "file").distinct().write.mode("overwrite").parquet(f"{folder}/done/run={out}")  # after what it stands for
        known.unpersist()

    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{folder}/{kind}")
    waiting = lambda: read("queue", FILE).distinct().join(read("done", "city string, file string"), ["city", "file"], "left_anti")
    for kind, schema in (("queue", FILE), ("done", "city string, file string")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{kind}/run=none")
    settle(settled(waiting()), f"again-{uuid4().hex}", again=True)
    arrivals(spark, zone, archive).writeStream.foreachBatch(lambda b, epoch: settle(b, f"epoch-{epoch}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    taken = spark.read.parquet(f"{folder}/menus")
    taken = taken.select(F.col("key.city_id").alias("city_id"), F.col("key.file").alias("file"), F.col("key.nth").alias("sheet"), *[c for c in taken.columns if c not in ("key", "run")]).distinct()
    return taken, read("errors", "city string, file string, reason string").distinct(), waiting()
