"""Readers and writers of menu files: grids, embedded JSON, feeds, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import grid_date

LD_MENU = "`@type` string, name string, hasMenuSection array<struct<name: string, hasMenuItem: array<struct<name: string>>>>"
FEED = "menu struct<kahvalti: struct<yemekler: array<string>, kaloriler: map<string,bigint>>, aksam: struct<yemekler: array<string>, kaloriler: map<string,bigint>>>"
SHEETS = "sheets array<struct<name: string, rows: array<array<string>>>>"


def grid_cells(sheets: DataFrame, name: str = "name", rows: str = "rows", most: int = 10) -> DataFrame:
    """(name, row, col, text) of the cells of ragged sheets, numbered from 0; null cells are empty texts."""
    line = sheets.select(name, F.posexplode(rows).alias("row", "cells"))
    return line.select(name, "row", F.posexplode("cells").alias("col", "text")).withColumn("text", F.coalesce(F.trim("text"), F.lit("")))


def grid_items(cells: DataFrame, name: str = "name", most: int = 25, blanks: int = 2) -> DataFrame:
    """(name, date, item, place) below the date cells of a sheet's columns. A column's list ends with two blank cells in a
    row or the next date; the 26th item and those after it are dropped. Window functions over one column of one sheet."""
    from pyspark.sql import Window

    along = Window.partitionBy(name, "col").orderBy("row")
    marked = cells.withColumn("date", grid_date(F.col("text"))).withColumn("block", F.sum(F.col("date").isNotNull().cast("int")).over(along)).where("block > 0")
    inside = Window.partitionBy(name, "col", "block").orderBy("row")
    blank = (F.col("text") == "") & (F.lag("text", 1).over(inside) == "")
    ended = marked.withColumn("date", F.first("date").over(inside)).withColumn("first_row", F.min("row").over(Window.partitionBy(name, "col", "block"))).withColumn("__blank", F.coalesce(blank, F.lit(False)).cast("int"))
    open_ = ended.withColumn("__over", F.sum("__blank").over(inside)).where((F.col("__over") == 0) & (F.col("row") > F.col("first_row")) & (F.col("text") != ""))
    return open_.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most).select(name, "date", F.col("text").alias("item"), "place")


def json_ld_menu(html: Column) -> Column:
    """The first embedded menu document of a page, as a struct; null without one."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    parsed = F.transform(blocks, lambda b: F.from_json(b, LD_MENU))
    return F.try_element_at(F.filter(parsed, lambda m: m["@type"] == "Menu"), F.lit(1))


def feed_items(feed: DataFrame, body: str) -> DataFrame:
    """(meal, place, name, calories) of a JSON feed; calories are looked up by the item's name."""
    parsed = feed.withColumn("__m", F.from_json(body, FEED)["menu"])
    out = None
    for meal, field in (("breakfast", "kahvalti"), ("dinner", "aksam")):
        part = parsed.select(*feed.columns, F.lit(meal).alias("meal"), F.posexplode(f"__m.{field}.yemekler").alias("place", "name"), F.col(f"__m.{field}.kaloriler").alias("__c"))
        part = part.withColumn("calories", F.try_element_at("__c", F.col("name"))).drop("__c")
        out = part if out is None else out.unionByName(part)
    return out


def upload_ok(count: Column, size: Column, name: Column, content: Column, most: int = 5, most_bytes: int = 20 << 20) -> Column:
    """Whether an uploaded file may be taken: number, size, extension and first bytes agree, and no path in its name."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    magic = ((kind == "pdf") & (head == "25504446")) | ((kind == "xlsx") & (head == "504B0304")) | ((kind == "png") & (head == "89504E47")) | (kind.isin("jpg", "jpeg") & head.startswith("FFD8FF"))
    return (count <= most) & (size <= most_bytes) & magic & ~name.contains("..") & ~name.rlike(r"[/\\]")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def export_json(rows: DataFrame, path: str, by: list[str]) -> None:
    """One folder of JSON lines for each combination of the partition columns."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def path_part(at: int) -> Column:
    """A part of a file's path counted from the end (1: its name), as city or meal of a backup."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -at)
