"""Menu sheets: grids of cells with one or more date columns, read as rows of dishes.

A cell with a date heads a list of dishes in its column; "amount" and "energy" columns may stand to its right. The list ends
at the next date, after two blank cells, or with the 25th dish. All steps are windows over one column of one sheet, so
sheets spread over tasks and none is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.dates import DATE, grid_date, near_date
from ..functions.guard import contains_any
from ..functions.names import ITEM_BYTES, ITEMS_PER_MEAL, aligned_value, alternatives, food_name, numeric_value, split_outside
from ..functions.turkish import trim
from ..session import settled

#: Words of remarks that are no dishes; marks of packages, and of the columns beside a date.
REMARKS = ("hazırlanıp", "sunulacaktır", "garnitür", "ortalama")
PACKAGE = ("AL GÖTÜR", "ALGÖTÜR", "AL-GÖTÜR", "AL GÖTUR", "ALGÖTUR")
AMOUNT, ENERGY = ("GRAMAJ",), ("ENERJİ", "ENERJI")
PACKAGE_NAME = "Al-Götür Menü "
SAMPLE = 10


def dated_cells(sheets: DataFrame, key: str, rows: str, as_of: Column) -> DataFrame:
    """(key, row, col, text, right, right2): every cell of the columns with a date within two years of as_of, with the two to its
    right; missing ones are empty. Which columns these are is told from the sheet's own row, so the cells of others are never made."""
    near = lambda x: F.when(x.rlike(DATE), near_date(F.try_to_date(grid_date(x), "yyyy-MM-dd"), as_of))
    dated = lambda line: F.filter(F.transform(line, lambda x, i: F.when(near(x), i)), lambda i: i.isNotNull())
    cols = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.coalesce(dated(r), F.array().cast("array<int>")))))
    # once a sheet, before its rows are dealt out; of a plain explode Spark would infer a filter that works both out again
    line = sheets.select(key, F.col(rows).alias("lines"), cols.alias("cols")).select(key, "cols", F.posexplode_outer("lines").alias("row", "line"))
    at = lambda i: F.coalesce(F.try_element_at("line", (F.col("col") + 1 + i).cast("int")), F.lit(""))
    return line.select(key, "row", "line", F.explode_outer("cols").alias("col")).where("col IS NOT NULL").select(key, "row", "col", at(0).alias("text"), at(1).alias("right"), at(2).alias("right2"))


def item_text(c: Column) -> Column:
    """A cell's dish: no bullets before it, and the tea spelled as a dish."""
    t = trim(F.regexp_replace(trim(c), r"^[*\-•⁃]+", ""))
    return F.when(F.contains(t, F.lit("Cay")), F.replace(t, F.lit("Cay"), F.lit("Çay"))).otherwise(F.replace(t, F.lit("cay"), F.lit("çay")))


def listed(grid: DataFrame, key: str, as_of: Column, most: int = ITEMS_PER_MEAL) -> DataFrame:
    """(key, date, head, col, row, place, item, amount, energy, package): the dishes below each date, in order from 1.

    Cells that are too long and remarks are passed over; they neither end a list nor count as blank. Dates more than two
    years from as_of head no list but end the one above. A cell's texts are looked at before the first window, which no
    filter passes, so each is worked out once."""
    column = Window.partitionBy(key, "col").orderBy("row")
    up = lambda c: F.upper(c)
    own = F.when(F.col("text").rlike(DATE), grid_date(F.col("text")))
    amounts = contains_any(up(F.col("right")), AMOUNT)
    energy = contains_any(up(F.col("right")), ENERGY) | (amounts & contains_any(up(F.col("right2")), ENERGY))
    known = grid.withColumn("own", own).withColumn("item", F.when(F.col("text") == "", "").when(F.col("own").isNull(), item_text(F.col("text"))))
    head = F.when(F.col("own").isNotNull(), F.struct("row", F.try_to_date("own", "yyyy-MM-dd").alias("date"), amounts.alias("amounts"), energy.alias("energies")))
    short = F.octet_length("item") <= ITEM_BYTES
    remark = lambda c: (F.col(c) != "") & contains_any(F.lower(c), REMARKS)
    known = known.select(
        key, "row", "col", "text", "right", "right2", "item", head.alias("own"), (short & ~remark("item")).alias("kept"), remark("right").alias("beside"))
    under = known.withColumn("above", F.last("own", ignorenulls=True).over(column)).where("own IS NULL AND above IS NOT NULL")
    body = under.where(near_date(F.col("above.date"), as_of) & F.col("kept") & ~(F.col("above.amounts") & F.col("beside")))
    body = body.select(key, "row", "col", "text", "right", "right2", "item", F.col("above.row").alias("head"), "above.date", "above.amounts", "above.energies")
    inside = Window.partitionBy(key, "col", "head").orderBy("row")
    blank = F.col("item") == ""
    over = F.coalesce(blank & F.lag(blank).over(inside), F.lit(False))
    body = body.withColumn("over", F.sum(over.cast("int")).over(inside)).where((F.col("over") == 0) & ~blank)
    body = body.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    amount = F.when(F.col("amounts"), numeric_value(F.col("right")))
    value = F.when(F.col("energies"), numeric_value(F.when(F.col("amounts"), F.col("right2")).otherwise(F.col("right"))))
    return body.select(key, "date", "head", "col", "row", "place", "item", amount.alias("amount"), value.alias("energy"), contains_any(up(F.col("text")), PACKAGE).alias("package"))


def sheet_facts(sheets: DataFrame, items: DataFrame, key: str, name: str, rows: str) -> DataFrame:
    """(key, meal, celiac, kcal): the meal by the sheet's name or else its first dishes, and the first calorie range in a cell.

    Ranges are sought in a sheet's cells end to end, with a character between them that no range has."""
    order = F.struct("head", "col", "row")
    first = items.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= SAMPLE)
    sample = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("sample"))
    text = F.array_join(F.transform(rows, lambda r: F.array_join(r, "\u0001")), "\u0001")
    found = F.regexp_extract(text, r"(?i)(\d+\s*-\s*\d+)\s*(?:kcal|kkal|kalori)", 1)
    facts = sheets.select(key, F.col(name).alias("title"), found.alias("found")).join(sample, key, "left")
    meal = classify.meal_type(F.col("title"), F.col("sample"))
    kcal = F.when(F.col("found") != "", F.concat(F.replace("found", F.lit(" ")), F.lit(" kcal")))
    return facts.select(key, meal.alias("meal"), classify.is_celiac(F.col("title")).alias("celiac"), kcal.alias("kcal"))


def menus(sheets: DataFrame, key: str, name: str, rows: str, as_of: Column) -> DataFrame:
    """(key, date, meal, celiac, kcal, col, head, place, package, alternatives) of all sheets whose meal can be told.

    alternatives: struct(name, amount, calories), one for each dish that a cell offers; amounts and calories of the same
    number go with them one by one, a single one goes with each. package: the number of a package to take away, one row for
    each number that its cell names, each once in a list; null for a dish. An empty table gives no rows."""
    items = settled(listed(dated_cells(sheets, key, rows, as_of), key, as_of))  # read twice
    known = items.join(sheet_facts(sheets, items, key, name, rows), key).where("meal IS NOT NULL")
    numbers = F.regexp_extract_all("item", F.lit(r"(\d+)"), 1)
    package = F.when(F.col("package"), F.when(F.size(numbers) > 0, F.array_distinct(numbers)).otherwise(F.array(F.lit("1")))).otherwise(F.array(F.lit(None).cast("string")))
    split = known.select(*[c for c in known.columns if c != "package"], F.posexplode(package).alias("nth", "package"))
    once = Window.partitionBy(key, "col", "head", "package").orderBy("place", "nth")
    split = split.withColumn("again", F.row_number().over(once)).where(F.col("package").isNull() | (F.col("again") == 1))
    several = alternatives(F.col("item"))
    spelled = known.where(~F.col("package")).select("item").distinct()  # names repeat, and their rules are dear
    spelled = spelled.select("item", several.alias("several")).select("item", F.when(F.size("several") > 0, F.col("several")).otherwise(F.array(food_name(F.col("item")))).alias("names"))
    split = split.join(spelled, "item", "left")
    amounts, energies = (F.when(F.col(c).isNotNull(), split_outside(F.col(c))).otherwise(F.array().cast("array<string>")) for c in ("amount", "energy"))
    text = lambda c: F.lit(None).cast("string") if c is None else c
    dish = F.transform("names", lambda x, i: F.struct(x.alias("name"), aligned_value(amounts, i).alias("amount"), aligned_value(energies, i).alias("calories")))
    taken = F.array(F.struct(F.concat(F.lit(PACKAGE_NAME), "package").alias("name"), text(None).alias("amount"), text(None).alias("calories")))
    return split.select(key, "date", "meal", "celiac", "kcal", "col", "head", "place", "package", F.when(F.col("package").isNull(), dish).otherwise(taken).alias("alternatives"))
