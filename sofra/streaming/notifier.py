"""Meal notifications: a stream of minutes meets the subscriptions that wait for them.

Ticks are joined with static tables, so the stream has no state; a minute that arrives twice gives the same rows twice, and
the sink keeps one by (subscription, day, meal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guard import contains_any
from ..functions.turkish import slug, soft_lower

#: Families of dishes by meal, the first that fits; what is no main dish.
FAMILIES = {
    "breakfast": (
        ("hot", ("börek", "kızartma", "menemen", "omlet", "pişi", "pizza")),
        ("egg", ("yumurta",)),
        ("pastry", ("açma", "pogaca", "poğaça", "simit")),
    ),
    "dinner": (
        ("meat", ("fajita", "kavurma", "kofte", "köfte", "şinitzel", "tas kebabı", "tavuk")),
        ("vegetable", ("bezelye", "ispanak", "ıspanak", "kabak", "karnabahar", "pirasa", "pırasa", "turlu", "türlü")),
        ("pulse", ("barbunya", "kuru fasulye", "mercimek", "nohut")),
    ),
}
SIDES = ("ayran", "cacık", "corba", "çorba", "ekmek", "salata", "su")
#: What is said of each family, {dish} being the main dish and {all} every dish; families that are not listed have the plain ones.
TEXTS = {
    "plain": ("Bugün: {all}.", "Menü hazır: {all}."),
    "hot": ("Sıcak kahvaltı: {dish}.", "{dish} soğumadan gel."),
    "meat": ("Ana yemek {dish}.", "Bugün {dish} var."),
}
NO_CITY = "Yurt"


def waiting(subscriptions: DataFrame) -> DataFrame:
    """(id, city_id, meal, time) of the enabled meals of (id, city_id, breakfast_on, breakfast_time, dinner_on, dinner_time)."""
    meals = F.array(*[F.struct(F.lit(m).alias("meal"), F.col(f"{m}_on").alias("on"), F.col(f"{m}_time").alias("time")) for m in ("breakfast", "dinner")])
    return subscriptions.where("city_id IS NOT NULL").select("id", "city_id", F.explode(meals).alias("m")).where("m.on").select("id", "city_id", "m.meal", "m.time")


def is_side(dish: Column) -> Column:
    """Whether a dish is no main dish. Water counts as a word of its own, so that sausages stay."""
    low = soft_lower(dish)
    return contains_any(low, tuple(s for s in SIDES if s != "su")) | low.rlike(r"(?<!\p{L})su(?!\p{L})")


def family(meal: Column, dishes: Column, families: dict = FAMILIES) -> Column:
    """The first family of the meal that a dish belongs to, else 'plain'."""
    out = F.lit("plain")
    for m, listed in families.items():
        of = F.lit("plain")
        for name, words in reversed(listed):
            of = F.when(contains_any(soft_lower(F.array_join(dishes, "\n")), words), name).otherwise(of)
        out = F.when(meal == m, of).otherwise(out)
    return out


def sayings(kind: Column, dishes: Column, texts: dict[str, tuple[str, ...]] = TEXTS) -> Column:
    """The variants of a family's text, an array, with its main dish filled in."""
    main = F.coalesce(F.try_element_at(F.filter(dishes, lambda d: ~is_side(d)), F.lit(1)), F.try_element_at(dishes, F.lit(1)))
    say = lambda t: F.replace(F.replace(F.lit(t), F.lit("{dish}"), main), F.lit("{all}"), F.array_join(dishes, ", "))
    out = F.array(*[say(t) for t in texts["plain"]])
    for name, ts in texts.items():
        if name != "plain":
            out = F.when(kind == name, F.array(*[say(t) for t in ts])).otherwise(out)
    return out


def picked(variants: Column, choice: Column) -> Column:
    """One of the variants by a number."""
    return F.element_at(variants, (F.pmod(choice, F.size(variants)) + 1).cast("int"))


def body(kind: Column, dishes: Column, choice: Column, texts: dict[str, tuple[str, ...]] = TEXTS) -> Column:
    """The text of a family, one of its variants by a number, with its main dish filled in."""
    return picked(sayings(kind, dishes, texts), choice)


def notifications(ticks: DataFrame, subscriptions: DataFrame, menus: DataFrame, cities: DataFrame, texts: dict = TEXTS, families: dict = FAMILIES) -> DataFrame:
    """(id, day, meal, title, body, url) for each subscription whose time is a tick's minute (tick timestamp; a batch or a
    stream) and whose city has a menu of that day and meal: menus (city_id, day, meal, dishes). An empty menu says nothing. A
    city without a name has a general one. The variant is chosen by a hash of subscription and day, so reruns agree. All that
    a menu says is written once for each menu, before the subscriptions meet it."""
    due = ticks.select(F.to_date("tick").alias("day"), F.date_format("tick", "HH:mm").alias("time"))
    city = F.coalesce("city", F.lit(NO_CITY))
    title = F.concat(city, F.lit(" - "), F.when(F.col("meal") == "breakfast", "kahvaltı").otherwise("akşam yemeği"))
    told = menus.where(F.size("dishes") > 0).join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city")), "city_id", "left")
    told = told.select("city_id", "day", "meal", title.alias("title"), sayings(family(F.col("meal"), F.col("dishes"), families), F.col("dishes"), texts).alias("variants"), F.concat(F.lit("/"), slug(city)).alias("url"))
    rows = due.join(waiting(subscriptions), "time").join(told, ["city_id", "day", "meal"])
    choice = F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.col("day").cast("string")).cast("binary"))
    return rows.select("id", "day", "meal", "title", picked(F.col("variants"), choice).alias("body"), "url")


def run_notifier(spark: SparkSession, ticks: DataFrame, subscriptions: DataFrame, menus: DataFrame, cities: DataFrame, folder: str) -> DataFrame:
    """All notifications so far, each once, after the ticks that there are; goes on from its checkpoint when called again."""
    made = notifications(ticks, subscriptions, menus, cities)
    write = lambda batch, epoch: batch.dropDuplicates(["id", "day", "meal"]).write.mode("overwrite").parquet(f"{folder}/sent/epoch={epoch}")
    made.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], made.schema).write.mode("overwrite").parquet(f"{folder}/sent/epoch=-1")
    return spark.read.schema(made.schema).parquet(f"{folder}/sent").dropDuplicates(["id", "day", "meal"])
