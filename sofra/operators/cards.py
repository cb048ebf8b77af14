"""The whole document of a menu: its city, items, packages, prices, calories, votes and comments in one plan."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import match_ratio
from ..functions.dates import month_range
from ..functions.scalars import calorie_label, price_label
from .menus import blackout, diet_bucket, tiered_price
from .votes import vote_summary

#: Meals in their order; a day's trust from which it is approved, and the distance from which it is not.
MEALS = ("breakfast", "lunch", "dinner")
TRUSTED, ODD = 30, 0.65


def meal_rank(meal: Column) -> Column:
    """The place of a meal in the day; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(m) for m in MEALS]), meal)
    return F.when(at > 0, at).otherwise(len(MEALS) + 1)


def selected(menus: DataFrame, city: int | None = None, day: Date | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
    """Menus of a city, of a day or else of a month, as ranges that reach the scan; a day makes the month void, a year
    without a month filters nothing."""
    if city is not None:
        menus = menus.where(F.col("city_id") == city)
    if day is not None:
        return menus.where(F.col("serve_date") == F.lit(day))
    return menus.where(month_range(F.col("serve_date"), year, month)) if year and month else menus


def priced(items: DataFrame, by_name: DataFrame, by_category: DataFrame) -> DataFrame:
    """items with the label of the price of their name, or else of their category; none in months without service."""
    found = tiered_price(items, [("name", by_name), ("category", by_category)], "amount_due")
    return found.withColumn("price", price_label(blackout(F.col("serve_date"), F.col("amount_due")))).drop("amount_due")


def menu_documents(menus: DataFrame, cities: DataFrame, items: DataFrame, aliases: DataFrame, dishes: DataFrame, votes: DataFrame, comments: DataFrame, by_name: DataFrame, by_category: DataFrame, celiac_mode: bool = False, me: Column | None = None) -> DataFrame:
    """One row for each menu that has a city: id, city_name, serve_date, meal_type, status, items, takeaways, official_calories,
    calculated_calories, comment_count, vote_count, rating_sum, my_vote.

    items: (menu_id, alias_id, order_index, is_alternative, package, amount, calories); aliases: (id, name, dish_id); dishes:
    (id, name, category, is_celiac, estimated_calories); votes: (menu_id, user_id, sentiment); comments: (menu_id, is_deleted).
    Items are ordered by order_index, alternatives after what they replace, packages by name. A dish without a catalogue row
    keeps its alias, without category. Calories are summed over items, not packages. Votes, comments and items are summed by
    menu before they meet it, so a menu with very many votes is not gathered."""
    head = menus.select("id", "city_id", "serve_date", "meal_type", "status", "calories_min", "calories_max").join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name")), "city_id")
    dish = dishes.select(F.col("id").alias("dish_id"), F.col("name").alias("dish_name"), "category", "is_celiac", "estimated_calories")
    rows = items.join(aliases.select(F.col("id").alias("alias_id"), F.col("name").alias("raw_name"), "dish_id"), "alias_id").join(dish, "dish_id", "left")
    rows = rows.withColumn("bucket", diet_bucket(F.col("package"), F.col("is_celiac"), celiac_mode)).where("bucket IS NOT NULL")
    rows = rows.join(menus.select(F.col("id").alias("menu_id"), "serve_date"), "menu_id").withColumn("name", F.coalesce("dish_name", "raw_name"))
    rows = priced(rows, by_name, by_category)
    item = F.struct("order_index", "is_alternative", "raw_name", "amount", "calories", "price", "category", "dish_id")
    main = F.col("bucket") == "items"
    total = F.sum(F.when(main, F.coalesce("calories", "estimated_calories", F.lit(0))))
    packages = rows.where(~main).groupBy("menu_id", "package").agg(F.array_sort(F.collect_list(item)).alias("items"))
    packages = packages.groupBy("menu_id").agg(F.array_sort(F.collect_list(F.struct(F.col("package").alias("name"), "items"))).alias("takeaways"))
    per = rows.groupBy("menu_id").agg(F.array_sort(F.collect_list(F.when(main, item))).alias("items"), F.when(total > 0, total).alias("calculated_calories"))
    counts = vote_summary(votes, ["menu_id"]).select("menu_id", F.col("n_votes").alias("vote_count"), F.col("score").alias("rating_sum"))
    mine = votes.where(F.lit(False) if me is None else F.col("user_id") == me).groupBy("menu_id").agg(F.max("sentiment").alias("my_vote"))
    live = comments.where(~F.col("is_deleted")).groupBy("menu_id").agg(F.count("*").alias("comment_count"))
    out = head.withColumnRenamed("id", "menu_id")
    for part in (per, packages, counts, mine, live):
        out = out.join(part, "menu_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(F.col("menu_id").alias("id"), "city_name", "serve_date", "meal_type", "status", none("items", per.schema["items"].dataType), none("takeaways", packages.schema["takeaways"].dataType), calorie_label(F.col("calories_min"), F.col("calories_max")).alias("official_calories"), F.col("calculated_calories").cast("long").alias("calculated_calories"), zero("comment_count"), zero("vote_count"), zero("rating_sum"), "my_vote")


def day_reviews(items: DataFrame, day: str, meal: str, name: str, order: list[str], words: tuple[str, ...], distances: DataFrame | None = None, meals: tuple[str, ...] = MEALS) -> DataFrame:
    """(day, n_items, trust, text, distance, status) of each day: the mean share of known words in its dishes, rounded half
    away from zero, all names in order as one text, and whether somebody should look at it: at a trust under 30, or a
    distance (of `distances`: day, distance) over 0.65. Days whose items are all null have no trust and are to be looked at.

    meals: those that count; the platform itself leaves lunch out. Sums and texts are partial before the shuffle by day."""
    rows = items.where(F.col(meal).isin(*meals))
    ratio = match_ratio(F.col(name), words)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(meal_rank(F.col(meal)).alias("m"), *order, F.col(name).alias("x"))))), lambda s: s["x"]), " ")
    per = rows.groupBy(day).agg(F.count(name).alias("n_items"), F.coalesce(F.round(F.avg(F.when(F.col(name).isNotNull(), ratio))).cast("int"), F.lit(0)).alias("trust"), text.alias("text"))
    per = per.join(distances.select(day, "distance"), day, "left") if distances is not None else per.withColumn("distance", F.lit(None).cast("double"))
    return per.withColumn("status", F.when((F.col("trust") >= TRUSTED) & ~F.coalesce(F.col("distance") > ODD, F.lit(False)), "approved").otherwise("needs_review"))


def adjacent_distinct(values: Column) -> Column:
    """An array without the elements that equal the one before them."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.try_element_at(values, i.cast("int"))))


def day_captions(menus: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_dishes, calories of share cards: the number of dishes of all menus of a key, and their calorie ranges added up
    over those that have both ends."""
    both = F.col("calories_min").isNotNull() & F.col("calories_max").isNotNull()
    counts = items.groupBy("menu_id").agg(F.count("*").alias("n"))
    rows = menus.join(counts, F.col("id") == F.col("menu_id"), "left")
    low, high = (F.sum(F.when(both, F.col(c))) for c in ("calories_min", "calories_max"))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_dishes"), calorie_label(low, high).alias("calories"))


def slots(items: DataFrame, menu: str, order: str, alternative: str, name: str) -> DataFrame:
    """(menu, slot, names): the dishes of each place of a menu, what is meant first before its alternatives; slots count from 0."""
    per = items.groupBy(menu, order).agg(F.transform(F.array_sort(F.collect_list(F.struct(alternative, name))), lambda x: x[name]).alias("names"))
    return per.select(menu, (F.row_number().over(Window.partitionBy(menu).orderBy(order)) - 1).alias("slot"), "names")
