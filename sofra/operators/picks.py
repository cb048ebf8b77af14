"""Trays near a budget: the four dishes of a menu that cost most without going over it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Pairs that are kept of each sum; pairs that are looked at in a step.
PAIRS, STEP = 3, 1 << 20


def _spent(pairs: np.ndarray, counts: np.ndarray, budget: int) -> tuple[int, tuple[int, ...]] | None:
    """The highest sum of two of the pairs within the budget, and their values' numbers; pairs are sorted by their sums.

    Each sum's partner is the highest one that fits. Where the two can't go together, as they need an item twice, the next
    lower one is looked at, as long as it would be better than what was found."""
    at = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
    sums, runs = pairs[at, 0], np.diff(np.append(at, len(pairs)))
    one = np.arange(len(sums))
    other = np.searchsorted(sums, budget - sums, side="right") - 1
    best, found = -1, None
    while True:
        live = (other >= 0) & (sums[one] + sums[other] > best)
        one, other = one[live], other[live]
        if not len(one):
            return None if found is None else (best, found)
        fits = np.zeros(len(one), bool)
        for i in range(PAIRS):
            for j in range(PAIRS):
                four = np.concatenate([pairs[at[one] + np.minimum(i, runs[one] - 1), 1:], pairs[at[other] + np.minimum(j, runs[other] - 1), 1:]], 1)
                can = ((four[:, :, None] == four[:, None, :]).sum(2) <= counts[four]).all(1)
                fits |= can
                total = np.where(can, sums[one] + sums[other], -1)
                k = int(total.argmax())
                if total[k] > best:
                    best, found = int(total[k]), tuple(four[k].tolist())
        one, other = one[~fits], other[~fits] - 1


def nearest_four(prices: np.ndarray, budget: int) -> tuple[int, ...] | None:
    """Places of four different items whose sum is the highest within the budget; None without any.

    Of items of one price four can be in a tray, so the first four stay; one that goes over the budget with the three
    cheapest is in none. What is left are n different prices and n * n pairs of them, looked at STEP at a time. Pairs of one
    sum share no price, so any other pair goes with one of three: three of each sum are kept, and memory follows from the
    number of different sums, at most the budget. It ends early with a tray of just the budget."""
    order = np.argsort(prices, kind="stable")
    p = prices[order]
    place = np.arange(len(p)) - np.searchsorted(p, p)
    order, p = order[place < 4], p[place < 4]
    if len(p) < 4:
        return None
    few = p + p[:3].sum() <= budget
    order, p = order[few], p[few]
    if len(p) < 4:
        return None
    values, first, counts = np.unique(p, return_index=True, return_counts=True)
    mixed = np.random.default_rng(0).permutation(len(values))  # cheap and dear ones from the start
    pairs, got, end, blocks = np.zeros((0, 3), np.int64), None, 0, 0
    while end < len(values) and (got is None or got[0] < budget):
        begin, end = end, min(len(values), end + max(1, STEP // max(end, int(STEP**0.5))))
        b, a = np.divmod(np.arange(begin * end, end * end), end)
        own = (a < b) | ((a == b) & (counts[mixed[b]] > 1))
        a, b = mixed[a[own]], mixed[b[own]]
        both = values[a] + values[b]
        lacks = (both <= budget) & (np.searchsorted(pairs[:, 0], both, side="right") - np.searchsorted(pairs[:, 0], both) < PAIRS)
        pairs = np.concatenate([pairs, np.stack([both, a, b], 1)[lacks]])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        pairs = pairs[np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0]) < PAIRS]
        blocks += 1
        if len(pairs) and (end == len(values) or blocks & (blocks - 1) == 0):
            got = _spent(pairs, counts, budget)
    if got is None:
        return None
    taken = sorted(got[1])
    return tuple(sorted(int(order[first[v] + taken[:i].count(v)]) for i, v in enumerate(taken)))


def trays(items: DataFrame, menu: str, item: str, price: Column, budget: Column | int) -> DataFrame:
    """(menu, total, items): for each menu the four items whose prices add up to the most that is not over the budget, in
    ascending order, and the sum; null without four items within it. Prices are whole numbers of the smallest coin; items
    without a price, and ones over the budget, are left out. Of equal sums any one is taken, the same one each time. Of the
    items of one price in a menu four meet the others, so a menu comes to as many rows as it has prices, times four."""
    rows = items.select(F.col(menu).alias("menu"), F.col(item).alias("item"), price.cast("long").alias("price"), F.lit(budget).cast("long").alias("budget")).where("price <= budget AND price >= 0")
    alike = Window.partitionBy("menu", "price").orderBy("item")
    rows = rows.withColumn("nth", F.row_number().over(alike)).where("nth <= 4").drop("nth")
    schema = T.StructType([T.StructField("menu", items.schema[menu].dataType), T.StructField("total", T.LongType()), T.StructField("items", T.ArrayType(items.schema[item].dataType))])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["price", "item"], kind="stable")
        found = nearest_four(group["price"].to_numpy(np.int64), int(group["budget"].iloc[0]))
        chosen = None if found is None else group.iloc[list(found)]
        return pd.DataFrame({"menu": group["menu"].iloc[:1], "total": pd.array([None if chosen is None else int(chosen["price"].sum())], dtype="Int64"), "items": [None if chosen is None else sorted(chosen["item"])]})

    return rows.groupBy("menu").applyInPandas(pick, schema).withColumnRenamed("menu", menu)  # one menu's prices
