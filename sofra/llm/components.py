"""Connected components of a link table, as smallest reachable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in (a, b) links. Each round takes the least label of the neighbours, then that label's own
    label, so chains shorten by jumps. All steps are joins and aggregations with partial sums; every round is written out."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        low = label.join(near, "id").select("id", "comp", F.least("comp", "m").alias("low"))
        jump = low.join(label.select(F.col("id").alias("low"), F.col("comp").alias("far")), "low", "left").select("id", "comp", F.least("low", F.coalesce("far", "low")).alias("new"))
        moved = materialise(jump)
        changed = moved.where("new <> comp").limit(1).count()
        discard(label)
        label = moved.select("id", F.col("new").alias("comp"))
        label._scratch = moved._scratch
        if not changed:
            discard(both)
            return label
