"""Connected components by minimum labels, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each endpoint of `edges` reaches.

    Every round gives each vertex the smallest label among its neighbours and itself and then jumps to
    the label's own label, so a path of n vertices needs about log n rounds. A round is two shuffles of
    the vertices and one of the edges; all aggregates are combined map-side, so a star with a huge
    centre is no hot group. The number of changed labels is the only value that reaches the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("n"))
        low = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        # hook: whoever carries the old label also hears of the new one
        heard = low.where("l < old").groupBy(F.col("old").alias("u")).agg(F.min("l").alias("h"))
        low = low.join(heard, "u", "left").select("u", "old", F.least("l", F.coalesce("h", "l")).alias("l"))
        jump = low.join(low.select(F.col("u").alias("l"), F.col("l").alias("j")), "l", "left")
        new = jump.select("u", F.least("l", F.coalesce("j", "l")).alias("l"), (F.least("l", F.coalesce("j", "l")) < F.col("old")).alias("c")).checkpoint()
        labels = new.select("u", "l")
        if new.where("c").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
