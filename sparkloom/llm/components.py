"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """For columns a and b (any order, repeats allowed): one row per node with the smallest node that it reaches.

    Each round takes the least label among the neighbours and then that label's own label, so chains halve.
    Labels are tables in the shared scratch folder, of which only the last round's stays; nothing is collected but one
    count a round. A hub's edges and a giant component's label are heavy keys of joins between plain shuffles, in which
    the other side has one row a key, so that adaptive execution splits them.
    No edges: an empty frame. An edge with a null end is left out.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(edges.union(edges.select("b", "a")).distinct())
    table = labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    # labels only fall, so equal sums mean equal labels
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    last = labels.agg(total(F.col("label"))).first()[0]
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = materialize(labels.union(seen).groupBy("node").agg(F.min("label").alias("label")))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = materialize(least.join(far, "label").select("node", "label", "far"))
        now, later, jumps = jumped.agg(total(F.col("label")), total(F.least("label", "far")), F.max(F.expr("far < label"))).first()
        release(least, table)
        table, labels = jumped, jumped.select("node", F.least("label", "far").alias("label"))
        if not jumps and now == last:
            release(both)
            return labels
        last = later
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
