"""Connected components of a link table by repeated hooking and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.storage import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """``node, root`` for pointers ``node, parent`` that always lead to smaller nodes; pointers are doubled until they stand still."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialize(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "jump")
        parents = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            return parents.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node in ``links`` (``a, b``, longs): label is the smallest node reachable.

    Every round each node points to its smallest neighbour, if that is smaller; trees are
    flattened and links between the same trees dropped, so at least half of the
    trees that still have links go. Links with nulls are not links; repeated ones count once.
    """
    links = materialize(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    labels = None
    while links.limit(1).count():
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        roots = _roots(materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "hook"))
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            now = labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
            labels = materialize(now.select("node", F.coalesce("root", "label").alias("label")), "labels")
        lo, hi = roots.select(F.col("node").alias("lo"), F.col("root").alias("rlo")), roots.select(F.col("node").alias("hi"), F.col("root").alias("rhi"))
        moved = links.join(lo, "lo").join(hi, "hi").filter("rlo <> rhi")
        links = materialize(moved.select(F.least("rlo", "rhi").alias("lo"), F.greatest("rlo", "rhi").alias("hi")).distinct(), "links")
    if labels is None:
        return links.select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    return labels
