"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def connected(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (id, label), the smallest id reachable, of every id in a link.

    Each round a node takes the smallest label among its neighbours' and its own, then the label
    of that label (a shortcut that halves chains), until no label changes: labels only fall, so
    that comes.  Labels of a hub's neighbours are combined before the shuffle, the joins carry two
    longs a row, and a round's table replaces the one before."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("moved")), "cc-labels")
    while not labels.where("moved").isEmpty():
        now = labels.select("id", "label")
        near = edges.join(now.toDF("b", "lb"), "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("m"))
        step = now.join(near, "id").select("id", F.least("label", "m").alias("l1"), F.col("label").alias("old"))
        new = step.join(now.toDF("l1", "l2"), "l1", "left").select("id", F.least("l1", F.coalesce("l2", "l1")).alias("label"), "old")
        labels = cut(new.select("id", "label", (F.col("label") != F.col("old")).alias("moved")), "cc-labels", labels)
    release(edges)
    return labels.select("id", "label")
