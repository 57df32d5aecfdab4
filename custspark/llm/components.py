"""Connected components of a table of links, by joins; nothing is gathered by the driver or one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custspark.session import forget, materialise


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for each node of the links (columns a, b of one type).

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so distances shrink at least by half; every round is written, and so
    survives lost executors. Links may repeat, in either direction; no links, no rows.
    """
    pairs = links.select("a", "b").filter("a <> b")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(pairs.select(F.inline(both)).distinct(), "edges")
    stored = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    labels = stored
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        stepped = lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root"))
        now = materialise(stepped, "labels")
        forget(stored)
        stored, labels = now, now.select("node", "root")
        if now.filter("old <> root").isEmpty():
            forget(edges)
            return labels
