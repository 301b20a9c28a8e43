"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.session import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its smallest node.

    Each round hangs the root of a label under the smallest label that any of its nodes sees,
    then every node takes its root's root, so paths halve and a star or a chain of n nodes
    takes about log n rounds. All grouping is by ``min``, which combines before the shuffle.
    Each round's labels are written, which cuts the lineage. Links with a null end or between
    equal nodes link nothing; the nodes still appear.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.dropna().filter("a <> b").distinct(), "edges")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    own = nodes.dropna().distinct().withColumn("label", F.col("node"))
    first = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = own.join(first, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"))
    labels = staged(_jump(labels), "labels")
    while True:
        seen = (
            edges.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "other"), "b")
            .join(labels.withColumnRenamed("node", "a"), "a")
            .filter("other < label")
            .groupBy(F.col("label").alias("node"))
            .agg(F.min("other").alias("low"))
        )
        seen = staged(seen, "hooks")
        if seen.isEmpty():
            discard(edges, seen)
            return labels.withColumnRenamed("label", "component")
        hooked = labels.join(seen, "node", "left").select("node", F.coalesce("low", "label").alias("label"))
        read = [labels, seen]
        for _ in range(2):
            hooked = staged(_jump(hooked), "labels")
            read.append(hooked)
        discard(*read[:-1])
        labels = _settled(hooked)


def _jump(labels: DataFrame) -> DataFrame:
    """Each node's label becomes the label of that label."""
    up = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def _settled(labels: DataFrame) -> DataFrame:
    """Jumps until every label is a root."""
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        if labels.join(up, "label").filter("label <> root").isEmpty():
            return labels
        above = staged(_jump(labels), "labels")
        discard(labels)
        labels = above
