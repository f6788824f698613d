"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.session import pin


def components(links: DataFrame) -> DataFrame:
    """`node, component` for every node of `links` (columns `a`, `b`); a component is named by its smallest node.

    Every round each node takes the smallest label of itself and its neighbours, then the label of that label, so that
    long chains take a logarithmic number of rounds in practice. A label's rows are combined before the shuffle, so a
    node with very many links is no task of its own.
    """
    edges = pin(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = pin(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_heard"))
        told = labels.join(heard, "node", "left").select("node", F.col("label").alias("_old"), F.least("label", "_heard").alias("label"))
        told = pin(told)
        jump = told.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        nexts = pin(told.join(jump, "label", "left").select("node", "_old", F.least("label", "_next").alias("label")))
        if nexts.filter("label < _old").isEmpty():
            return nexts.select("node", F.col("label").alias("component"))
        labels = nexts.select("node", "label")
