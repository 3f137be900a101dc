"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.sources.checkpoints import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Each round every vertex goes to the smallest of itself and its neighbours, and links between what is left are
    taken up again; a component shrinks to its smallest vertex in a number of rounds that is logarithmic in practice.
    Minima are taken before the shuffle, so a vertex with very many links is no hot key; every round is stored.
    """
    links = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "at")
        smallest = cut_lineage(smallest)
        if labels is None:
            labels = smallest.select(F.col("at").alias("id"), F.col("to").alias("component"))
        else:
            moved = labels.join(smallest, F.col("component") == F.col("at"), "left")
            labels = moved.select("id", F.coalesce("to", "component").alias("component"))
        labels = cut_lineage(labels)
        to = lambda side: smallest.select(F.col("at").alias(side), F.col("to").alias(f"{side}2"))
        links = links.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        links = cut_lineage(links.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if links.isEmpty():
            return labels
