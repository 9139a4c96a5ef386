"""Connected components of a link table, as Spark joins.

Alternating large-star and small-star rounds: each node hands its larger
neighbours to the smallest node it sees, then keeps the smallest one for itself.
After a round every component is shallower; the rounds end when all of them are
stars, and each edge then leads from a node to the smallest id of its component.
The smallest neighbour is a grouped minimum with partial sums, so a hub costs no
more than its rows, and the joins with it can be split by adaptive execution.
Every round is a staged table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.sources.staging import stage


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself, or is such a neighbour."""
    # A node that is someone's smaller neighbour counts as its own; edges may be repeated.
    sides = edges.select("high", "low").unionByName(edges.select(F.col("low").alias("high"), "low"))
    seen = sides.groupBy("high").agg(F.min("low").alias("least"), F.max("low").alias("most"))
    return seen.where("least < most").isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component_id`` for every node that has a link to another one.

    Links may be in either direction and repeated; links with a null end or to
    the same node say nothing and are ignored. Without links the result is empty.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    edges = stage(links.where(F.col(left) != F.col(right)).select(high.alias("high"), low.alias("low")), "edges")
    repeated = True  # until a round has told edges apart
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("seen")).select(F.col("high").alias("hub"), F.least("high", "seen").alias("least"))
        # Large star: the hub's larger neighbours go to the smallest node it sees.
        large = both.join(least, both["low"] == least["hub"]).where((F.col("high") > F.col("low")) & (F.col("high") != F.col("least"))).select("high", F.col("least").alias("low"))
        # Dealt once by the node, for its minimum and for the join with it.
        large = large.repartition("high")
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        ends = F.array("high", F.when(F.col("low") != F.col("least"), F.col("low")))
        small = large.join(least, "high").select(F.explode(ends).alias("high"), F.col("least").alias("low")).where("high IS NOT NULL")
        edges, repeated = stage(small.distinct(), "edges"), False
    edges = edges.distinct() if repeated else edges
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component_id")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component_id")).unionByName(roots)
