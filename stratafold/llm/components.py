"""Connected components of a graph given as a table of edges, in rounds of joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratafold.llm.shared import staged


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge; a component is named by its smallest node.

    Alternates two steps until neither changes an edge: each node links its larger neighbours to its smallest
    one, then its smaller neighbours to the smallest one. Every round's edges are written to the shared folder, so
    that a lost executor costs a round at most. No edge list is gathered for a node: the smallest neighbour is a
    minimum that combines before the shuffle, and adaptive execution splits the join of a node with many edges.
    """
    small, large = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    links = staged(edges.where(F.col(a) != F.col(b)).select(small, large).distinct(), "links")
    while True:
        # large star: every node sees all neighbours; the larger ones link to the smallest
        both = links.union(links.select("hi", "lo")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        starred = both.join(least, "node").where(F.col("other") > F.col("node")).select(F.col("least").alias("lo"), F.col("other").alias("hi"))
        starred = staged(starred.where("lo < hi").distinct(), "large-star")
        # small star: a node's smaller neighbours, and itself, link to the smallest
        least = starred.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = starred.join(least, "hi")
        linked = joined.select(F.col("least").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").union(least.select(F.col("least").alias("lo"), "hi"))
        linked = staged(linked.distinct(), "small-star")
        # done when every larger node has one link, and no link's smaller node is itself linked lower
        lower = linked.join(linked.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        if lower == 0 and linked.groupBy("hi").count().where("count > 1").limit(1).count() == 0:
            break
        links = linked
    roots = linked.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return linked.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
