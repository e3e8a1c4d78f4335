"""Connected components of links, by alternating large and small stars in Spark.

A round takes the smallest neighbour of each node by a grouped minimum, which is joined back to the links, so no
vertex' links are gathered anywhere: minima are combined on the map side, and the joins are free to split a hot
node.  Minima of at most ``MOST_BROADCAST`` nodes are broadcast.  Rounds are checkpointed.  The minima also show
whether what is left is stars, which ends it, after O(log^2 n) rounds at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S

#: Nodes, of 16 bytes, up to which their smallest neighbours are broadcast.
MOST_BROADCAST = 250_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component: the smallest node reachable.

    Null ends and loops are ignored, repeated links count once; without links the result is empty.  It is marked for
    broadcast up to ``MOST_BROADCAST`` nodes.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = S.kept(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("a"), low.alias("b")))
    while True:
        nodes, seen = S.counted(_nodes(links), open=F.count_if(F.expr("smaller > 0 AND (larger > 0 OR smallest <> most)")))
        few = seen["rows"] <= MOST_BROADCAST
        if not seen["open"]:
            # stars: a node that is no center has one neighbour, its center
            return S.broadcast_if(nodes.select("node", F.least("node", "smallest").alias("component")), few)
        links = S.kept(_small_star(_large_star(links, nodes, few), few))


def _nodes(links: DataFrame) -> DataFrame:
    """node, its smallest neighbour, the largest of those smaller than itself, and how many links go each way."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("end")).select("end.*")
    down = F.col("other") < F.col("node")
    return ends.groupBy("node").agg(F.min("other").alias("smallest"), F.max(F.when(down, F.col("other"))).alias("most"), F.count_if(down).alias("smaller"), F.count_if(~down).alias("larger"))


def _large_star(links: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """Links the larger neighbours of each node to its smallest neighbour or itself."""
    least = nodes.select(F.col("node").alias("b"), F.least("node", "smallest").alias("m"))
    return links.join(S.broadcast_if(least, few), "b").select("a", F.col("m").alias("b"))


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them; every link has a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(S.broadcast_if(least, few), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()
