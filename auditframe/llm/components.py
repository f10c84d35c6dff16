"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import stored


def _ranked(node: str) -> Column:
    """Nodes in an order that has nothing to do with their numbers, the same in every round."""
    return F.struct(F.xxhash64(node).alias("place"), F.col(node).alias("node"))


def _named(links: DataFrame, up: DataFrame) -> DataFrame:
    """Links between the nodes that stand for their ends, each once and without loops."""
    for end in ("a", "b"):
        links = links.join(up.withColumnRenamed("up", f"up_{end}"), links[end] == up["node"]).drop("node")
    lower, upper = F.least("up_a", "up_b"), F.greatest("up_a", "up_b")
    return links.select(lower.alias("a"), upper.alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long): the smallest node that links lead to.

    In a round each node goes up to the first of its neighbours and itself, in an order by hash: partial aggregates, so a
    hub costs its links and no task gathers them. The links between the nodes that are left are the next round's
    graph, a fraction of this one even for long chains, until none is left. Then labels go down the same way. Rounds are
    written out; there is no limit to their number. No edges give no rows.
    """
    links = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    ups: list[DataFrame] = []
    while True:
        ends = links.select("a", "b").union(links.select("b", "a"))
        first = F.least(_ranked("a"), F.min(_ranked("b")))
        up = stored(ends.groupBy("a").agg(first["node"].alias("up")).withColumnRenamed("a", "node"), "up")
        ups.append(up)
        links = stored(_named(links, up), "edges")
        if links.isEmpty():
            break
    tops = ups.pop()
    while ups:
        higher = tops.toDF("up", "top")
        tops = ups.pop().join(higher, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    tops = stored(tops, "tops")
    smallest = tops.groupBy("up").agg(F.min("node").alias("label"))
    return stored(tops.join(smallest, "up").select("node", "label"), "labels")
