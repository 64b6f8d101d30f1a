"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import discard, spread_join, staged

ROUNDS = 60
HOT = 100_000


def components(links: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of each node of links (a, b), both of one orderable type; root is the component's least node.

    Each step is two shuffles over links; every round is written to the shared folder and the one before is
    deleted, so no lineage or disk grows and a lost executor costs one round. A hub's links are counted and dealt to many tasks, never gathered in a row.
    """

    def linked(edges: DataFrame, per: DataFrame, rows: int) -> DataFrame:
        """edges with their nodes' least; only tables of many rows can hold a node that needs dealing."""
        least = per.drop("n")
        return edges.join(least, "a") if rows <= HOT else spread_join(edges, least, ["a"], per.select("a", "n"), hot=HOT)

    def star(edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
        per = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        least = per.drop("n")
        out = linked(edges, per, 2 * rows).where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out, least

    edges = staged(links.select("a", "b").where("a <> b").distinct())
    sign, rows = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = star(both, F.col("b") > F.col("a"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small, least = star(down, F.lit(True))
        last, edges = edges, staged(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == sign:
            break
        sign, rows = now, now[0]
    else:
        raise RuntimeError("the components are not done")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct())
