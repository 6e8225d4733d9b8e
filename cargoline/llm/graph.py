"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cargoline.session import apart, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Rounds of large-star and small-star until the edges stay as they are; each round is written to the shared folder, so that lineage
    stays short and a lost executor costs a re-read. A node with very many neighbours is only ever the key of a minimum and of a join
    that Spark can split. Many edges are no broadcast, however small their file. Null ends and loops are no edges; an empty graph has no rows.
    """
    current = materialize(_distinct(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = None
    while (now := _print(current)) != before:
        before = now
        current = materialize(_small_star(_large_star(current)), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node of its neighbourhood."""
    least = edges.groupBy("v").agg(F.min("u").alias("_")).select(F.col("v").alias("c"), F.col("v").alias("m"))
    lower = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    centre = apart(least.unionByName(lower).groupBy("c").agg(F.min("m").alias("m")), edges)
    return _distinct(edges.join(centre, edges.v == centre.c).select("u", F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    joined = edges.join(apart(least, edges), edges.u == least.c)
    return _distinct(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))))
