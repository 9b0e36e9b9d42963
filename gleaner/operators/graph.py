"""Connected components over an edge table that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of an undirected edge table with the smallest vertex it can reach.

    Alternating large-star / small-star contraction: each round is two aggregations and
    two equi-joins on the vertex, so the work per round is linear in the edges and the
    number of rounds grows with the logarithm of the largest component. Minimum labels
    are pre-aggregated before the shuffle and edges are de-duplicated after each round,
    so a hub with a third of all edges shrinks to one edge per neighbour. Lineage is cut
    by writing each round to the shared folder.

    Null endpoints and self loops are ignored; repeated edges count once; an empty edge
    table gives an empty result. Returns ``(vertex, component)``, one row per vertex that
    has at least one edge to another vertex.
    """
    e = (
        edges.select(F.least(F.col(a), F.col(b)).alias("u"), F.greatest(F.col(a), F.col(b)).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = materialize(e, "cc-edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: every vertex points to a smaller one; hang all its smaller neighbours below the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        nxt = materialize(small.select(F.col("v").alias("u"), F.col("u").alias("v")), "cc-round")
        # stable once every edge leads from a root to a leaf: no vertex is both, and no leaf has two roots
        roots, leaves = nxt.select(F.col("u").alias("x")).distinct(), nxt.groupBy(F.col("v").alias("x")).agg(F.count("*").alias("n"))
        unstable = leaves.where(F.col("n") > 1).select("x").unionByName(leaves.join(roots, "x", "left_semi").select("x"))
        done, e = e, nxt
        drop_materialized(done)
        if unstable.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("v").alias("vertex"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct()
    )
