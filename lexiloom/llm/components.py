"""Connected components by contraction: joins and minima of tables, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    A round points each node at its smallest neighbour, follows the pointers twice
    and replaces the ends of the edges, which at least halves the live nodes; the
    pointers of all rounds are then composed. Loops, repeated and null ends are no
    links; no edges give no rows.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "up")
        for _ in range(2):
            up = _follow(up, up)
        up = cut_lineage(up, "up")
        hops.append(up)
        named = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: E731, B023
        edges = cut_lineage(
            edges.join(named("a"), "a").join(named("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .where("a <> b").distinct(), "edges")
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hops[0]
    for hop in hops[1:]:
        out = _follow(out, hop)
    return cut_lineage(out.select("node", F.col("up").alias("component")), "components")


def _follow(up: DataFrame, hop: DataFrame) -> DataFrame:
    """Replace every pointer by where ``hop`` sends it; a node without a hop stays."""
    then = hop.select(F.col("node").alias("up"), F.col("up").alias("then"))
    return up.join(then, "up", "left").select("node", F.coalesce("then", "up").alias("up"))
