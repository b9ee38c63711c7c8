"""Connected components of a link table by contraction; every round ends in
tables in the shared folder, nothing but a yes or no reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import NARROW, in_tasks, staged


def components(links: DataFrame, rows: int) -> DataFrame:
    """(node, comp) for every node of ``links`` (u, v), with one ``comp`` for
    all nodes of a component (one of them).  ``rows`` is the number of links or
    an upper bound; every stage has as many tasks as its rows are worth.

    A round points every node at the least of itself and its neighbours and
    replaces the nodes of every link by what they point at, until no link is
    left.  Nodes are hashes, so that few rounds do: a star is gone after one,
    and of a long chain a constant share of the nodes goes in each."""
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"),
                                                         F.col("u").alias("v"))))
    edges = staged(in_tasks(links.where("u != v").select(both.alias("e")).select("e.u", "e.v")
                            .distinct(), 2 * rows * NARROW), "links")
    steps, most = [], 0
    while n := edges.count():
        few = lambda df: in_tasks(df, n * NARROW)
        to = staged(few(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to"))), "step")
        steps.append(to)
        most = max(most, n)
        end = to.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        edges = staged(few(few(few(edges.join(to, "u")).join(end, "v")).where("to != to_v")
                           .select(F.col("to").alias("u"), F.col("to_v").alias("v")).distinct()),
                       "links")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = steps[0].select(F.col("u").alias("node"), F.col("to").alias("comp"))
    for to in steps[1:]:  # a node no later round mentions stays where it points
        out = in_tasks(out.join(to, F.col("comp") == F.col("u"), "left"), most * NARROW).select(
            "node", F.coalesce("to", "comp").alias("comp"))
    return staged(out, "labels")
