"""Connected components over an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Stored, stored

#: Labels go so far in fewer rounds than the logarithm of any corpus.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, rounds: int | None = None) -> Stored:
    """(node, component) for every end of ``edges`` (a, b); a component is named by its least node.

    Least labels go along edges, and each label then takes its own node's label, so long chains
    take a logarithmic number of rounds.  Minima are combined before each shuffle, so one node
    with very many edges is no hot group.  Each round's labels are dropped once the next are stored.
    With ``rounds`` it stops after so many: nodes of one label are in one component then, but a
    component may still have several labels.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = stored(both.unionByName(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    first = both.frame.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component"))
    labels = stored(first.withColumn("was", F.col("node")), "labels")
    for turn in range(rounds or MOST_ROUNDS):
        own = labels.frame.select("node", "component", F.col("component").alias("was"))
        offered = both.frame.join(own.select(F.col("node").alias("near"), "component"), "near").select("node", "component", F.lit(None).cast("long").alias("was"))
        lower = own.unionByName(offered).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        ahead = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = lower.join(ahead, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "was")
        before, labels = labels, stored(jumped, "labels")
        before.drop()
        if turn + 1 == rounds or labels.frame.filter("component < was").isEmpty():
            both.drop()
            return Stored(labels.frame.drop("was"), labels.path)
    raise ArithmeticError("components did not settle")
