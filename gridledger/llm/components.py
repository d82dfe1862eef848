"""Connected components by contraction, with the graph in shared storage between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long ids) to ``id, component``: the least id that links reach, for every id on an edge.

    In each round every node joins the neighbour of highest degree, itself included; ties fall to a hash that changes
    with the round, so chains shrink by a constant share too, and a star goes in one round. Nodes that joined are
    replaced by what they joined, and edges that became loops or repeats go. A round costs aggregates that combine
    before the shuffle and joins by node; nothing is gathered on the driver but the number of edges left.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    owner = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("at", F.col("id"))
    round_number = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = both.groupBy("a").agg(F.struct(F.count("*").alias("degree"), F.xxhash64("a", F.lit(round_number)).alias("draw"),
                                              F.col("a").alias("to")).alias("rank"))
        best = both.join(rank.select(F.col("a").alias("b"), "rank"), "b").groupBy("a").agg(F.max("rank").alias("best"))
        joins = (
            best.join(rank, "a").select("a", F.greatest("best", "rank")["to"].alias("to")).checkpoint()
        )
        owner = (
            owner.join(joins.withColumnRenamed("a", "at"), "at", "left")
            .select("id", F.coalesce("to", "at").alias("at")).checkpoint()
        )
        for end in ("a", "b"):
            step = joins.select(F.col("a").alias(end), F.col("to").alias("next"))
            edges = edges.join(step, end).drop(end).withColumnRenamed("next", end)
        edges = (
            edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct().checkpoint()
        )
        round_number += 1
    least = owner.groupBy("at").agg(F.min("id").alias("component"))
    return owner.join(least, "at").select("id", "component")
