"""Directed relations between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import Scratch


def touching(relations: DataFrame, endpoints: DataFrame, incoming: bool) -> DataFrame:
    """Relations out of (or into) the given endpoints (id); duplicates stay."""
    side = "destination" if incoming else "source"
    return relations.join(endpoints.select(F.col("id").alias(side)).distinct(), side, "left_semi")


def outside(relations: DataFrame) -> DataFrame:
    """Relations with an endpoint outside the recording (NULL or 0)."""
    return relations.filter("source is null or source = 0 or destination is null or destination = 0")


def scan_counts(relations: DataFrame) -> DataFrame:
    """(kind, source, destination, n): equal edges are separate relations and are counted."""
    return relations.groupBy("kind", "source", "destination").agg(F.count(F.lit(1)).alias("n"))


def reachable(relations: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, hops): records reachable from each start (id) in at most `hops` steps, with
    the fewest; the start itself has 0. Each step keeps records not reached before only, so
    cycles end, and is written so that its size is known to the next join."""
    edges = relations.filter("source <> 0 and destination <> 0").select(F.col("source").alias("at"), F.col("destination").alias("to")).distinct()
    scratch = Scratch(relations.sparkSession, "reachable")
    front = scratch.write(starts.filter("id is not null").select(F.col("id").alias("start"), F.col("id").alias("at")).distinct())
    seen = front.withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        step = front.join(edges, "at").select("start", F.col("to").alias("at")).distinct()
        front = scratch.write(step.join(seen.select("start", "at"), ["start", "at"], "left_anti"))
        seen = seen.unionByName(front.withColumn("hops", F.lit(k)))
    return seen.select("start", F.col("at").alias("id"), "hops")
