"""The design hierarchy: paths, lookup, subtree predicates and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import Scratch


def closed(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, parent_id, node_kind, name) with path_parts, ancestors (the root first,
    itself last), depth and path (parts joined by dots). Nodes on or under cycles are left out.

    Paths double each round, so that a tree of depth d takes log2(d) joins by node; when a round
    completes no path, what is left is on or under cycles. A node whose parent has no row is a root.
    Repeated rows count once; a NULL name counts as ''.
    """
    scratch = Scratch(nodes.sparkSession, "closed")
    one = scratch.write(nodes.filter("node_id is not null").groupBy(F.col("node_id").cast("bigint").alias("node_id")).agg(
        F.min("parent_id").cast("bigint").alias("parent_id"), F.min("node_kind").alias("node_kind"), F.min("name").alias("name")))
    known = one.select(F.col("node_id").alias("_p"))
    begun = one.join(known, F.col("parent_id") == F.col("_p"), "left").select(
        "node_id", F.col("_p").alias("jump"), F.array("node_id").alias("ancestors"), F.array(F.coalesce("name", F.lit(""))).alias("path_parts"))
    state, left = scratch.write(begun), None
    while True:
        open_ = state.filter("jump is not null")
        n = open_.count()
        if not n or n == left:
            break
        left = n
        a, b = open_.alias("a"), state.alias("b")
        longer = a.join(b, F.col("a.jump") == F.col("b.node_id")).select(
            "a.node_id", "b.jump", *(F.concat(f"b.{c}", f"a.{c}").alias(c) for c in ("ancestors", "path_parts")))
        moved = scratch.write(longer.unionByName(state.filter("jump is null")))
        scratch.drop(state)
        state = moved
    done = state.filter("jump is null").drop("jump")
    return one.join(done, "node_id").select(
        "node_id", "parent_id", "node_kind", "name", (F.size("ancestors") - 1).cast("bigint").alias("depth"), "ancestors", "path_parts", F.array_join("path_parts", ".").alias("path")
    )


def find_path(nodes: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """`find` without the paths of all nodes: one filtered join per part of the path, from the
    root down, so that only nodes of the wanted names are read."""
    parts = path.split(".")
    named = lambda i: nodes.filter(F.coalesce("name", F.lit("")) == parts[i])
    at = named(0).join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    for i in range(1, len(parts)):
        above = at.filter("node_kind = 'scope'").select(F.col("node_id").alias("parent_id")).distinct()
        at = named(i).join(above, "parent_id", "left_semi")
    if kind is not None:
        at = at.filter(F.col("node_kind") == kind)
    found = at.agg(F.min("node_id").cast("bigint").alias("node_id")).filter("node_id is not null")
    return found.select("node_id", F.lit(path).alias("path"))


def find(closed_nodes: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """The first node (smallest id) whose names, split at dots, are those of `path`; all but the
    last must be scopes, which parents always are. A name that itself has dots is never found."""
    hit = closed_nodes.filter(F.col("path_parts") == F.array(*(F.lit(p) for p in path.split("."))))
    if kind is not None:
        hit = hit.filter(F.col("node_kind") == kind)
    return hit.groupBy("path").agg(F.min("node_id").alias("node_id")).select("node_id", "path")


def within_scope(closed_nodes: DataFrame, scope: int | None) -> DataFrame:
    """Nodes in the subtree of `scope`, itself included; None is everything."""
    return closed_nodes if scope is None else closed_nodes.filter(F.array_contains("ancestors", F.lit(scope).cast("bigint")))


def children(nodes: DataFrame, parent: int | None) -> DataFrame:
    """Child nodes in order of declaration (by id); None lists the roots."""
    hit = nodes.filter(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    return hit.orderBy("node_id")


def listing(closed_nodes: DataFrame, depth: int | None = None, variables: bool = True) -> DataFrame:
    """Nodes less than `depth` levels deep in preorder, with or without variables."""
    out = closed_nodes
    if depth is not None:
        out = out.filter(F.col("depth") < depth)
    if not variables:
        out = out.filter("node_kind <> 'variable'")
    return out.orderBy("ancestors")


def scope_sizes(closed_nodes: DataFrame, variables: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Per scope of its subtree, itself included: scopes, variables and distinct signals.

    `variables` is (scope, signal_id); aliases of a signal count once per scope. With `subset`
    (signal_id) only those signals count. Rows go to each of their ancestors and combine
    before the shuffle; signals are made distinct per (ancestor, signal) in a first step, so
    no task gathers all signals of the top scope.
    """
    up = closed_nodes.filter("node_kind = 'scope'").select(F.col("node_id").alias("scope"), "ancestors")
    scopes = up.select(F.explode("ancestors").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("scopes"))
    if subset is not None:
        variables = variables.join(subset.select("signal_id").distinct(), "signal_id", "left_semi")
    # variables of one signal in one scope travel up together
    own = variables.groupBy("scope", "signal_id").agg(F.count(F.lit(1)).alias("n"))
    climbed = own.join(up, "scope").select(F.explode("ancestors").alias("node_id"), "signal_id", "n")
    per = climbed.groupBy("node_id", "signal_id").agg(F.sum("n").alias("n"))
    counted = per.groupBy("node_id").agg(F.sum("n").alias("variables"), F.count(F.col("signal_id")).alias("signals"))
    return scopes.join(counted, "node_id", "left").select(
        "node_id", "scopes", F.coalesce("variables", F.lit(0)).alias("variables"), F.coalesce("signals", F.lit(0)).alias("signals")
    )


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_kind").agg(F.count(F.lit(1)).alias("nodes"))


def resolve_refs(values: DataFrame) -> DataFrame:
    """Interned values (id, ref, value) with refs followed to the value that is none: (id, target,
    value). Refs lead to smaller ids, so they end; each round follows all known steps at once."""
    from tickloom.operators.hierarchy import hierarchy as ranked

    placed = ranked(values, "id", "ref").placed().select(F.col("node").alias("id"), F.col("root").alias("target"))
    return placed.join(values.select(F.col("id").alias("target"), "value"), "target").select("id", "target", "value")
