"""Parent-child rows as full hierarchies: cycles, depth, root, paths and descendants.

Leaves are peeled to expose the cycles, the rest is toured (Euler tours, one per tree), the
tours are ranked in parallel, and entry and exit positions answer everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import Scratch

#: Buckets into which the children of one parent are split for ordering them.
BUCKETS = 256
#: Rows that one task finishes (some 40 MB) when peeling or ranking has shrunk to them.
SMALL = 400_000


def clean_edges(df: DataFrame, node: str, parent: str, none: tuple = ()) -> DataFrame:
    """One row (node, parent) per non-NULL node; parents in `none` become NULL.

    A node with contradicting rows gets its smallest parent, so it still has one place.
    """
    p = F.col(parent).cast("bigint")
    if none:
        p = F.when(~p.isin(*none), p)
    return (
        df.select(F.col(node).cast("bigint").alias("node"), p.alias("parent"))
        .filter("node is not null")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def _positions(node: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where each `to` stands in `node`; len(node) where it doesn't."""
    order = np.argsort(node)
    at = np.searchsorted(node[order], to)
    at = np.minimum(at, len(node) - 1)
    return np.where(node[order[at]] == to, order[at], len(node))


def _gather(it: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [p for p in it if len(p)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _stay(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (node, jump): the nodes from which jumps never leave."""
    pdf = _gather(it)
    if pdf is not None:
        node = pdf["node"].to_numpy(np.int64)
        to = np.append(_positions(node, pdf["jump"].to_numpy(np.int64)), len(node))
        for _ in range(len(node).bit_length() + 1):
            to = to[to]
        yield pd.DataFrame({"node": node[to[:-1] < len(node)]})


def _cycles(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (node, parent) that are all on or under cycles: (node, cycle, on_cycle)."""
    pdf = _gather(it)
    if pdf is not None:
        node = pdf["node"].to_numpy(np.int64)
        to = _positions(node, pdf["parent"].to_numpy(np.int64))
        low = node.copy()
        for _ in range(len(node).bit_length() + 1):
            low, to = np.minimum(low, low[to]), to[to]
        on = np.zeros(len(node), bool)
        on[to] = True
        yield pd.DataFrame({"node": node, "cycle": low[to], "on_cycle": on})


def _peel(edges: DataFrame, left: int, scratch: Scratch, small: int) -> DataFrame | None:
    """What never peels off: (node, cycle, on_cycle) of all nodes on or under cycles, `cycle`
    being the smallest id on the cycle. None without any.

    After step k, `jump` leads from a node 2^k parents up. A node without such a parent has left:
    it is within 2^k of a root. The nodes still jumped to are those left when 2^k layers of
    leaves have been peeled. So each step peels as many layers as all before it together, a
    chain of a million nodes takes 20 steps, and tables shrink as the layers go. When no node
    leaves, all that remain are on or under cycles; `low`, the smallest id on the way, is
    carried on among those until neither it nor the peeled leaves change: then the jumps end on
    cycles and `low` covers them. What is down to `small` rows is finished by one task.
    """
    jump, stuck = edges.select("node", F.col("parent").alias("jump")), False
    while left > small and not stuck:
        step = jump.alias("a").join(jump.alias("b"), F.col("a.jump") == F.col("b.node"))
        longer, n = scratch.counted(step.select("a.node", F.col("b.jump").alias("jump")))
        scratch.drop(jump)
        jump, stuck, left = longer, n == left, n
    if not left:
        return None
    stay = jump.select("node") if stuck else jump.coalesce(1).mapInPandas(_stay, "node long")
    trapped, n = scratch.counted(edges.join(stay, "node", "left_semi"))
    if not n:
        return None
    if n <= small:
        return scratch.write(trapped.coalesce(1).mapInPandas(_cycles, "node long, cycle long, on_cycle boolean"))
    state = scratch.write(trapped.select("node", F.col("parent").alias("jump"), F.least("node", "parent").alias("low")))
    images = -1
    while True:
        step = state.alias("a").join(state.alias("b"), F.col("a.jump") == F.col("b.node"))
        longer = scratch.write(
            step.select(
                "a.node",
                F.col("b.jump").alias("jump"),
                F.least("a.low", "b.low").alias("low"),
                (F.col("b.low") < F.col("a.low")).alias("changed"),
            )
        )
        targets, n = scratch.counted(longer.select(F.col("jump").alias("node")).distinct())
        changed = longer.filter("changed").join(targets, "node", "left_semi").limit(1).count()
        scratch.drop(state)
        state = longer
        if n == images and not changed:
            break
        images = n
        scratch.drop(targets)
    on_cycle = scratch.write(targets.join(state.select("node", "low"), "node").select("node", F.col("low").alias("cycle")))
    under = state.join(on_cycle.select(F.col("node").alias("jump"), "cycle"), "jump").select("node", "cycle")
    members = under.join(on_cycle.select("node", F.lit(True).alias("on_cycle")), "node", "left")
    return scratch.write(members.withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False))))


def _chains(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within one partition, follow the tour as far as it stays inside.

    In: (node, side, next_node, next_side, steps, rise), next_node NULL (has_next false) at a
    tour's end. Out, per element: the sums from it to the end of its sublist, where the sublist
    goes on, and whether the element begins one.
    """
    parts = [p for p in it if len(p)]
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    n = len(pdf)
    node, side = pdf["node"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64)
    has = pdf["has_next"].to_numpy(bool)
    nxt_node, nxt_side = pdf["next_node"].to_numpy(np.int64), pdf["next_side"].to_numpy(np.int64)
    order = np.lexsort((side, node))
    sorted_node = node[order]
    first = np.searchsorted(sorted_node, nxt_node)
    # the two elements of a node are neighbours in this order, side 0 first
    at = np.minimum(first + nxt_side, n - 1)
    inside = has & (sorted_node[at] == nxt_node) & (side[order][at] == nxt_side)
    to = np.where(inside, order[at], np.arange(n))
    is_head = np.ones(n, bool)
    is_head[to[inside]] = False
    steps, rise = pdf["steps"].to_numpy(np.int64).copy(), pdf["rise"].to_numpy(np.int64).copy()
    # sums over [element, jump), then the last element's own is added
    own_steps, own_rise = steps.copy(), rise.copy()
    steps[~inside], rise[~inside] = 0, 0
    jump = to.copy()
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        steps, rise = steps + steps[jump], rise + rise[jump]
        jump = further
    end = jump
    yield pd.DataFrame(
        {
            "node": node,
            "side": side.astype(np.int32),
            "steps": steps + own_steps[end],
            "rise": rise + own_rise[end],
            "last": node[end],
            "has_next": has[end],
            "next_node": nxt_node[end],
            "next_side": nxt_side[end].astype(np.int32),
            "is_head": is_head,
        }
    )


_CHAINS = "node long, side int, steps long, rise long, last long, has_next boolean, next_node long, next_side int, is_head boolean"


_HEADS = "node long, side int, steps long, rise long, last long"


def _finish_heads(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rank sublists (node, side, steps, rise, last, has_next, next_node, next_side) whose
    successors are all there: sums to the end of the tour, and the node that ends it."""
    pdf = _gather(it)
    if pdf is None:
        return
    node, side = pdf["node"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64)
    n = len(node)
    order = np.lexsort((side, node))
    key = pd.MultiIndex.from_arrays([node[order], side[order]])
    asked = pd.MultiIndex.from_arrays([pdf["next_node"].to_numpy(np.int64), pdf["next_side"].to_numpy(np.int64)])
    at = key.get_indexer(asked)
    to = np.where(pdf["has_next"].to_numpy(bool), order[at], np.arange(n))
    steps, rise = pdf["steps"].to_numpy(np.int64), pdf["rise"].to_numpy(np.int64)
    moving = to != np.arange(n)
    s, r = np.where(moving, steps, 0), np.where(moving, rise, 0)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        s, r, to = s + s[to], r + r[to], further
    yield pd.DataFrame({"node": node, "side": side.astype(np.int32), "steps": s + steps[to], "rise": r + rise[to], "last": pdf["last"].to_numpy(np.int64)[to]})


def _rank(tour: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """(node, side, steps, rise, root): sums from each element to the end of its tour, itself
    included, and the node whose exit ends the tour.

    Parallel list ranking over sublists. Partitions by ranges of ids rank what lies inside them
    (ids are given in order of creation, so relatives are mostly neighbours; nothing but speed
    depends on it); only sublist heads whose tour goes on elsewhere are ranked across
    partitions, by pointer jumping, in as many rounds as the logarithm of the longest chain, or
    by one task where there are no more than `small`.
    """
    parts = int(tour.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = scratch.write(tour.repartitionByRange(parts, "node").mapInPandas(_chains, _CHAINS))
    heads = local.filter("is_head").select("node", "side", "steps", "rise", "last", "has_next", "next_node", "next_side")
    # heads of tours that end in their own partition and that nobody points to need no round
    waiting = heads.filter("has_next").select(F.col("next_node").alias("node"), F.col("next_side").alias("side"))
    state, n = scratch.counted(heads.join(waiting.withColumn("asked", F.lit(True)), ["node", "side"], "left").filter("has_next or asked").drop("asked"))
    if n <= small:
        state = scratch.write(state.coalesce(1).mapInPandas(_finish_heads, _HEADS))
    else:
        while state.filter("has_next").limit(1).count():
            a, b = state.filter("has_next").alias("a"), state.alias("b")
            moved = a.join(b, (F.col("a.next_node") == F.col("b.node")) & (F.col("a.next_side") == F.col("b.side"))).select(
                "a.node",
                "a.side",
                (F.col("a.steps") + F.col("b.steps")).alias("steps"),
                (F.col("a.rise") + F.col("b.rise")).alias("rise"),
                "b.last",
                "b.has_next",
                "b.next_node",
                "b.next_side",
            )
            longer = scratch.write(moved.unionByName(state.filter("not has_next")))
            scratch.drop(state)
            state = longer
    done = state.select(
        F.col("node").alias("next_node"), F.col("side").alias("next_side"), F.col("steps").alias("s"), F.col("rise").alias("r"), F.col("last").alias("root")
    )
    # rows whose sublist ends the tour take no part in the join, so their NULLs can't gather
    ended = local.filter("not has_next").select("node", "side", "steps", "rise", F.col("last").alias("root"))
    going = local.filter("has_next").join(done, ["next_node", "next_side"]).select(
        "node", "side", (F.col("steps") + F.col("s")).alias("steps"), (F.col("rise") + F.col("r")).alias("rise"), "root"
    )
    return ended.unionByName(going)


def _numbered(df: DataFrame, group: str, by: str) -> DataFrame:
    """Adds `place` (0-based place of the row in its group) and `after` (the next `by` of the
    group, NULL at its end), whatever the group's size: rows are ordered within BUCKETS
    hash buckets of their group, and then the buckets (at most BUCKETS rows) among themselves."""
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int"))
    w = Window.partitionBy(group, "bucket").orderBy(by)
    inner = bucketed.withColumn("rn", F.row_number().over(w)).withColumn("lead", F.lead(by).over(w))
    heads = bucketed.groupBy(group, "bucket").agg(F.min(by).alias("head"), F.count(F.lit(1)).alias("n"))
    v = Window.partitionBy(group).orderBy("bucket")
    heads = heads.withColumn("base", F.coalesce(F.sum("n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "next_head", F.lead("head").over(v)
    )
    joined = inner.join(heads.select(group, "bucket", "base", "next_head"), [group, "bucket"])
    return joined.withColumn("place", F.col("base") + F.col("rn") - 1).withColumn("after", F.coalesce("lead", "next_head")).drop(
        "bucket", "rn", "lead", "base", "next_head"
    )


class Forest:
    """Parent-child rows, ranked. `hierarchy` builds it.

    roots: (node) that neither have a parent nor children; inner: (node, root, depth, entry, exit)
    of nodes with children; leaves: (node, parent); cyclic: (node, cycle, on_cycle) or None.
    Positions count up to -1, the exit of the root: a node's descendants are the nodes of its
    root whose entry lies between its entry and exit.
    """

    def __init__(self, spark, nodes, roots, inner, leaves, cyclic, scratch, small):
        self.spark, self.nodes, self.roots, self.inner, self.leaves, self.cyclic, self.scratch, self.small = spark, nodes, roots, inner, leaves, cyclic, scratch, small

    def cut(self) -> Forest:
        """The trees of the nodes on or under cycles, each cycle being cut above its smallest id,
        which is the root."""
        if self.cyclic is None:
            return hierarchy(self.nodes.limit(0), "node", "parent", small=self.small)
        rows = self.cyclic.join(self.nodes, "node").select("node", F.when(F.col("node") != F.col("cycle"), F.col("parent")).alias("parent"))
        return hierarchy(rows, "node", "parent", small=self.small)

    def placed(self) -> DataFrame:
        """(node, parent, root, depth, entry, exit, descendants) of every node of a tree."""
        numbered = _numbered(self.leaves, "parent", "node")
        up = self.inner.select(F.col("node").alias("parent"), "root", F.col("depth").alias("d"), F.col("entry").alias("e"))
        entry = F.col("e") + 1 + 2 * F.col("place")
        leaves = numbered.join(up, "parent").select(
            "node", "parent", "root", (F.col("d") + 1).alias("depth"), entry.alias("entry"), (entry + 1).alias("exit")
        )
        inner = self.inner.select("node", "parent", "root", "depth", "entry", "exit")
        lone = self.roots.select(
            "node", F.lit(None).cast("bigint").alias("parent"), F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"),
            F.lit(-2).cast("bigint").alias("entry"), F.lit(-1).cast("bigint").alias("exit"),
        )
        return inner.unionByName(leaves).unionByName(lone).withColumn("descendants", F.floor((F.col("exit") - F.col("entry")) / 2).cast("bigint"))

    def deep(self, least: int) -> DataFrame:
        """(node, root, depth) of nodes with at least `least` ancestors."""
        up = self.inner.filter(F.col("depth") >= least - 1)
        leaves = self.leaves.join(up.select(F.col("node").alias("parent"), "root", F.col("depth").alias("d")), "parent").select(
            "node", "root", (F.col("d") + 1).alias("depth")
        )
        out = up.filter(F.col("depth") >= least).select("node", "root", "depth").unionByName(leaves)
        return out.unionByName(self.roots.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"))) if least < 1 else out

    def paths(self) -> DataFrame:
        """(node, root, depth, path): the ids from the root to the node, from the intervals.

        Nodes are sorted by (root, entry) over range partitions; in this order a node's
        ancestors are the intervals still open, a stack. The intervals that a partition leaves
        open (at most one path of it) join the first rows of later partitions, which they come before
        as rows of their own, so a tree of any size spreads over partitions and no path
        passes the driver. Broadcast is one row per partition.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = self.scratch.write(
            self.placed().select("node", "root", "depth", "entry", "exit").repartitionByRange(parts, "root", "entry")
            .sortWithinPartitions("root", "entry").withColumn("part", F.spark_partition_id())
        )
        ends = self.scratch.write(ordered.groupBy("part").agg(F.min(F.struct("root", "entry")).alias("f"), F.max(F.struct("root", "entry")).alias("l")))
        last = ends.select("part", F.col("l.root").alias("last_root"), F.col("l.entry").alias("last_entry"))
        first = ends.select(F.col("part").alias("later"), F.col("f.root").alias("root"), F.col("f.entry").alias("first_entry"))
        left_open = ordered.filter("exit > entry + 1").join(F.broadcast(last), "part").filter("root = last_root and exit > last_entry")
        carried = left_open.join(F.broadcast(first), "root").filter("later > part and first_entry < exit")
        columns = ["node", "root", "depth", "entry", "exit"]
        rows = ordered.select(*columns, "part", F.lit(True).alias("own")).unionByName(carried.select(*columns, F.col("later").alias("part"), F.lit(False).alias("own")))

        def sweep(it):
            stack, now = [], None
            for pdf in it:
                out = []
                for node, root, entry, exit_, part in zip(*(pdf[c].tolist() for c in ("node", "root", "entry", "exit", "part")), strict=True):
                    if (part, root) != now:
                        stack, now = [], (part, root)
                    while stack and stack[-1][1] < entry:
                        stack.pop()
                    out.append([*(a for a, _ in stack), node])
                    if exit_ > entry + 1:
                        stack.append((node, exit_))
                found = pd.DataFrame({"node": pdf["node"], "root": pdf["root"], "depth": pdf["depth"], "path": out})
                yield found[pdf["own"]]

        # files hold one sorted range each; reading must neither split nor join them
        one_each = rows.repartition(parts, "part").sortWithinPartitions("part", "root", "entry")
        return one_each.mapInPandas(sweep, "node long, root long, depth long, path array<long>")

    def intervals(self) -> DataFrame:
        """(node, root, entry, exit, descendants): the descendants of a node are the nodes of its root
        whose entry lies between its entry and its exit; `closure` lists them one by one."""
        return self.placed().select("node", "root", "entry", "exit", "descendants")

    def closure(self) -> DataFrame:
        """(ancestor, node, distance) for every node and each of its ancestors."""
        p = self.paths().select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
        return p.filter("ancestor <> node").select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def hierarchy(df: DataFrame, node: str, parent: str, none: tuple = (), small: int | None = None) -> Forest:
    """Rank the trees of parent-child rows.

    NULL nodes are dropped; NULL parents, those in `none` and those without a row end the path,
    their nodes are roots. A node that is its own parent is a cycle of one. Repeated rows count
    once. Nodes on or under cycles are in `cyclic`, their trees in `cut()`. An empty table gives an
    empty forest.
    """
    spark, small = df.sparkSession, SMALL if small is None else small
    scratch = Scratch(spark, "forest")
    nodes = scratch.write(clean_edges(df, node, parent, none))
    edges, n = scratch.counted(
        nodes.filter("parent is not null").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    )
    cyclic = _peel(edges, n, scratch, small)
    forest = edges if cyclic is None else edges.join(cyclic.select("node"), "node", "left_anti")
    has_children = forest.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    flagged = scratch.write(forest.join(has_children, "node", "full_outer").select("node", "parent", F.coalesce("inner", F.lit(False)).alias("inner")))
    leaves = flagged.filter("not inner").select("node", "parent")
    inner_children = flagged.filter("inner and parent is not null").select("node", "parent")
    counts = flagged.filter("parent is not null").groupBy("parent").agg(
        F.count_if(~F.col("inner")).alias("leaves"), F.min(F.when(F.col("inner"), F.struct(F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int"), F.col("node").alias("node")))).alias("f")
    )
    counts = counts.select(F.col("parent").alias("node"), "leaves", F.col("f.node").alias("first"))
    # the tour visits the leaf children of a node first, then the others in the order of _numbered
    inner = (
        flagged.filter("inner").select("node", "parent")
        .join(_numbered(inner_children, "parent", "node").select("node", "after"), "node", "left")
        .join(counts, "node")
    )
    inner = scratch.write(inner)
    down = inner.select(
        "node", F.lit(0).alias("side"), F.coalesce("first", "node").alias("next_node"), F.when(F.col("first").isNull(), 1).otherwise(0).alias("next_side"),
        F.lit(True).alias("has_next"), (1 + 2 * F.col("leaves")).alias("steps"), F.lit(1).cast("bigint").alias("rise"),
    )
    up_to = F.coalesce("after", "parent")
    up = inner.select(
        "node", F.lit(1).alias("side"), F.coalesce(up_to, F.lit(0)).alias("next_node"), F.when(F.col("after").isNull(), 1).otherwise(0).alias("next_side"),
        up_to.isNotNull().alias("has_next"), F.lit(1).cast("bigint").alias("steps"), F.lit(-1).cast("bigint").alias("rise"),
    )
    ranked = _rank(down.unionByName(up), scratch, small)
    # a suffix that opens with the node's entry closes the node and its open ancestors: its sum is -depth
    both = ranked.groupBy("node").agg(
        F.max("root").alias("root"),
        F.max(F.when(F.col("side") == 0, -F.col("rise"))).alias("depth"),
        F.max(F.when(F.col("side") == 0, -F.col("steps"))).alias("entry"),
        F.max(F.when(F.col("side") == 1, -F.col("steps"))).alias("exit"),
    )
    placed = scratch.write(both.join(inner.select("node", "parent"), "node"))
    rest = nodes.select("node").join(flagged.select("node"), "node", "left_anti")
    lone = rest if cyclic is None else rest.join(cyclic.select("node"), "node", "left_anti")
    return Forest(spark, nodes, lone, placed, leaves, cyclic, scratch, small)


def found(forest: Forest, tree: str, least: int = 16) -> DataFrame:
    """Deep nodes and nodes whose parents never end, as TESTDATA.md names them."""
    deep = forest.deep(least).select(F.lit(tree).alias("tree"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")
    if forest.cyclic is None:
        return deep
    caught = forest.cyclic.select(
        F.lit(tree).alias("tree"), F.col("node").alias("node_id"), F.col("cycle").alias("root_id"), F.lit(-1).cast("bigint").alias("depth")
    )
    return deep.unionByName(caught)
