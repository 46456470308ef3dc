"""Transactions, embedded detail and located records: windows, ownership and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bits import effective_end
from tickloom.operators.waveform import check_window


def in_window(first: int, last: int, begin: str = "begin", end: str = "end") -> Column:
    """Transactions: both ends of record and window count. Rows without ticks are out."""
    check_window(first, last)
    return (F.col(begin) <= last) & (F.col(end) >= first)


def in_window_half_open(first: int | None, last: int | None, begin: str = "begin", end: str = "end") -> Column:
    """Located records: a stage with a positive length ends before its end tick; points and empty
    stages are at their begin. None leaves that side open; rows without ticks are out."""
    check_window(first, last)
    out = F.col(begin).isNotNull()
    if last is not None:
        out = out & (F.col(begin) <= last)
    if first is not None:
        out = out & F.coalesce(F.when(F.col(end) > F.col(begin), F.col(end) > first).otherwise(F.col(begin) >= first), F.lit(False))
    return out


def query_transactions(
    tx: DataFrame, first: int | None = None, last: int | None = None, generator: int | None = None, parent: int | None = None, id: int | None = None,
    embedded: DataFrame | None = None, embedded_id: int | None = None,
) -> DataFrame:
    """Transactions that pass every given predicate; parent 0 selects those without one."""
    out = tx
    if first is not None or last is not None:
        check_window(first, last)
        if last is not None:
            out = out.filter(F.col("begin") <= last)
        if first is not None:
            out = out.filter(F.col("end") >= first)
    if generator is not None:
        out = out.filter(F.col("generator") == generator)
    if parent is not None:
        out = out.filter(F.col("parent").isNull() if parent == 0 else F.col("parent") == parent)
    if id is not None:
        out = out.filter(F.col("id") == id)
    if embedded_id is not None:
        owner = embedded.filter(F.col("id") == embedded_id).select(F.col("owner").alias("id"))
        out = out.join(owner, "id", "left_semi")
    return out


def query_located(
    located: DataFrame, first: int | None = None, last: int | None = None, kind: str | None = None, generator: int | None = None, parent: int | None = None,
    datatype: int | None = None, include_logs: bool = True,
) -> DataFrame:
    """Located records that pass every given predicate; parent 0 selects those without one."""
    out = located
    if first is not None or last is not None:
        out = out.filter(in_window_half_open(first, last))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if not include_logs:
        out = out.filter(F.col("kind") != "log")
    if generator is not None:
        out = out.filter(F.col("generator") == generator)
    if parent is not None:
        out = out.filter(F.col("parent").isNull() if parent == 0 else F.col("parent") == parent)
    if datatype is not None:
        out = out.filter(F.col("datatype_id") == datatype)
    return out


def records_all(tx: DataFrame, embedded: DataFrame, located: DataFrame, clocks: DataFrame) -> DataFrame:
    """One relation of all record kinds: (id, kind, generator, parent, begin, end, status, span_kind, name, lane,
    explicit_end). An embedded record has its owner as parent and its owner's generator; an open stage its effective
    end, and no explicit one. What a kind or table doesn't have is NULL."""
    plain = ["id", "kind", "generator", "parent", "begin", "end"]
    more = {"status": "int", "span_kind": "int", "name": "string", "lane": "string"}

    def every(df: DataFrame, *own: str, explicit=True) -> DataFrame:
        rest = [F.col(c).cast(k).alias(c) if c in own and c in df.columns else F.lit(None).cast(k).alias(c) for c, k in more.items()]
        return df.select(*plain, *rest, (F.col("end") if explicit is True else explicit).alias("explicit_end"))

    t = every(tx.withColumn("kind", F.lit("transaction")), "status", "span_kind")
    o = tx.select(F.col("id").alias("owner"), "generator", F.col("end").alias("owner_end"))
    kind = F.when(F.col("kind") == "event", "embedded_event").otherwise("embedded_stage") if "kind" in embedded.columns else F.lit("embedded_stage")
    inner = embedded.join(o, "owner", "left").select(
        "id", kind.alias("kind"), "generator", F.col("owner").alias("parent"), "begin", effective_end("begin", "end", "owner_end").alias("end"), F.col("end").alias("given"), "name", "lane"
    )
    e = every(inner, "name", "lane", explicit=F.col("given"))
    c = every(clocks.select("id", F.lit("clock").alias("kind"), F.col("clock").alias("generator"), F.lit(None).cast("bigint").alias("parent"), "begin", "end"))
    return t.unionByName(e).unionByName(every(located)).unionByName(c)


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of given ids (id); ids are few or many, Spark picks the join by their size."""
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def children_of(tx: DataFrame, parents: DataFrame) -> DataFrame:
    """Ordinary transactions whose parent is among `parents` (id), as (parent, id, ...)."""
    return tx.join(parents.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")


def expand(owners: DataFrame, located: DataFrame) -> DataFrame:
    """(owner, kind, id, begin, end): located events and stages of owners (id), logs left out."""
    parts = located.filter("kind <> 'log'").select(F.col("parent").alias("owner"), "kind", "id", "begin", "end")
    return parts.join(owners.select(F.col("id").alias("owner")).distinct(), "owner", "left_semi")


def missing_blocks(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """(owner, block, side): child blocks that owners list but that hold none of their children
    ('listed'), and blocks that hold children but aren't listed ('actual')."""
    a, b = listed.select("owner", "block").distinct(), actual.select("owner", "block").distinct()
    return a.join(b, ["owner", "block"], "left_anti").withColumn("side", F.lit("listed")).unionByName(
        b.join(a, ["owner", "block"], "left_anti").withColumn("side", F.lit("actual"))
    )


def outside_owner(parts: DataFrame, owners: DataFrame) -> DataFrame:
    """Parts (id, owner, begin, end) not wholly within their owner's interval: ownership doesn't
    imply it, so nothing may be pruned by it."""
    o = owners.select(F.col("id").alias("owner"), F.col("begin").alias("owner_begin"), F.col("end").alias("owner_end"))
    return parts.join(o, "owner").filter((F.col("begin") < F.col("owner_begin")) | (F.col("end") > F.col("owner_end")))


def lane_autoclose(stages: DataFrame) -> DataFrame:
    """Stages (owner, lane, begin, seq, end, ...) with `closed`: their end, or of open ones the
    begin of the next stage on the lane, NULL for a lane's last open stage."""
    from tickloom.operators.ordered import neighbours

    out = neighbours(stages, ["owner", "lane"], "begin", ["seq"], ["begin"])
    return out.withColumn("closed", F.coalesce("end", F.col("next.begin"))).drop("prev", "next")


def oldest(members: DataFrame, group: str, n: int) -> DataFrame:
    """The n members with the smallest ids of each group. Candidates are cut to n within hash
    buckets of a group before they meet, so a hot group is no single task."""
    from pyspark.sql import Window

    salted = members.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = Window.partitionBy(group, "_b").orderBy("id")
    v = Window.partitionBy(group).orderBy("id")
    near = salted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(v)).filter(F.col("_r") <= n).drop("_r", "_b")


def younger(members: DataFrame, group: str, key_id: DataFrame) -> DataFrame:
    """Members of a group younger than its key item: with an id above key_id (group, id)."""
    k = key_id.groupBy(group).agg(F.max("id").alias("_key"))
    return members.join(k, group).filter(F.col("id") > F.col("_key")).drop("_key")
