"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import Scratch

#: Kinds of a missing reference, fixed values.
PARENT, RELATION_SOURCE, RELATION_DESTINATION = "Parent", "RelationSource", "RelationDestination"


def trace_references(transactions: DataFrame, relations: DataFrame) -> DataFrame:
    """Every reference of the two tables as (kind, table_name, source, target, arrived_at).

    NULL and 0 refer to nothing. Parents come from the child's id, relation endpoints from
    rel_seq. Repeated deliveries stay in; consumers count distinct references.
    """

    def part(df, kind, name, source, target):
        return df.filter(F.col(target).isNotNull() & (F.col(target) != 0)).select(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("table_name"),
            F.col(source).cast("bigint").alias("source"),
            F.col(target).cast("bigint").alias("target"),
            "arrived_at",
        )

    return (
        part(transactions, PARENT, "trace_transactions", "id", "parent")
        .unionByName(part(relations, RELATION_SOURCE, "trace_relations", "rel_seq", "source"))
        .unionByName(part(relations, RELATION_DESTINATION, "trace_relations", "rel_seq", "destination"))
    )


def orphan_keys(references: DataFrame, existing: list[DataFrame], discarded: DataFrame) -> DataFrame:
    """Distinct targets of `references` that no table of `existing` holds, or that are discarded.

    One left anti-join of the distinct foreign keys against the keys that are present and not
    discarded. The foreign keys are made distinct first, with partial aggregation before the
    shuffle, so a target named by a third of all rows is one row per task. Existing keys need no
    distinct: an anti-join only asks whether there is one. `existing` and `discarded` are
    one-column DataFrames; NULL keys match nothing. Without existing tables all targets are orphans.
    """
    wanted = references.select(F.col("target").alias("key")).distinct()
    gone = discarded.select(F.col(discarded.columns[0]).cast("bigint").alias("key")).filter("key is not null").distinct()
    alive = None
    for df in existing:
        k = df.select(F.col(df.columns[0]).cast("bigint").alias("key")).filter("key is not null")
        alive = k if alive is None else alive.unionByName(k)
    if alive is None:
        return wanted
    return wanted.join(alive.join(gone, "key", "left_anti"), "key", "left_anti")


def orphan_references(references: DataFrame, existing: list[DataFrame], discarded: DataFrame) -> DataFrame:
    """The references whose target is an orphan key, one row per (kind, source, target), with the
    first arrival of the reference.

    The orphan keys are written first: the size of that table is then known, so the join back
    broadcasts them below spark.sql.autoBroadcastJoinThreshold and the references need no
    shuffle; above it the join sorts, and AQE splits a target that is hot. Rows combine before
    the last shuffle."""
    scratch = Scratch(references.sparkSession, "orphans")
    keys = scratch.write(orphan_keys(references, existing, discarded).withColumnRenamed("key", "target"))
    return (
        references.join(keys, "target")
        .groupBy("kind", "table_name", "source", "target")
        .agg(F.min("arrived_at").alias("arrived_at"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per kind, table and day of arrival: orphan references and distinct orphan targets."""
    per_target = orphans.groupBy("kind", "table_name", F.to_date("arrived_at").alias("day"), "target").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_target.groupBy("kind", "table_name", "day").agg(
        F.sum("n").alias("orphan_references"), F.count(F.lit(1)).alias("orphan_targets")
    )


def trace_orphans(transactions, stages, relations, discarded) -> DataFrame:
    """Orphan references of the trace tables: a target exists if it is an id or a stage_id that is
    not discarded, whenever it arrives. References held by discarded records count too."""
    return orphan_references(
        trace_references(transactions, relations),
        [transactions.select("id"), stages.select("stage_id")],
        discarded.select("record_id"),
    )


def canonical_kind(column: str = "kind") -> F.Column:
    """The MissingReference kind behind the spellings of old reports; NULL for unknown ones."""
    s = F.regexp_replace(F.lower(F.trim(F.col(column))), "[^a-z]", "")
    return (
        F.when(s.isin("parent", "missingparent"), PARENT)
        .when(s == "relationsource", RELATION_SOURCE)
        .when(s.isin("relationdestination", "relationdest"), RELATION_DESTINATION)
        .when(s == "childblock", "ChildBlock")
        .when(s == "clockgenerator", "ClockGenerator")
    )


def report_drift(orphans: DataFrame, report: DataFrame) -> DataFrame:
    """An old report against the orphans found now, per kind: confirmed, resolved since, unreported and
    unchecked references; the last are those of kinds that `orphans` doesn't look for. A report names endpoints by target only (its source is 0), so the
    comparison is by (kind, source of parents, target); rows of unknown kind have kind ''."""
    key = lambda df, kind: df.select(
        F.coalesce(kind, F.lit("")).alias("kind"),
        F.when(kind == PARENT, F.col("source")).otherwise(0).alias("source"),
        F.coalesce(F.col("target"), F.lit(0)).alias("target"),
    ).distinct()
    checked = F.col("kind").isin(PARENT, RELATION_SOURCE, RELATION_DESTINATION)
    now = key(orphans, F.col("kind")).withColumn("now", F.lit(1))
    old = key(report, canonical_kind()).withColumn("old", F.lit(1))
    return (
        now.join(old, ["kind", "source", "target"], "full_outer")
        .groupBy("kind")
        .agg(
            F.count_if(F.col("now").isNotNull() & F.col("old").isNotNull()).alias("confirmed"),
            F.count_if(F.col("now").isNull() & checked).alias("resolved"),
            F.count_if(F.col("old").isNull()).alias("unreported"),
            F.count_if(F.col("now").isNull() & ~checked).alias("unchecked"),
        )
    )
