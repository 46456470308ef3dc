"""Checks of a recording; each gives the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.references import orphan_keys


def dangling(refs: DataFrame, column: str, existing: list[DataFrame]) -> DataFrame:
    """(target, n): references (NULL and 0 refer to nothing) to ids that no table has."""
    wanted = refs.filter(F.col(column).isNotNull() & (F.col(column) != 0)).select(F.col(column).cast("bigint").alias("target"))
    none = existing[0].limit(0)
    gone = orphan_keys(wanted, existing, none).withColumnRenamed("key", "target")
    # counted before the join, so a target named by most rows is one row per task
    return wanted.groupBy("target").agg(F.count(F.lit(1)).alias("n")).join(gone, "target", "left_semi")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that more than one row has, NULL left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def parent_order(tx: DataFrame) -> DataFrame:
    """(id, parent) of children that aren't younger than their parent."""
    suspect = tx.filter("parent >= id").select("id", "parent")
    return suspect.join(tx.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")


def transaction_shape(tx: DataFrame) -> DataFrame:
    """(rule, id) of transactions that break a rule on their own. Where a table has a `kind`, clock
    stretches have no parent, no span kind, no child blocks and are unset or open."""
    rules = [
        ("id", F.col("id").isNull() | (F.col("id") <= 0)),
        ("end before begin", F.col("end") < F.col("begin")),
        ("missing tick", F.col("begin").isNull() | F.col("end").isNull()),
        ("status", ~F.col("status").between(0, 4)),
        ("span kind", ~F.col("span_kind").between(0, 5)),
    ]
    if "kind" in tx.columns:
        clock = F.col("kind") == "clock"
        odd = F.col("parent").isNotNull() | (F.coalesce("span_kind", F.lit(0)) != 0) | ~F.coalesce("status", F.lit(0)).isin(0, 4)
        rules.append(("clock", clock & (odd | (F.size("child_blocks") > 0) if "child_blocks" in tx.columns else clock & odd)))
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))
    return tx.select(F.explode(broken).alias("rule"), "id")


def embedded_order(embedded: DataFrame) -> DataFrame:
    """(id, owner) of embedded records that aren't younger than their owner."""
    return embedded.filter("id <= owner").select("id", "owner")


def clock_targets(generators: DataFrame) -> DataFrame:
    """(generator, clock, fault): clocks that don't exist or are no CLOCK."""
    c = generators.select(F.col("generator").alias("clock"), F.col("gen_kind").alias("k"), F.lit(True).alias("there"))
    joined = generators.filter("clock is not null").select("generator", "clock").join(c, "clock", "left")
    bad = F.col("there").isNull() | ~F.col("k").eqNullSafe("CLOCK")
    return joined.filter(bad).select("generator", "clock", F.when(F.col("there").isNull(), "missing").otherwise("not a clock").alias("fault"))


def label_types(attributes: DataFrame) -> DataFrame:
    """Attributes (id, key, type) named vtr.label that are neither text nor interned text."""
    return attributes.filter((F.col("key") == "vtr.label") & ~F.coalesce(F.col("type").isin("str", "text"), F.lit(False)))


def field_clashes(attributes: DataFrame, fields: DataFrame) -> DataFrame:
    """Attributes (id, generator, key) named like a field (generator, field) of their payload."""
    f = fields.select("generator", F.col("field").alias("key")).distinct()
    return attributes.join(f, ["generator", "key"], "left_semi")


def frame_faults(frames: DataFrame, held: DataFrame) -> DataFrame:
    """Stored frames (signal_id, start_time, value) that differ from the value held then."""
    h = held.select("signal_id", "start_time", F.col("value").alias("held"))
    return frames.join(h, ["signal_id", "start_time"]).filter(~F.col("value").eqNullSafe(F.col("held")))


def alphabet_faults(changes: DataFrame, signals: DataFrame) -> DataFrame:
    """Changes (signal_id, text) whose width or states their signal (signal_id, width, states)
    doesn't have."""
    s = signals.select("signal_id", "width", "states")
    bad = (F.length("text") != F.col("width")) | F.col("text").rlike("[^01xzuwlh-]") | ((F.col("states") == 2) & F.col("text").rlike("[^01]")) | (
        (F.col("states") == 4) & F.col("text").rlike("[^01xz]"))
    return changes.join(s, "signal_id").filter(bad)


def parent_kinds(tx: DataFrame, located: DataFrame) -> DataFrame:
    """(id, parent) of records whose parent is there but owns nothing, as only ordinary transactions do."""
    if "kind" not in tx.columns:
        return tx.select("id", "parent").limit(0)
    others = tx.filter("kind <> 'transaction'").select(F.col("id").alias("parent")).unionByName(located.select(F.col("id").alias("parent")))
    children = tx.select("id", "parent").unionByName(located.select("id", "parent")).filter("parent is not null")
    return children.join(others.distinct(), "parent", "left_semi").select("id", "parent")


def block_lists(tx: DataFrame, located: DataFrame) -> DataFrame:
    """(owner, block, side): `transactions.missing_blocks` of the child blocks that transactions list."""
    from tickloom.operators.transactions import missing_blocks

    listed = tx.select(F.col("id").alias("owner"), F.explode("child_blocks").alias("block"))
    children = tx.select(F.col("parent").alias("owner"), "block").unionByName(located.filter("kind <> 'log'").select(F.col("parent").alias("owner"), "block"))
    own = children.join(tx.select(F.col("id").alias("owner")), "owner", "left_semi")
    return missing_blocks(listed, own)


def payload_labels(datatypes: DataFrame) -> DataFrame:
    """(datatype_id, name) of structures whose field vtr.label is neither interned nor plain text
    (types 12 and 13)."""
    label = F.filter("fields", lambda f: f["name"] == "vtr.label")
    return datatypes.filter(F.exists(label, lambda f: ~f["type"].isin(12, 13))).select("datatype_id", "name")


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, id) of what breaks a rule in a recording's tables (those of `api.Trace`; rules on
    columns or tables that aren't there say nothing)."""
    from tickloom.operators import clocks

    tx, embedded, located = (tables[t] for t in ("transactions", "embedded", "located"))
    rows = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("bigint").alias("id"))
    every = tx.select("id").unionByName(embedded.select("id")).unionByName(located.select("id"))
    parts = [
        rows("repeated id", duplicates(every, "id"), "id"), rows("parent order", parent_order(tx), "id"), rows("parent kind", parent_kinds(tx, located), "id"),
        rows("embedded order", embedded_order(embedded), "id"), transaction_shape(tx).select("rule", "id"),
        rows("embedded end", embedded.filter("end < begin"), "id"),
    ]
    if {"id", "period"} <= set(tables["clocks"].columns):
        parts += [rows("clock period", clocks.period_faults(tables["clocks"]), "id"), rows("clock overlap", clocks.overlaps(tables["clocks"]), "id")]
    if "child_blocks" in tx.columns and "block" in located.columns:
        parts.append(rows("child blocks", block_lists(tx, located), "owner"))
    if "attributes" in tx.columns:
        listed = tx.select("id", "generator", F.explode("attributes").alias("a")).select("id", "generator", "a.key", F.col("a.tag").alias("type"))
        parts.append(rows("label type", label_types(listed.select("id", "key", "type")), "id"))
        if "payload_type" in tables["nodes"].columns and "fields" in tables["datatypes"].columns:
            own = tables["nodes"].select(F.col("node_id").alias("generator"), F.col("payload_type").alias("datatype_id"))
            fields = own.join(tables["datatypes"].select("datatype_id", F.explode("fields").alias("f")), "datatype_id").select("generator", F.col("f.name").alias("field"))
            parts += [rows("attribute named as a field", field_clashes(listed, fields), "id"), rows("label field", payload_labels(tables["datatypes"]), "datatype_id")]
    if {"signal_id", "width", "states", "encoding"} <= set(tables["signals"].columns):
        bits = tables["signals"].filter("encoding = 'bits'").dropDuplicates(["signal_id"])
        parts.append(rows("alphabet", alphabet_faults(tables["changes"].select("signal_id", "text"), bits), "signal_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(tx: DataFrame, embedded: DataFrame, relations: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """(what, n): records, relations, missing references by kind, and repeated ids. All record kinds
    (`tx` with clock stretches) may be the end of a relation; parents are transactions."""
    known = tx.select("id").unionByName(embedded.select("id"))
    parents = tx.select("parent")
    if located is not None:
        known, parents = known.unionByName(located.select("id")), parents.unionByName(located.select("parent"))

    def one(df, name, value=F.count(F.lit(1))):
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("what"), "n")

    parts = [
        one(known, "records"), one(relations, "relations"), one(dangling(parents, "parent", [tx.select("id")]), "missing parents", F.sum("n")),
        one(dangling(relations.select("source"), "source", [known]), "missing sources", F.sum("n")),
        one(dangling(relations.select("destination"), "destination", [known]), "missing destinations", F.sum("n")),
        one(duplicates(known, "id"), "repeated ids"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_as_errors(counted: DataFrame, complete: bool) -> None:
    """A complete recording must resolve every reference; otherwise they are only reported."""
    if complete and counted.filter("what like 'missing%' and n > 0").limit(1).count():
        raise ValueError("a complete recording has unresolved references")
