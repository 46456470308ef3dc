"""Filling fixed-capacity containers by vector bin packing.

Items have three demands: tokens, segments (one each) and loss-bearing tokens. A container takes
the item whose demands have the largest dot product with its room left, weighted by how scarce
each resource is, until none fits (the bin-centric dot-product heuristic).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import Scratch

#: Items that are packed together by one task.
GROUP = 4096
#: Tokens of a container per segment that it may hold: capacity // this is the segment limit.
TOKENS_PER_SEGMENT = 16
#: Containers filled less than this after the first round are emptied and packed again.
REPACK = 0.97


def pack(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each item; `demands` is (items, resources), none above `limits`.

    Equal items form a class, so a step looks at classes, not items; ties go to the first class.
    """
    n = len(demands)
    container, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return container, place
    classes, of = np.unique(demands, axis=0, return_inverse=True)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of))
    at = np.append(0, ends[:-1])
    share = classes / limits
    scarce = demands.sum(axis=0) / limits
    weighted = share * (scarce / max(scarce.max(), 1e-12))
    left, bin_no, slot, room = n, 0, 0, limits.astype(np.int64).copy()
    alive = np.arange(len(classes))
    while left:
        fits = (classes[alive] <= room).all(axis=1)
        if not fits.any():
            bin_no, slot, room = bin_no + 1, 0, limits.astype(np.int64).copy()
            continue
        score = np.where(fits, weighted[alive] @ (room / limits), -1.0)
        c = alive[int(score.argmax())]
        item = order[at[c]]
        container[item], place[item] = bin_no, slot
        room = room - classes[c]
        at[c] += 1
        slot, left = slot + 1, left - 1
        if at[c] == ends[c]:
            alive = alive[alive != c]
    return container, place


_PACKED = "container string, container_id string, place long, doc_id long, piece long, token_from long, tokens long, loss_tokens long, capacity long"


def _pack_groups(items: DataFrame, round_no: int, groups: int) -> DataFrame:
    """Items (container, capacity, limits, grp, ...) packed per container size and group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        limits = pdf.loc[0, ["capacity", "segments", "loss_limit"]].to_numpy(np.int64)
        demands = np.column_stack([pdf["tokens"], np.ones(len(pdf), np.int64), pdf["loss_tokens"]]).astype(np.int64)
        bins, places = pack(demands, limits)
        grp = int(pdf["grp"].iloc[0])
        return pdf.assign(container_id=[f"{round_no}-{grp}-{b}" for b in bins.tolist()], place=places)[["container", "container_id", "place", "doc_id", "piece", "token_from", "tokens", "loss_tokens", "capacity"]]

    # a number of partitions of its own: packing is bound by CPU, and its few bytes would be coalesced into few tasks
    tasks = min(groups, 16 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return items.repartition(tasks, "container", "grp").groupBy("container", "grp").applyInPandas(run, _PACKED)


def fill(
    sizes: DataFrame, capacities: DataFrame, loss_share: float = 1.0, group: int = GROUP, tokens_per_segment: int = TOKENS_PER_SEGMENT
) -> DataFrame:
    """Containers of each size of `capacities` (container, capacity_tokens) for documents
    `sizes` (doc_id, tokens, prompt_tokens): (container, container_id, place, doc_id, piece,
    token_from, tokens, loss_tokens).

    A container holds at most its capacity in tokens, capacity // tokens_per_segment segments (1
    at least) and loss_share of its capacity in loss-bearing tokens (those behind the prompt). A document
    is whole unless it alone exceeds a limit; then its pieces are whole containers but the last.
    Documents without tokens (NULL or empty texts) or an id are in no container; repeated documents
    count once. Each size is a separate
    task. Groups of `group` items, by a hash, are packed apart; what lies in containers less
    full than REPACK is then packed again in groups that mix the leftovers of all others.
    Container sizes are a handful (a fixed table); documents spread by hash, so nothing is skewed.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    kinds = [(r["container"], int(r["capacity_tokens"])) for r in capacities.dropDuplicates().collect() if r["capacity_tokens"]]
    if not kinds:
        return spark.createDataFrame([], _PACKED).drop("capacity")
    once = sizes.filter("tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("tokens", "prompt_tokens")).alias("d"))
    docs = scratch.write(once.select("doc_id", "d.tokens", F.coalesce("d.prompt_tokens", F.lit(0)).alias("prompt_tokens")))
    options = F.array(*(
        F.struct(
            F.lit(name).alias("container"), F.lit(cap).cast("bigint").alias("capacity"), F.lit(max(1, cap // tokens_per_segment)).cast("bigint").alias("segments"),
            F.lit(max(1, int(cap * loss_share))).cast("bigint").alias("loss_limit"),
        ) for name, cap in kinds
    ))
    # a piece is as long as no limit is exceeded even if all of it bears loss
    longest = F.least("capacity", "loss_limit")
    each = docs.withColumn("k", F.explode(options)).select("doc_id", "tokens", (F.col("tokens") - F.col("prompt_tokens")).alias("loss"), "k.*")
    split = (F.col("tokens") > F.col("capacity")) | (F.col("loss") > F.col("loss_limit"))
    pieces = each.withColumn("cut", F.when(split, longest).otherwise(F.col("tokens"))).withColumn(
        "token_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.col("cut")))
    )
    prompt = F.col("tokens") - F.col("loss")
    size = F.least(F.col("cut"), F.col("tokens") - F.col("token_from"))
    pieces = pieces.select(
        "container", "capacity", "segments", "loss_limit", "doc_id", F.floor(F.col("token_from") / F.col("cut")).cast("bigint").alias("piece"), "token_from",
        size.alias("tokens"), F.greatest(size - F.greatest(prompt - F.col("token_from"), F.lit(0)), F.lit(0)).alias("loss_tokens"),
    )
    full = pieces.filter("tokens = capacity")
    rest = scratch.write(pieces.filter("tokens < capacity"))
    groups = max(1, -(-rest.count() // (group * len(kinds))))
    keyed = lambda df, n, seed: df.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.lit(n)))
    first = scratch.write(_pack_groups(keyed(rest, groups, 1), 1, groups * len(kinds)))
    out = first
    if groups > 1:
        # the size of a container's group is bounded by its segments
        filled = first.groupBy("container", "container_id").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
        poor = filled.filter(F.col("t") < REPACK * F.col("c")).select("container", "container_id")
        again = scratch.write(first.join(poor, ["container", "container_id"], "left_semi"))
        n = max(1, -(-again.count() // (group * len(kinds))))
        limits = F.element_at(F.filter(options, lambda o: o["container"] == F.col("container")), 1)
        loose = again.select("doc_id", "piece", "token_from", "tokens", "loss_tokens", "container", "capacity", limits["segments"].alias("segments"), limits["loss_limit"].alias("loss_limit"))
        out = first.join(poor, ["container", "container_id"], "left_anti").unionByName(_pack_groups(keyed(loose, n, 2), 2, n * len(kinds)))
    # a piece of a whole container's size is alone in one
    alone = full.select(
        "container", F.concat_ws("-", F.lit("0"), "doc_id", "piece").alias("container_id"), F.lit(0).cast("bigint").alias("place"), "doc_id", "piece", "token_from", "tokens", "loss_tokens"
    )
    return out.select("container", "container_id", "place", "doc_id", "piece", "token_from", "tokens", "loss_tokens").unionByName(alone)
