"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.sentences import CODES
from tickloom.session import Scratch

# The domain (family of scripts) of a language, the upper level of the tree.
DOMAINS = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin", "ru": "cyrillic", "el": "greek", "ar": "arabic", "ur": "arabic",
           "hi": "indic", "th": "thai", "zh": "east asian", "ja": "east asian"}
#: Documents per hash bucket of a source that order them, about.
BUCKET = 2048
#: Documents outside a source's prefix that may be added to come nearer to its budget.
FITTED = 4
#: Most rows of the table of targets, which pass the driver and are broadcast; more are an error.
SOURCES_BOUND = 100_000


def budgets(leaves: list[dict], total: float | None = None) -> dict[str, float]:
    """Tokens for each source. A leaf is {source, domain, language, share, supply}: `supply` is
    the most it can give.

    Weights go down the tree domain - language - source. What a source can't give goes to its
    siblings in proportion to their weights, what a language can't give to the other languages
    of its domain, and what a domain can't give to the other domains. Without `total` the
    mixture is the largest in which every source that has anything meets its share.
    """
    live = [x for x in leaves if x["supply"] > 0 and x["share"] > 0]
    if not live:
        return {x["source"]: 0.0 for x in leaves}
    weight = sum(x["share"] for x in live)
    # the shares of sources without anything are what their siblings, then ancestors, take over
    def tree(nodes):
        out: dict = defaultdict(lambda: defaultdict(list))
        for x in nodes:
            out[x["domain"]][x["language"]].append(x)
        return out

    domains = tree(leaves)
    supply = lambda node: node["supply"] if "supply" in node else sum(supply(y) for y in node["below"])
    share = lambda node: node["share"] if "share" in node else sum(share(y) for y in node["below"])
    root = {"below": [{"below": [{"below": xs} for xs in langs.values()]} for langs in domains.values()]}

    def pour(node, amount, out):
        """Spread `amount` (at most the node's supply) over the children by weight, up to what each holds."""
        if "source" in node:
            out[node["source"]] = amount
            return
        left, open_, given = amount, [c for c in node["below"]], {id(c): 0.0 for c in node["below"]}
        while left > 1e-9 and open_:
            w = sum(share(c) for c in open_)
            if w <= 0:
                break
            spill, still = 0.0, []
            for c in open_:
                want = given[id(c)] + left * share(c) / w
                most = supply(c)
                if want > most:
                    spill += want - most
                    want = most
                elif want < most:
                    still.append(c)
                given[id(c)] = want
            left, open_ = spill, [c for c in still if share(c) > 0]
        for c in node["below"]:
            pour(c, given[id(c)], out)

    def at(size):
        out = {x["source"]: 0.0 for x in leaves}
        pour(root, min(size, supply(root)), out)
        return out

    if total is not None:
        return at(total)
    # the largest size at which no source that has anything lacks part of what falls to it
    low, high = 0.0, float(supply(root))

    def meets(size):
        got = at(size)
        return all(got[x["source"]] >= size * x["share"] * (1 - 1e-9) for x in live) and sum(got.values()) >= size * (1 - 1e-9)

    low = min(x["supply"] / x["share"] for x in live)
    low = min(low, high)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if meets(middle) else (low, middle)
    return at(low) if weight else {x["source"]: 0.0 for x in leaves}


def _planned(sizes: DataFrame, targets: DataFrame, total: float | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of listed sources, the rows of the targets, and the plan of each source."""
    spark = sizes.sparkSession
    wanted = [r.asDict() for r in targets.dropDuplicates(["source"]).filter("source is not null").limit(SOURCES_BOUND + 1).collect()]
    if len(wanted) > SOURCES_BOUND:
        raise ValueError("too many sources")
    rows = spark.createDataFrame([(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted], "source string, target_share double, max_repeats int")
    once = sizes.filter("tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "lang")).alias("d")).select("doc_id", "d.*")
    docs = scratch.write(once.join(F.broadcast(rows.select("source")), "source").select("doc_id", "source", "lang", "tokens"))
    code = F.split(F.lower(F.trim("lang")), "[-_]")[0]
    names = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    language = F.coalesce(F.try_element_at(names, code), code, F.lit(""))
    per_lang = docs.groupBy("source", language.alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    named = F.when(F.col("language") != "", F.struct("n", "language"))
    per_source = per_lang.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("docs"), F.max(named)["language"].alias("language"))
    stat = {r["source"]: r for r in per_source.collect()}  # one row per source of the small table
    leaves = []
    for r in wanted:
        s = stat[r["source"]] if r["source"] in stat else {"tokens": 0, "docs": 0, "language": None}
        language = s["language"] or ""
        leaves.append({"source": r["source"], "share": float(r["target_share"] or 0), "supply": s["tokens"] * int(r["max_repeats"] or 0),
                       "language": language, "domain": DOMAINS.get(language, "other"), "tokens": s["tokens"], "docs": s["docs"]})
    given = budgets(leaves, total)
    plan = []
    for x in leaves:
        budget = math.floor(given[x["source"]] + 0.500001)  # halves go up, whatever the last bits of a sum are
        epochs, rest = divmod(budget, x["tokens"]) if x["tokens"] else (0, 0)
        plan.append((x["source"], budget, int(epochs), int(rest), max(1, -(-x["docs"] // BUCKET))))
    planned = spark.createDataFrame(plan, "source string, budget_tokens long, epochs int, rest long, buckets long")
    return docs, rows, planned


def planned(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, budget_tokens, epochs, rest, buckets) of every target: its budget as whole epochs and a rest."""
    return _planned(sizes, targets, total, Scratch(sizes.sparkSession, "mixture"))[2]


def mixture(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of documents `sizes` (doc_id, source, lang, tokens) and `targets`
    (source, target_share, max_repeats).

    chosen: (doc_id, source, tokens, repeats); shares: (source, target_share, budget_tokens,
    tokens, share, documents, most_repeats) of every target. A source gives whole epochs and of
    the next one, in an order seeded by the epoch, the documents whose running sum of tokens
    is within its budget, and up to FITTED others, each the one nearest to what is still missing. Running sums go by hash buckets of a source and then within the
    one bucket that the budget ends in, so a source that holds most documents is no single task. What a
    source gives differs from its budget by less than its longest document: the prefix stops at the
    first one that doesn't fit, and each document added brings the sum nearer.
    Documents of sources without a target, NULL sources, and documents without tokens or an id
    are not used; repeated documents count once. `targets` is a small table: its rows pass the driver; repeated rows count once.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mixture")
    docs, rows, planned = _planned(sizes, targets, total, scratch)
    h = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    # buckets follow the order of the hash, so buckets and documents are ordered alike
    step = F.floor(F.shiftrightunsigned(h, 1) / (F.lit(2.0**63) / F.col("buckets"))).cast("long")
    epoch = docs.join(F.broadcast(planned), "source").withColumn("h", F.shiftrightunsigned(h, 1)).withColumn("bucket", F.least(step, F.col("buckets") - 1))
    sums = epoch.groupBy("source", "bucket").agg(F.sum("tokens").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = epoch.join(sums, ["source", "bucket"]).withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    run = scratch.write(run.select("doc_id", "source", "tokens", "epochs", "rest", "h", (F.col("upto") + F.col("tokens") <= F.col("rest")).alias("inside")))
    # what the prefix lacks is made up by the documents outside it that come nearest, one at a time
    lacks = run.groupBy("source", "rest").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("tokens"))), F.lit(0)).alias("has"))
    gaps = {r["source"]: r["rest"] - r["has"] for r in lacks.collect()}  # sources of the small table
    more: list[tuple[str, int]] = []
    for _ in range(FITTED):
        short = spark.createDataFrame([(s, g) for s, g in gaps.items() if g > 0], "source string, gap long")
        used = spark.createDataFrame(more, "source string, doc_id long")
        off = F.abs(F.col("tokens") - F.col("gap"))
        outside = run.filter("not inside").join(F.broadcast(used), ["source", "doc_id"], "left_anti").join(F.broadcast(short), "source")
        best = outside.filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "tokens")).alias("b")).collect()
        if not best:
            break
        for r in best:
            more.append((r["source"], r["b"]["doc_id"]))
            gaps[r["source"]] -= r["b"]["tokens"]
    fitted = spark.createDataFrame(more, "source string, doc_id long").withColumn("fitted", F.lit(True))
    chosen = run.join(F.broadcast(fitted), ["source", "doc_id"], "left").withColumn("repeats", F.col("epochs") + (F.col("inside") | F.coalesce("fitted", F.lit(False))).cast("int"))
    chosen = chosen.filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    chosen = scratch.write(chosen)
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("t")).scalar()
    shares = rows.join(planned.select("source", "budget_tokens"), "source").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "budget_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return chosen, shares
