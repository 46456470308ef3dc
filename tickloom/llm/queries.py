"""Queries pN_ of the problems on training data, with SQL for those SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing, percentiles, sentences, tokens
from tickloom.llm.sentences import CODES
from tickloom.session import Scratch, table

#: Quantiles that are reported.
QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.99]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    summary = percentiles.summarise(percentiles.trace_lengths(spark, d), ["generator"], "length").filter("generator is not null")
    both = percentiles.select(summary, ["generator"], [0.5, 0.99])
    wide = both.groupBy("generator", "n").pivot("q", [0.5, 0.99]).agg(F.max("value"))
    return wide.filter((F.col("n") >= 100) & (F.col("`0.99`") >= 50 * F.col("`0.5`"))).select(F.col("generator").cast("bigint").alias("generator"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per generator, from runs made per generator and block."""
    summary = percentiles.summarise(percentiles.trace_lengths(spark, d, "block"), ["generator", "block"], "length", eps=0)
    return percentiles.select(percentiles.combine(summary, ["generator"]), ["generator"], QUANTILES).withColumn("generator", F.col("generator").cast("bigint"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians per generator and block, whose runs also make up p4_percentiles."""
    summary = percentiles.summarise(percentiles.trace_lengths(spark, d, "block"), ["generator", "block"], "length", eps=0)
    return percentiles.select(summary, ["generator", "block"], [0.5]).withColumn("generator", F.col("generator").cast("bigint")).drop("q")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(tokens.sizes(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each size, what they hold and how full they are."""
    per = p6_packed(spark, d).groupBy("container", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    sized = per.join(F.broadcast(table(spark, d, "pack_capacities").dropDuplicates()), "container")
    return sized.groupBy("container").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"),
        (F.sum("t") / F.sum("capacity_tokens")).alias("filled"), F.max("t").alias("fullest"), F.max("n").alias("most_pieces"),
    )


#: Limits of p6_limits that bind: at most so much of a container bears loss, one segment per so many tokens.
LOSS_SHARE, SEGMENT_TOKENS = 0.96, 256


def _limited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    capacities = table(spark, d, "pack_capacities").dropDuplicates()
    # written, since both checks read it
    packed = Scratch(spark, "limited").write(packing.fill(tokens.sizes(table(spark, d, "documents")), capacities, LOSS_SHARE, tokens_per_segment=SEGMENT_TOKENS))
    limits = capacities.select(
        "container", "capacity_tokens", F.greatest(F.floor(F.col("capacity_tokens") / SEGMENT_TOKENS), F.lit(1)).alias("segments"),
        F.floor(F.col("capacity_tokens") * F.lit(LOSS_SHARE)).alias("loss"),
    )
    return packed, limits


def _full(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    packed, limits = _limited(spark, d)
    per = packed.groupBy("container", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("loss_tokens").alias("l"))
    return packed, per.join(limits, "container")


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Packing under limits on tokens, segments and loss-bearing tokens that all bind, checked: documents in
    containers of each size, documents whose pieces don't make them up, and containers beyond a limit."""
    packed, per = _full(spark, d)
    whole = packed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("got"), F.max(F.col("token_from") + F.col("tokens")).alias("upto"), F.min("token_from").alias("from"))
    docs = whole.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("got") != F.col("upto")) | (F.col("from") != 0)).alias("broken"))
    over = per.groupBy("container").agg(
        F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_tokens"), F.count_if(F.col("n") > F.col("segments")).alias("over_segments"), F.count_if(F.col("l") > F.col("loss")).alias("over_loss"))
    return docs.join(over, "container")


def p6_binding(spark: SparkSession, d: str) -> DataFrame:
    """How many containers of p6_limits are filled to 97 % of each limit."""
    _, per = _full(spark, d)
    near = lambda used, limit: F.count_if(F.col(used) >= 0.97 * F.col(limit))
    return per.groupBy("container").agg(
        F.count(F.lit(1)).alias("containers"), near("t", "capacity_tokens").alias("by_tokens"), near("n", "segments").alias("by_segments"), near("l", "loss").alias("by_loss"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(tokens.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(tokens.sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def _characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("tokens"))


def _listed_size(sizes: DataFrame, targets: DataFrame) -> float:
    """The size of the documents of the listed sources: as a total, one at which the scarce ones run short."""
    listed = targets.select("source").distinct()
    return float(sizes.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(listed, "source", "left_semi").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])


def p7_short(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as all documents of the listed sources: scarce sources run short, and what they lack goes to
    siblings and then ancestors; the shares that each source reached."""
    sizes, targets = Scratch(spark, "sizes").write(tokens.sizes(table(spark, d, "documents"))), table(spark, d, "mix_targets")
    return mixing.mixture(sizes, targets, _listed_size(sizes, targets))[1]


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The budgets of p7_short with sizes in characters, which SQL can count."""
    sizes, targets = _characters(spark, d), table(spark, d, "mix_targets")
    plan = mixing.planned(sizes, targets, _listed_size(sizes, targets))
    return plan.select("source", F.col("budget_tokens").alias("budget"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents")).select("doc_id", "end_char").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_percentiles, p4_blocks, p6_packed, p6_usage, p6_limits, p6_binding, p7_mixture, p7_shares, p7_short, p7_budgets, p8_found)}

_LENGTHS = """lengths as (select generator, block, e - b as length from (
    select id, min(generator) as generator, min(begin_tick) as b, min(end_tick) as e, min(block) as block from trace_transactions where id is not null group by id)
  where b is not null and e >= b and e <> 9223372036854775807)"""

_LANGUAGE = "split_part(regexp_replace(lower(trim(lang)), '_', '-', 'g'), '-', 1)"


def _poured(level: str, above: str, into: str) -> str:
    """SQL of a level's amounts: what each node of `above` has is spread over its children `into` by weight, none beyond
    its supply. With the children in the order of supply per weight, those that run short come first; the
    level of the rest is the largest of what is left per weight left."""
    return f"""{level}_order as (select c.*, a.amount, sum(c.supply) over w - c.supply as taken, sum(c.share) over (partition by c.up) - sum(c.share) over w + c.share as open
        from {into} c join {above} a on a.node = c.up window w as (partition by c.up order by case when c.share > 0 then c.supply / c.share else -1 end, c.node rows unbounded preceding)),
      {level}_level as (select *, max(case when share > 0 then (amount - taken) / nullif(open, 0) end) over (partition by up) as level from {level}_order),
      {level} as (select node, up, case when share > 0 then least(supply, coalesce(share * level, supply)) else 0.0 end as amount from {level}_level)"""


_BUDGETS = f"""docs as (select doc_id, any_value(source) as source, any_value(lang) as lang, any_value(length(text)) as tokens from documents where doc_id is not null and length(text) > 0 group by doc_id),
  wanted as (select distinct source, cast(target_share as double) as share, max_repeats from mix_targets where source is not null),
  coded as (select source, tokens, case {' '.join(f"when {_LANGUAGE} = '{a}' then '{b}'" for a, b in CODES.items())} else coalesce({_LANGUAGE}, '') end as language from docs where source in (select source from wanted)),
  spoken as (select source, arg_max(language, (n, language)) as language from (select source, language, count(*) as n from coded where language <> '' group by 1, 2) group by 1),
  leaf as (select w.source, w.share, coalesce(sum(c.tokens), 0) * w.max_repeats * 1.0 as supply, coalesce(any_value(s.language), '') as language
    from wanted w left join coded c using (source) left join spoken s using (source) group by w.source, w.share, w.max_repeats),
  placed as (select *, case {' '.join(f"when language = '{a}' then '{b}'" for a, b in mixing.DOMAINS.items())} else 'other' end as domain from leaf),
  top as (select 'all' as node, least(sum(supply), (select sum(tokens) from coded)) * 1.0 as amount from placed),
  domains as (select domain as node, 'all' as up, sum(share) as share, sum(supply) as supply from placed group by 1),
  languages as (select domain || '/' || language as node, domain as up, sum(share) as share, sum(supply) as supply from placed group by domain, language),
  sources as (select source as node, domain || '/' || language as up, share, supply from placed),
  {_poured('d', 'top', 'domains')}, {_poured('l', 'd', 'languages')}, {_poured('s', 'l', 'sources')}"""

SQL = {
    "p6_limits": """select container, (select count(distinct doc_id) from documents where length(text) > 0 and doc_id is not null) as documents, 0 as broken, 0 as over_tokens, 0 as over_segments, 0 as over_loss
      from (select distinct container from pack_capacities)""",
    "p7_budgets": f"with {_BUDGETS} select node as source, cast(floor(amount + 0.500001) as bigint) as budget from s",
    "p4_found": f"""with {_LENGTHS} select cast(generator as bigint) as generator from lengths where generator is not null group by generator
      having count(*) >= 100 and quantile_disc(length, 0.99) >= 50 * quantile_disc(length, 0.5)""",
    "p4_percentiles": f"""with {_LENGTHS}, ranked as (select generator, length, row_number() over (partition by generator order by length) as r,
        count(*) over (partition by generator) as n from lengths),
      qs as (select unnest([0.25, 0.5, 0.75, 0.9, 0.99]) as q)
      select cast(generator as bigint) as generator, cast(q as double) as q, n, length as value from ranked, qs
      where r = greatest(ceil(round(cast(q as double) * n, 6)), 1)""",
    "p4_blocks": f"""with {_LENGTHS}, ranked as (select generator, block, length, row_number() over (partition by generator, block order by length) as r,
        count(*) over (partition by generator, block) as n from lengths)
      select cast(generator as bigint) as generator, block, n, length as value from ranked where r = greatest(ceil(round(0.5 * n, 6)), 1)""",
}
