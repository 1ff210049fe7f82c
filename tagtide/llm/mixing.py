"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. Native.

A source's documents, in seeded order, form one stream of words that is cut into blocks of equal
size. Blocks are dealt to sources by highest quotients target/(2k+1); a source's quota is split into
full passes over its stream and a rest, the rest into integer quotas per shard (a run of
`shard_blocks` blocks), and a shard's quota picks its blocks of smallest seeded hash. Quotients are
computed only around the final divisor, so their number follows the number of sources, not of blocks;
blocks are never rows: a document derives its share from its own span and its shards' thresholds.

Positions in a source's stream come from two levels (hash range, then inside it), so a source with a
third of all rows is spread over 2**bits groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import cut, small, words


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> with src (rank by code point, null last, from 0) and target.

    Targets share the sum of all sizes by weight, weights repeating over the ranks; a target stops at
    max_repeat times its source's size and the excess is reshared by weight until none is above.
    One row per source passes a global window.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("src", F.row_number().over(every) - 1).withColumn("weight", w).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    # in this order the capped sources come first
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    last = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(whole)["level"]
    return levelled.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(last * F.col("weight"))).select("source", "source_size", "src", "target")


def apportion(items: DataFrame, seats: Callable[[Column], Column]) -> DataFrame:
    """(src, target, ...) -> with quota: seats(sum of targets) given to the highest quotients target/(2k+1), ties to the smaller src.

    A first allotment at a divisor surely too large is followed by the quotients up to a divisor surely
    too small: about three per item are ranked.
    """
    whole = Window.partitionBy()
    n, total = F.count(F.lit(1)).over(whole), F.sum("target").over(whole)
    sized = items.withColumn("_n", n).withColumn("_t", total).withColumn("_k", seats(F.col("_t")).cast("long"))
    low = F.when((F.col("_k") > F.col("_n")) & (F.col("_t") > 0), F.greatest(F.floor(F.col("target") * (F.col("_k") - F.col("_n")) / F.col("_t") + 0.5) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    high = F.when(F.col("_t") > 0, F.floor(F.col("target") * (F.col("_k") + F.col("_n")) / F.col("_t") + 0.5) + 1).otherwise(F.lit(0)).cast("long")
    bounded = sized.withColumn("_low", low).withColumn("_high", high).withColumn("_rest", F.col("_k") - F.sum(low).over(whole))
    steps = bounded.filter("_high > _low").select("src", "_rest", F.explode(F.expr("sequence(_low, _high - 1)")).alias("k"), "target").withColumn("q", F.col("target") / (2 * F.col("k") + 1))
    won = steps.withColumn("r", F.row_number().over(Window.orderBy(F.desc("q"), "src", "k"))).filter("r <= _rest and q > 0").groupBy("src").agg(F.count(F.lit(1)).alias("_won"))
    return bounded.join(won, "src", "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_k", "_n", "_t", "_low", "_high", "_rest", "_won")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, block: int = 64, shard_blocks: int = 1024, seed: int = 17, bits: int = 12, max_broadcast: int = 32 << 20) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, source, size, source_size, target, taken).

    size counts the words `[^\\x20\\x09-\\x0D]+` (null or empty text: 0). taken counts the words the mix
    takes from the document, repeats included: never more than max_repeat times its size. A source's
    taken words differ from its target by a few blocks at most. Rows with a null or repeated doc_id are
    documents of their own; other columns are ignored. Reruns agree. An empty table gives no rows.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = apportion(targets(sizes, weights, max_repeat), lambda total: F.round(total / block))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    plan = cut(planned.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.lit(max_repeat) * F.col("blocks"))).withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks")))
    shards = plan.filter("blocks > 0").select("src", "blocks", "rest", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {shard_blocks})")).alias("shard"))
    upto = lambda s: f"((rest * least(blocks, {s} * {shard_blocks})) div blocks)"
    shards = shards.repartition("src", "shard").withColumn("part", F.expr(f"{upto('(shard + 1)')} - {upto('shard')}"))
    hashes = F.expr(f"array_sort(transform(sequence(shard * {shard_blocks}, least(blocks, (shard + 1) * {shard_blocks}) - 1), b -> md5(concat_ws('|', '{seed}', src, b))))")
    limits = shards.select("src", "shard", F.when(F.col("part") > 0, F.element_at(hashes, F.col("part").cast("int"))).otherwise(F.lit("")).alias("limit"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    placed = sized.join(small(plan, max_broadcast).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "quota", "rest", "blocks").withColumn("place", place).withColumn("range", F.shiftright("place", 60 - bits))
    totals = placed.groupBy("src", "range").agg(F.sum("size").alias("n"))
    offsets = totals.select("src", "range", (F.sum("n").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("src", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.join(offsets, ["src", "range"]).withColumn("stop", F.col("offset") + F.sum("size").over(inside)).withColumn("start", F.col("stop") - F.col("size"))
    whole = ["doc_id", "source", "size", "source_size", "target"]
    taken = F.expr(
        f"aggregate(sequence(greatest(start div {block}, shard * {shard_blocks}), least((stop - 1) div {block}, (shard + 1) * {shard_blocks} - 1)), 0L, (t, b) -> t + (least(stop, (b + 1) * {block}) - greatest(start, b * {block})) * (passes + if(md5(concat_ws('|', '{seed}', src, b)) <= limit, 1, 0)))"
    )
    parts = spans.filter("size > 0").withColumn("shard", F.explode(F.expr(f"sequence(start div {block} div {shard_blocks}, (stop - 1) div {block} div {shard_blocks})")))
    parts = parts.join(limits, ["src", "shard"]).select(*whole, "start", taken.alias("taken"))
    some = parts.groupBy(*whole, "start").agg(F.sum("taken").alias("taken")).drop("start")
    none = spans.filter("size = 0").select(*whole, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def sql(block: int = 64, shard_blocks: int = 1024, seed: int = 17, max_repeat: int = 3) -> str:
    """DuckDB's form: blocks and quotients are rows there."""
    return rf"""
with sized as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT size from documents),
ranked as (select source, sum(size)::BIGINT source_size, row_number() over (order by source nulls last) - 1 src from sized group by source),
caps as (select *, case src % 3 when 0 then 5 when 1 then 2 else 1 end weight, {max_repeat} * source_size cap from ranked),
levels as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, src rows between unbounded preceding and 1 preceding), 0))::DOUBLE
    / sum(weight) over (order by cap / weight, src rows between current row and unbounded following) lv from caps),
lv as (select arg_min(lv, cap / weight * 1e6 + src) lv from levels where not lv * weight >= cap),
targets as (select source, source_size, src, case when levels.lv * weight >= cap then cap::DOUBLE else (select lv from lv) * weight end target from levels),
seats as (select round(sum(target) / {block})::BIGINT k from targets),
quotients as (select src, target / (2 * unnest(range(0, (target / {block})::BIGINT + 40)) + 1) q from targets where target > 0),
won as (select src, count(*) quota from (select src, row_number() over (order by q desc, src) r from quotients) where r <= (select k from seats) group by src),
plan as (select t.*, ceil(source_size / {block})::BIGINT blocks, least(coalesce(quota, 0), {max_repeat} * ceil(source_size / {block})::BIGINT) quota from targets t left join won using (src)),
plan2 as (select *, quota // blocks passes, quota % blocks rest from plan where blocks > 0),
blocks as (select src, blocks, passes, rest, b, b // {shard_blocks} shard, md5('{seed}|' || src || '|' || b) h from (select *, unnest(range(0, blocks)) b from plan2)),
picked as (select *, case when row_number() over (partition by src, shard order by h) <=
    (rest * least(blocks, (shard + 1) * {shard_blocks})) // blocks - (rest * least(blocks, shard * {shard_blocks})) // blocks then 1 else 0 end + passes times from blocks),
spans as (select doc_id, size, source_size, target, src, sum(size) over (partition by src order by ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size rows between unbounded preceding and current row) stop
    from sized s join targets t on s.source is not distinct from t.source),
shares as (select doc_id, stop, sum((least(stop, (b + 1) * {block}) - greatest(stop - size, b * {block})) * times) taken
    from spans s join picked p on p.src = s.src and p.b between (stop - size) // {block} and (stop - 1) // {block} where size > 0 group by all)
select s.doc_id, s.size, s.source_size, s.target, coalesce(taken, 0)::BIGINT taken from spans s left join shares h on h.doc_id is not distinct from s.doc_id and h.stop = s.stop and s.size > 0"""
