"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

The targets say how many words each source gives. A schedule of slots, one block of words each,
is laid out with the golden-ratio sequence: slot n is the point ``n * 2654435769 mod 2^32``, and the
source whose share of the cumulative targets holds the point owns the slot. Any stretch of the
schedule therefore holds every source in proportion. The r-th slot of a source takes the r-th block
of its documents in shuffled order, beginning again when they are used up.

Only DataFrame functions are used. Running numbers are never taken over a whole source in one task:
rows are cut into stretches by hash or slot number, stretches are summed, and the sums carried over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import WORD, settled

#: 2^32 over the golden ratio, odd, so the points of 2^32 slots are all different. Fixed value.
GOLDEN = 2654435769
SCALE = 1 << 32
#: Points are found in the sources' shares by buckets of 2^20 points.
BUCKET_BITS = 20
SLOT_STRETCH = 1 << 14
ROWS_PER_STRETCH = 4096


@dataclass(frozen=True)
class Mix:
    """``share`` of all words is dealt to sources with repeating ``weights``; none gives over ``max_repeats`` times its words."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    max_repeats: int = 2
    block_words: int = 64


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a place in the shuffle, from 0 to 1."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") / F.lit(float(SCALE))
    return docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), order.alias("_order"), place.alias("_place"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: source_size, n_rows, target, and its part ``[low, high)`` of the 2^32 points.

    Dealing by weight, cutting at the cap and dealing the excess again ends at one level L with
    target = min(cap, L * weight). Sources in order of cap / weight reach their caps one after
    another, so L follows from running sums over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    per = per.withColumn("_ix", F.row_number().over(by_name) - 1).withColumn(
        "_weight", F.get(weights, F.col("_ix") % len(mix.weights))).withColumn(
        "_cap", (F.col("source_size") * mix.max_repeats).cast("double"))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), "_ix")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(mix.share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level)
    # The first source whose cap lies above the level that is left fixes the level of all after it.
    held = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.struct(
        (F.col("_cap") / F.col("_weight")).alias("a"), F.col("_ix").alias("b"), F.col("_level").alias("level")))).over(everything)
    per = per.withColumn("_final", held["level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")))
    per = per.withColumn("target", target).withColumn("_words", F.round("target").cast("long"))
    upto = F.sum("_words").over(Window.orderBy("_ix")).cast("double")
    total = F.sum("_words").over(everything)
    per = per.withColumn("_total", total).withColumn(
        "_high", F.when(total > 0, F.floor(upto / total.cast("double") * float(SCALE))).otherwise(F.lit(0)).cast("long"))
    return per.withColumn("_low", F.coalesce(F.lag("_high").over(Window.orderBy("_ix")), F.lit(0)).cast("long")).select(
        "source", F.col("_ix").alias("source_ix"), "source_size", "n_rows", "target",
        F.col("_total").alias("total"), F.col("_low").alias("low"), F.col("_high").alias("high"))


def schedule(plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per slot: slot, source_ix, block (of the source's shuffled words) and epoch.

    Every source's slots are ranked: its slots in earlier stretches (counted once per stretch and
    source, then summed) plus its rank inside the stretch. Slots past ``max_repeats`` passes drop out.
    """
    total = plan.agg(F.max("total")).first()[0] or 0
    slots = plan.sparkSession.range(-(-total // mix.block_words)).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_STRETCH).alias("_stretch"))
    slots = slots.withColumn("_point", F.pmod(F.pmod(F.col("slot"), F.lit(SCALE // 2)) * F.lit(GOLDEN), F.lit(SCALE)))
    # Sources that own no point own no slot.
    shares = plan.filter("high > low").select("source_ix", "source_size", "low", "high", F.explode(F.sequence(
        F.shiftright("low", BUCKET_BITS), F.shiftright(F.col("high") - 1, BUCKET_BITS))).alias("_bucket"))
    found = slots.withColumn("_bucket", F.shiftright("_point", BUCKET_BITS)).join(shares, "_bucket").filter(
        "_point >= low and _point < high").select("slot", "_stretch", "source_ix", "source_size")
    counted = found.groupBy("source_ix", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = counted.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("source_ix").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = found.withColumn("_inside", F.row_number().over(Window.partitionBy("_stretch", "source_ix").orderBy("slot")) - 1)
    ranked = inside.join(earlier, ["source_ix", "_stretch"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    blocks = F.ceil(F.col("source_size") / mix.block_words).cast("long")
    return ranked.withColumn("_blocks", blocks).filter(F.col("_rank") < F.col("_blocks") * mix.max_repeats).select(
        "slot", "source_ix", (F.col("_rank") % F.col("_blocks")).alias("block"),
        F.floor(F.col("_rank") / F.col("_blocks")).cast("long").alias("epoch"))


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Every document with its source's plan and the stretch ``[start, start + size)`` of words it
    fills in its source's shuffled order."""
    by_source = sizes["source"].eqNullSafe(plan["source"])
    rows = sizes.join(plan, by_source).drop(plan["source"])
    stretches = F.floor(F.col("n_rows") / ROWS_PER_STRETCH) + 1
    rows = rows.withColumn("_stretch", F.floor(F.col("_place") * stretches).cast("long"))
    filled = rows.groupBy("source_ix", "_stretch").agg(F.sum("size").alias("_n"))
    earlier = filled.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("source_ix").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source_ix", "_stretch").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(earlier, ["source_ix", "_stretch"]).withColumn("start", F.col("_before") + F.col("_inside")).drop(
        "_before", "_inside", "_stretch", "_place")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken.

    ``docs`` needs doc_id, source and text; other columns are ignored. A null text has no words, a
    null source is a source of its own (after all others), an empty table gives an empty one. Rows that
    repeat a doc_id are documents of their own. Documents without words are returned with taken = 0.
    A source's words taken differ from its target by a few blocks at most.
    The sources' plan has one row per source; Spark broadcasts it only below its size limit.
    """
    sizes = settled(sized(docs), "mix-sizes")
    plan = settled(targets(sizes, mix), "mix-plan")
    rows = settled(placed(sizes, plan).withColumn("_row", F.monotonically_increasing_id()), "mix-placed")
    last = F.floor((F.col("start") + F.col("size") - 1) / mix.block_words)
    pieces = rows.filter("size > 0").select("_row", "source_ix", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / mix.block_words), last)).alias("block"))
    inside = F.least((F.col("block") + 1) * mix.block_words, F.col("start") + F.col("size")) - F.greatest(
        F.col("block") * mix.block_words, F.col("start"))
    pieces = pieces.select("_row", "source_ix", "block", inside.alias("_words"))
    wanted = schedule(plan, mix).groupBy("source_ix", "block").agg(F.count(F.lit(1)).alias("_times"))
    # Sizes guessed before the explodes are far too small to choose a broadcast by.
    taken = pieces.hint("merge").join(wanted, ["source_ix", "block"]).groupBy("_row").agg(F.sum(F.col("_words") * F.col("_times")).alias("_taken"))
    return rows.hint("merge").join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


MIX_SQL = """with sizes as materialized (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as ord from documents),
per as (select source, sum(size)::bigint as source_size from sizes group by source),
numbered as (select *, row_number() over (order by source collate "binary" nulls last) - 1 as ix, (2 * source_size)::double as cap from per),
weighted as (select *, case ix % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from numbered),
levels as (select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(cap) over (order by cap / weight, ix rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, ix rows between unbounded preceding and 1 preceding), 0)) as level
  from weighted),
held as (select level from levels where cap > level * weight order by cap / weight, ix limit 1),
aimed as (select *, case when (select count(*) from held) = 0 then cap
  else least(cap, (select level from held) * weight) end as target from levels),
shares as (select *, sum(round(target)::bigint) over (order by ix)::double as upto, sum(round(target)::bigint) over ()::double as total
  from aimed),
plan as (select source, ix, source_size, target, total::bigint as total,
  floor(upto / total * 4294967296)::bigint as high from shares),
parts as (select *, coalesce(lag(high) over (order by ix), 0) as low from plan),
slots as (select n as slot, ((n % 2147483648) * 2654435769) % 4294967296 as point
  from range((select ceil(max(total) / 64.0)::bigint from plan)) r(n)),
owned as (select p.ix, p.source_size, row_number() over (partition by p.ix order by slot) - 1 as rank
  from slots join parts p on point >= p.low and point < p.high),
wanted as (select ix, rank % ceil(source_size / 64.0)::bigint as block, count(*) as times from owned
  where rank < 2 * ceil(source_size / 64.0)::bigint group by all),
placed as (select s.doc_id, s.size, p.ix, p.source_size, p.target,
  (sum(s.size) over (partition by p.ix order by ord, s.doc_id, s.size rows unbounded preceding) - s.size)::bigint as start
  from sizes s join parts p on s.source is not distinct from p.source),
pieces as (select *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) as block from placed where size > 0),
got as (select doc_id, sum((least((p.block + 1) * 64, start + size) - greatest(p.block * 64, start)) * times)::bigint as taken
  from pieces p join wanted w on p.ix = w.ix and p.block = w.block group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from placed left join got using (doc_id)"""
