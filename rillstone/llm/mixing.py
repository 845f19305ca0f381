"""Mixing sources to target weights with a time-varying curriculum; DataFrame functions only.

Targets: sources in code-point order, null last, have the weights 5, 2, 1, repeating; a target stops at three times its
source's size and the excess is shared again by weight.  That water level has a closed form over the source table
sorted by cap / weight: the level is the largest (total - caps before) / (weights from here on).

Documents: a source whose target is q whole passes and a rest takes every document q times, and once more a prefix of
its documents in an order given by md5 of the id, plus the one further document whose size best fills what is left.
Prefix sums are taken in two levels - sums of 4,096 hash ranges of a source, then inside one range - so no task holds
more than about 1/4096 of a source, however large that source is.

Positions: each source has a schedule of weight over training time t in [0, 1], a straight line from ``a`` to ``2 - a``.
Its integral a*t + (1 - a)*t*t is the share of the source's tokens due by t; inverting it at a document's cumulative
token offset gives the document's training position, and rows are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
RAMPS = (1.0, 1.5, 0.5)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def _cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _source(source: Column) -> Column:
    """A text that sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(src, source_size long) -> (src, source_size, target double, ramp double), one row for each source."""
    in_order = Window.orderBy("src")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    everything = Window.partitionBy()
    ranked = sizes.withColumn("at", F.row_number().over(in_order) - 1).withColumns({"weight": _cycle(weights, F.col("at")), "cap": F.col("source_size") * most})
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"), _cycle(RAMPS, F.col("at")).alias("ramp"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, doc_id, size, n, source_size, target, copies int, position double) from docs' doc_id, text and source.

    One row for each distinct (source, doc_id, size); n rows of docs have it and each of them is taken ``copies`` times.
    Null and blank texts have size 0 and are never taken for words; an empty table gives no rows.  position is where the
    first copy stands; a document that isn't taken has none.
    """
    sized = docs.select(_source(F.col("source")).alias("src"), F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("size"))
    units = sized.groupBy("src", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    units = written(units.withColumn("range", F.substring("key", 1, 3)), "units")
    ranges = units.groupBy("src", "range").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    totals = source_targets(ranges.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).drop("words").join(totals, "src")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("int")
    ranges = written(ranges.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "ranges")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = units.join(ranges, ["src", "range"]).withColumn("upto", F.col("before") + F.sum(F.col("n") * F.col("size")).over(inside))
    summed = summed.withColumn("chosen", F.col("upto") <= F.col("rest"))
    gaps = summed.groupBy("src").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("chosen"), F.col("upto"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("n") * F.col("size"))
    spare = summed.select("src", "range", "key", "doc_id", "size", "n", "chosen").filter("not chosen").join(ranges.select("src", "range").join(gaps, "src"), ["src", "range"]).filter(off < F.col("gap"))
    extra = spare.groupBy("src").agg(F.min(F.struct(off.alias("off"), "key", F.coalesce("doc_id", F.lit(0)).alias("id"), "size")).alias("best")).select("src", F.col("best.key").alias("key"), F.col("best.size").alias("size"), F.lit(True).alias("extra"))
    full = summed.join(extra, ["src", "key", "size"], "left")
    copies = (F.col("passes") + F.when(F.col("chosen") | F.col("extra"), 1).otherwise(0)).cast("int")
    due = (F.col("upto") - F.col("n") * F.col("size")) / F.col("target")
    ahead = F.col("ramp") * F.col("ramp") + 4 * (1 - F.col("ramp")) * F.least(due, F.lit(1.0))
    place = F.when(F.col("ramp") == 1, F.least(due, F.lit(1.0))).otherwise((F.sqrt(ahead) - F.col("ramp")) / (2 * (1 - F.col("ramp"))))
    return full.withColumn("copies", F.least(copies, F.lit(most))).select("src", "doc_id", "size", "n", "source_size", "target", "copies", F.when((F.col("copies") > 0) & (F.col("target") > 0), place).alias("position"), F.col("upto"), F.col("ramp"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position): a row for each row of docs, by position."""
    made = plan(docs, weights, most)
    source = F.when(F.col("src") != "1", F.substring("src", 2, 1 << 30)).alias("source")
    each = made.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", source, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows of docs in training order: each as often as the mix takes it, with docs' columns.

    A copy's position is the inverse of its source's integrated schedule at its token offset; later passes follow
    earlier ones.  Rows without words carry no tokens and are left out by a mix of words.
    """
    made = plan(docs, weights, most).filter("copies > 0 and size > 0").withColumnRenamed("doc_id", "_id")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), _source(F.col("source")).alias("_src"), F.col("doc_id").cast("long").alias("_doc"), word_count(F.col("text").cast("string")).alias("_size"))
    met = rows.join(made, (F.col("_src") == F.col("src")) & F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("size")))
    each = met.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    due = F.least((F.col("_pass") * F.col("source_size") + F.col("upto") - F.col("n") * F.col("size")) / F.col("target"), F.lit(1.0))
    ramp = F.col("ramp")
    place = F.when(ramp == 1, due).otherwise((F.sqrt(ramp * ramp + 4 * (1 - ramp) * due) - ramp) / (2 * (1 - ramp)))
    return each.withColumn("_at", place).orderBy("_at", "_doc", "_pass").select(*[F.col("_row").getField(c).alias(c) for c in names])


#: DuckDB SQL of ``mixture`` over ``documents``.
MIXTURE_SQL = r"""
with sized as (
  select coalesce('0' || source, '1') as src, doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), units as (
  select src, doc_id, size, count(*) as n, md5(coalesce(doc_id::varchar, '')) as key from sized group by all
), totals as (
  select src, sum(n * size)::bigint as source_size from units group by src
), ranked as (
  select *, row_number() over (order by src) - 1 as nth from totals
), capped as (
  select *, [5, 2, 1][nth % 3 + 1] as weight, [1.0, 1.5, 0.5][nth % 3 + 1]::double as ramp, 3 * source_size as cap from ranked
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, src rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by cap::double / weight, src rows between current row and unbounded following) as level from capped
), targets as (
  select src, source_size, ramp, least(cap::double, max(level) over () * weight) as target from levels
), parts as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::int as passes from targets
), summed as (
  select u.*, p.source_size, p.target, p.ramp, p.passes, p.target - p.passes * p.source_size as rest,
    sum(n * size) over (partition by src order by key, doc_id, size rows unbounded preceding)::bigint as upto from units u join parts p using (src)
), gaps as (
  select src, any_value(rest) - coalesce(max(upto) filter (upto <= rest), 0) as gap from summed group by src
), extra as (
  select src, key, size from (
    select s.src, key, size, row_number() over (partition by s.src order by abs(gap - n * size), key, doc_id, size) as r
    from summed s join gaps g using (src) where upto > rest and abs(gap - n * size) < gap) where r = 1
), full_plan as (
  select s.*, least(passes + (upto <= rest or e.src is not null)::int, 3)::int as copies, (upto - n * s.size)::double / target as due
  from summed s left join extra e on e.src = s.src and e.key = s.key and e.size = s.size
)
select doc_id, case when src <> '1' then substr(src, 2) end as source, size, source_size, target, size * copies as taken, copies,
  case when copies > 0 and target > 0 then round(case when ramp = 1 then least(due, 1.0) else (sqrt(ramp * ramp + 4 * (1 - ramp) * least(due, 1.0)) - ramp) / (2 * (1 - ramp)) end, 9) end as position
from (select *, unnest(range(n)) as copy_no from full_plan)
"""
