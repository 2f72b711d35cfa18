"""Mixing sources to target weights under a time-varying curriculum, with DataFrame functions only.

Targets: the sources share the whole corpus by weight; a source's target stops at `most` times its size, and the
excess is shared again by weight among the others until none is above.

Order: within a source, documents stand in the order of a hash.  A source that is taken r times passes through
this order floor(r) times and then through a part of it; the document on the border is taken in part.

Curriculum: a source's demand at training time t in [0, 1] is its target times a linear density that begins at
`start` and ends at `end` (relative to its mean 1).  Its integral, the cumulative demand, is inverted in closed form:
the words before a document's pass give that pass's training position.  `training_order` range-sorts by it.

Scale: a document's place in its source is a prefix sum over two levels of hash buckets and the documents of a
bucket, so no task sees a whole source; buckets follow the row count.  Only the sources' totals, one row of some 60
bytes for each, meet in one task, whose windows spill; they are joined as Spark chooses by their size.  So sources
may be many (10**7 of them are 0.6 GB in that task), though not as many as documents at the largest scale.

Defined cases: null sources are a source of their own, last in order; null texts have size 0; documents of size 0
take nothing; empty tables and sources without words have targets of 0; repeated rows are documents of their own;
other columns pass through, whatever their names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables
from .columns import kept, spare_prefix

WORD = r"[^\x20\x09-\x0D]+"
NAMES = ("size", "source_size", "target", "taken", "positions")


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1, 2, 3)  # by rank of the source, repeating
    most: float = 3.0
    #: Density at the begin and the end of training by rank of the source, repeating; each pair has the mean 1.
    schedules: tuple[tuple[float, float], ...] = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
    rows_per_bucket: int = 512


def size_of(text: Column) -> Column:
    """The number of words: characters other than white space that begin the text or follow white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, weight, rank, target) from (source, source_size), one row for each source.

    The shared part of the total at which a source reaches its cap grows with cap / weight, so the capped sources
    are a prefix of that order: one running sum finds it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    named = sizes.withColumn("rank", rank).withColumn("weight", _cycle(F.col("rank"), list(mix.weights)))
    cap = F.col("source_size") * F.lit(float(mix.most))
    by_need = Window.orderBy("need", "rank")
    run = named.withColumn("cap", cap).withColumn("need", F.col("cap") / F.col("weight"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = run.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn("total", F.sum("source_size").over(every))
    # the share of a unit of weight, if all sources before this one are capped and this one is not
    run = run.withColumn("unit", (F.col("total") - F.col("caps")) / F.col("weights"))
    free = F.col("need") >= F.col("unit")
    level = F.min(F.when(free, F.struct("need", "rank", "unit"))).over(every)
    run = run.withColumn("level", level.unit)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return run.select("source", "source_size", "weight", "rank", target.alias("target"))


def _invert(share: Column, begin: Column, end: Column) -> Column:
    """t with begin*t + (end-begin)*t*t/2 = share, for a density of mean 1."""
    slope = end - begin
    root = F.sqrt(F.greatest(begin * begin + 2 * slope * share, F.lit(0.0)))
    return F.when(share <= 0, 0.0).otherwise(F.least(F.lit(1.0), 2 * share / (begin + root)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix(), prefix: str = "") -> DataFrame:
    """`docs` with size, source_size, target, taken, and positions: the training time of each pass through the document.

    With a `prefix`, the new columns' names begin with it.
    """
    own = kept(docs, [f"{prefix}{n}" for n in NAMES])
    own_names = spare_prefix(docs, "mix_")
    m = lambda name: own_names + name  # noqa: E731  (columns of the plan's own)
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    name = F.col(f"`{source_col}`").cast("string")
    source = F.concat(F.when(name.isNull(), "1").otherwise("0"), F.coalesce(name, F.lit("")))  # never null; null sources come last
    n = docs.count()
    side = max(4, math.ceil(math.sqrt(max(1, n) / mix.rows_per_bucket)))  # side * side buckets in each source
    sized = docs.select(*own, source.alias(m("source")), size_of(F.col(f"`{text_col}`")).alias(m("size")), key.alias(m("key")))
    sized = sized.withColumn(m("low"), F.conv(F.substring(m("key"), 1, 12), 16, 10).cast("bigint") % (side * side))
    # one row for each source and bucket: small, and read three times below
    sums = Tables(docs.sparkSession).cut(sized.groupBy(m("source"), m("low")).agg(F.sum(m("size")).alias("words"))).withColumn(m("high"), F.floor(F.col(m("low")) / side))
    high = sums.groupBy(m("source"), m("high")).agg(F.sum("words").alias("words"))
    w_high = Window.partitionBy(m("source")).orderBy(m("high")).rowsBetween(Window.unboundedPreceding, -1)
    w_low = Window.partitionBy(m("source"), m("high")).orderBy(m("low")).rowsBetween(Window.unboundedPreceding, -1)
    first = high.select(m("source"), m("high"), F.coalesce(F.sum("words").over(w_high), F.lit(0)).alias("high_before"))
    second = sums.select(m("source"), m("high"), m("low"), F.coalesce(F.sum("words").over(w_low), F.lit(0)).alias("low_before"))
    places = second.join(first, [m("source"), m("high")]).select(m("source"), m("low"), (F.col("high_before") + F.col("low_before")).alias(m("bucket_before")))
    goal = targets(sums.groupBy(F.col(m("source")).alias("source")).agg(F.sum("words").alias("source_size")), mix)
    begin, end = (_cycle(F.col("rank"), [s[i] for s in mix.schedules]) for i in (0, 1))
    places = places.join(goal.select(F.col("source").alias(m("source")), F.col("source_size").alias(m("total")), F.col("target").alias(m("target")), begin.alias(m("begin")), end.alias(m("end"))), m("source"))
    inside = Window.partitionBy(m("source"), m("low")).orderBy(m("key"), F.col(f"`{id_col}`"), m("size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(m("inside"), F.coalesce(F.sum(m("size")).over(inside), F.lit(0)))
    joined = placed.join(places, [m("source"), m("low")])
    at = F.col(m("bucket_before")) + F.col(m("inside"))
    size, total, target = F.col(m("size")), F.col(m("total")), F.round(m("target")).cast("long")
    passes = F.when(total > 0, F.floor(target / total)).otherwise(F.lit(0)).cast("long")
    rest = target - passes * total
    part = F.greatest(F.lit(0), F.least(size, rest - at))
    taken = passes * size + part
    times = (passes + F.when(part > 0, 1).otherwise(0)).cast("int")
    spot = lambda k: _invert((k * total + at).cast("double") / F.greatest(target, F.lit(1)), F.col(m("begin")), F.col(m("end")))
    positions = F.when((size > 0) & (times > 0), F.transform(F.sequence(F.lit(0), times - 1), spot)).otherwise(F.array().cast("array<double>"))
    new = (size, total, F.col(m("target")), taken.cast("long"), positions)
    return joined.select(*own, *[c.alias(f"{prefix}{n}") for c, n in zip(new, NAMES, strict=True)])


def in_order(rows: DataFrame, position: Column, ties: list[Column], partitions: int | None = None) -> DataFrame:
    """`rows` range-sorted by position, those without one last; ties go by a hash of `ties`."""
    order = [position.asc_nulls_last(), F.xxhash64(*ties).asc()]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def passes(planned: DataFrame, columns: list[str], partitions: int | None = None, prefix: str = "") -> DataFrame:
    """`columns`, pass (from 0), n_words (what the pass takes of the document) and position for each pass of each planned document, range-sorted by position; the new columns replace those of `columns` with their names."""
    size, taken, positions = (F.col(f"{prefix}{n}") for n in ("size", "taken", "positions"))
    own = [F.col(f"`{c}`") for c in columns if c.lower() not in ("pass", "n_words", "position")]
    s, t, k, at = (spare_prefix(planned, "mix_") + x for x in ("size", "taken", "pass", "position"))
    rows = planned.select(*own, size.alias(s), taken.alias(t), F.posexplode(positions).alias(k, at))
    part = F.least(F.col(s), F.col(t) - F.col(k) * F.col(s))
    return in_order(rows.select(*own, F.col(k).cast("long").alias("pass"), part.alias("n_words"), F.col(at).alias("position")), F.col("position"), [*own, F.col("pass")], partitions)


def training_order(planned: DataFrame, columns: list[str], least_part: float = 0.5, partitions: int | None = None, prefix: str = "") -> DataFrame:
    """A row for each pass of each planned document, range-sorted by training position; whole texts.

    The pass that the border cuts stays if at least `least_part` of the document is taken in it.  Ties go by the
    remaining columns' hash.
    """
    size, taken, positions = (F.col(f"{prefix}{n}") for n in ("size", "taken", "positions"))
    k = F.size(positions)
    last = taken - (k - 1) * size
    whole = F.when((k > 0) & (last < least_part * size), F.slice(positions, 1, k - 1)).otherwise(positions)
    own, at = [F.col(f"`{c}`") for c in columns], spare_prefix(planned, "mix_") + "position"
    return in_order(planned.select(*own, F.explode(whole).alias(at)), F.col(at), own, partitions).select(*own)


def sql(mix: Mix = Mix(), table: str = "documents") -> str:
    """doc_id, size, source_size, target, taken, n_passes and first_position for DuckDB."""
    pick = lambda values, by: f"[{', '.join(f'{float(v)}::double' for v in values)}][{by}%{len(values)}+1]"
    begin, end = (pick([s[i] for s in mix.schedules], "rank") for i in (0, 1))
    share = "(place::double/greatest(goal,1))"
    spot = f"CASE WHEN {share}<=0 THEN 0.0 ELSE least(1.0, 2*{share}/(d0+sqrt(greatest(d0*d0+2*(d1-d0)*{share},0.0)))) END"
    return f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS size,
   md5(coalesce(doc_id::varchar,'')||':'||coalesce(text,'')) AS key FROM {table}),
 side AS (SELECT greatest(4, ceil(sqrt(greatest(1,count(*))/{mix.rows_per_bucket}.0::double)))::bigint AS s FROM docs),
 total AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST)-1 AS rank FROM docs GROUP BY source),
 weighed AS (SELECT *, {pick(mix.weights, "rank")} AS weight, source_size*{float(mix.most)}::double AS cap FROM total),
 run AS (SELECT *, (sum(source_size) OVER ()-coalesce(sum(cap) OVER w,0))/(sum(weight) OVER ()-coalesce(sum(weight) OVER w,0)) AS unit
   FROM weighed WINDOW w AS (ORDER BY cap/weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 level AS (SELECT min_by(unit, (cap/weight, rank)) FILTER (cap/weight >= unit) AS u FROM run),
 goals AS (SELECT source, source_size, rank, CASE WHEN u IS NULL THEN cap ELSE least(cap, u*weight) END AS target FROM run, level),
 placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x'||substr(key,1,12))::bigint%(SELECT s*s FROM side), key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::bigint AS place FROM docs),
 both_ AS (SELECT p.*, g.source_size, g.target, round(g.target)::bigint AS goal, {begin} AS d0, {end} AS d1 FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
 parts AS (SELECT *, CASE WHEN source_size>0 THEN goal//source_size ELSE 0 END AS passes FROM both_),
 taken AS (SELECT *, greatest(0, least(size, goal-passes*source_size-place)) AS part FROM parts)
SELECT doc_id, size::bigint AS size, source_size, target, (passes*size+part)::bigint AS taken, CASE WHEN size>0 THEN passes+(part>0)::int ELSE 0 END::bigint AS n_passes,
  CASE WHEN size>0 AND passes+(part>0)::int>0 THEN round({spot}, 9) END AS first_position FROM taken"""
