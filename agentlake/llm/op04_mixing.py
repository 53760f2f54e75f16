r"""Mixing sources to target weights [native]: Pareto order sampling, by DataFrame expressions alone.

Each source gets a target in words: the weights share ``ratio`` times all words, no target above ``cap``
times its source, what is cut off shared again by weight.  A source whose target is 1.4 times its size
takes every document once (certain whole copies) and the other 0.4 by a fixed-size sample of unequal
probabilities: a document of inclusion probability p and random number u has rank
``u/(1-u) / (p/(1-p))``, and the lowest ranks are taken until the words are reached; the last document is
cut so that they are met.  p is in proportion to ``preference``, with the factor at which the expected words
are the ones wanted; where that would pass 1, the document is taken for certain and the factor is found anew
for the rest.  With the default preference, the number of binary digits of the size, very short texts are
repeated less often.

No source is ordered as a whole: ranks fall into ``BUCKETS`` ranges whose word counts are summed, and only
the one range per source that holds the cut is sorted.  What decides about a document is then one row per
source, so texts are not shuffled.  Targets are found over one row per source in one task, and factors over
one row per source and preference: both are tables of sums, meant for up to some hundred thousand sources.

Defined results: a null text has size 0; a null source is a source of its own, after the others; a source
of no words has target 0; rows that agree in id and size share what falls to them evenly; an empty table
gives no rows; other columns, whatever their names, are kept by ``mix`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, RATIO, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"
BUCKETS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_size() -> Column:
    """The default preference: 1 for an empty text, one more with each doubling of the size."""
    return F.length(F.bin("size")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """One row per source: source_size, target, whole (certain copies), quota (words left to sample)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    shares = totals.withColumn("weight", w).withColumn("limit", F.col("source_size") * cap).withColumn("budget", F.sum("source_size").over(everything) * ratio)
    # Sources reach their limits in the order of limit by weight: the level is the first that its own source stays under.
    by_reach = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, rest = by_reach.rowsBetween(Window.unboundedPreceding, -1), by_reach.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(earlier), F.lit(0))) / F.sum("weight").over(rest)
    levels = shares.withColumn("level", level).withColumn("at", F.row_number().over(by_reach))
    water = F.min_by("level", F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("at"))).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        levels.withColumn("water", water).withColumn("target", target).withColumn("whole", whole)
        .withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "quota")
    )


def with_factors(sized: DataFrame, targets: DataFrame, preference: Column | None = None) -> DataFrame:
    """``targets`` with certain_above and factor: a document is in the sample for certain if its preference (whole, at
    least 1) is above the one, and with the other times its preference as probability otherwise."""
    sums = sized.withColumn("pref", by_size() if preference is None else preference).groupBy("source", "pref").agg(F.sum("size").alias("words")).alias("w")
    known = sums.join(targets.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source"))).select("w.*", "t.quota")
    falling = Window.partitionBy("source").orderBy(F.col("pref").desc())
    left = F.col("quota") - F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("pref")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    open_ = known.withColumn("left", left).withColumn("rest", rest).where("left * pref < rest")
    found = open_.groupBy(F.col("source").alias("s")).agg(F.max("pref").alias("certain_above"), F.max_by(F.col("left") / F.col("rest"), "pref").alias("factor"))
    return targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def with_rank(docs: DataFrame, targets: DataFrame, preference: Column | None = None, seed: str = SEED) -> DataFrame:
    """Adds the columns of ``targets`` and ``rank``: the Pareto rank r, as r / (1 + r), between 0 and 1."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(2**52)
    own = by_size() if preference is None else preference
    certain = F.col("certain_above").isNull() | (own > F.col("certain_above"))
    p = F.least(F.col("factor") * own, F.lit(1 - 1e-12))
    odds = lambda x: x / (1 - x)
    joined = docs.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    return joined.withColumn("rank", F.when(F.col("source_size") == 0, 0.5).when(certain, 0.0).otherwise(odds(u) / (odds(u) + odds(p))))


def sampling_cuts(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the rank, id and size at which each source's sample ends, and the words that a row there takes."""
    ranked = ranked.where("quota > 0").withColumn("bucket", F.floor(F.col("rank") * BUCKETS))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    at = sums.withColumn("until", F.sum("words").over(so_far)).where("until >= quota and until - words < quota").select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("until") - F.col("words")).alias("before"))
    near = ranked.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ties = near.groupBy("source", "rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("quota").alias("quota"), F.first("before").alias("before"))
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    until = F.col("before") + F.sum(F.col("size") * F.col("rows")).over(inside)
    cut = (
        ties.withColumn("until", until).withColumn("from", F.col("until") - F.col("size") * F.col("rows"))
        .where("until >= quota and from < quota")
        .select(F.col("source").alias("s"), F.col("rank").alias("cut_rank"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("quota") - F.col("from")) / F.col("rows")).alias("cut_words"))
    )
    return targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def decide(ranked: DataFrame) -> DataFrame:
    """Adds copies (whole ones), cut_words (of one more, unfinished copy) and taken."""
    here = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("size") == F.col("cut_size"))
    lower = F.struct("rank", "doc_id", "size") < F.struct("cut_rank", "cut_id", "cut_size")
    more = F.coalesce(F.when(here & (F.col("rank") == F.col("cut_rank")), 0).when(lower, 1), F.lit(0))
    words = F.when(here & (F.col("rank") == F.col("cut_rank")), F.col("cut_words")).otherwise(0)
    whole = F.col("whole") + more
    return ranked.withColumns({"copies": whole, "cut_words": F.coalesce(words, F.lit(0)).cast("long")}).withColumn("taken", F.col("copies") * F.col("size") + F.col("cut_words"))


def _cuts(docs: DataFrame, weights: tuple[int, ...], ratio: float, cap: int, seed: str, preference: Column | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size of all rows; what decides about them, one row per source)."""
    measured = staged(docs.select("doc_id", "source", word_count().alias("size")))
    targets = staged(with_factors(measured, source_targets(measured, weights, ratio, cap), preference))
    return measured, staged(sampling_cuts(with_rank(measured, targets, preference, seed), targets))


def mixing(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED, preference: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, cut_words, taken of every row of ``docs``."""
    measured, cuts = _cuts(docs, weights, ratio, cap, seed, preference)
    return decide(with_rank(measured, cuts, preference, seed)).select("doc_id", "source", "size", "source_size", "target", "copies", "cut_words", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED, preference: Column | None = None) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated as decided; ``text`` is cut behind the last word taken."""
    _, cuts = _cuts(docs, weights, ratio, cap, seed, preference)
    packed = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*docs.columns).alias("row"))
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    cut = F.array_join(F.slice(F.split("row.text", F.lit(ends), -1), F.lit(1), F.greatest(F.col("cut_words").cast("int"), F.lit(1))), "")
    copies = F.array_repeat(F.col("row.text"), F.col("copies").cast("int"))
    parts = F.when(F.col("cut_words") > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    taken = decide(with_rank(packed, cuts, preference, seed)).select("row", F.explode(parts).alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new")}
    return taken.select(*(new.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), shares as (
  select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, source_size * 2 as reach,
    sum(source_size) over () * 1.5::double as budget from totals
), levels as (
  select *, row_number() over o as turn,
    (budget - coalesce(sum(reach) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as level
  from shares window o as (order by reach::double / weight, source nulls last)
), water as (
  select *, arg_min(level, case when level <= reach::double / weight then turn end) over () as water from levels
), targets as (
  select *, least(reach::double, coalesce(water, 'infinity'::double) * weight) as target from water
), wholes as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets
), quotas as (
  select *, round(target)::bigint - whole * source_size as quota from wholes
), sums_by_pref as (
  select source, length(bin(size)) as pref, sum(size)::bigint as words from sized group by all
), open_ as (
  select w.source, pref, quota - coalesce(sum(words) over (f rows between unbounded preceding and 1 preceding), 0) as left_,
    sum(words * pref) over (f rows between current row and unbounded following) as rest
  from sums_by_pref w join quotas q on w.source is not distinct from q.source window f as (partition by w.source order by pref desc)
), factors as (
  select source, max(pref) as certain_above, arg_max(left_::double / rest::double, pref) as factor from open_ where left_ * pref < rest group by source
), chances as (
  select s.doc_id, s.size, q.*, (('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u,
    certain_above is null or length(bin(s.size)) > certain_above as certain, least(factor * length(bin(s.size)), (1 - 1e-12)::double) as p
  from sized s join quotas q on s.source is not distinct from q.source left join factors f on s.source is not distinct from f.source
), ranks as (
  select *, case when source_size = 0 then 0.5::double when certain then 0::double else (u / (1 - u)) / (u / (1 - u) + p / (1 - p)) end as rank from chances
), sums as (
  select *, sum(size) over (partition by source order by rank, doc_id, size rows unbounded preceding) as until from ranks
)
select doc_id, size, source_size, target,
  (whole * size + case when quota <= 0 then 0 when until < quota then size when until - size < quota then quota - (until - size) else 0 end)::bigint as taken,
  (whole + case when quota > 0 and until < quota then 1 else 0 end)::bigint as copies,
  (case when quota > 0 and until >= quota and until - size < quota then quota - (until - size) else 0 end)::bigint as cut_words
from sums""",
}
