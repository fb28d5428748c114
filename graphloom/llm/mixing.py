"""Mixing sources to target weights.

Sizes are words. Sources, by code point with null last, take the weights in turn; the targets
share the total of all sizes by weight, none above `max_epochs` times its source's size: what
is above is shared anew by weight among the others until none is. A source's rate is its
target over its size. A document is emitted floor(rate) times, plus one Bernoulli copy whose
probability is the rate's fraction: copy if u < fraction, u in [0, 1) from an MD5 of doc_id
and seed, turned by a shift that its source shares: u = frac(hash + shift / SHIFTS). Any shift
leaves u uniform; each source takes, of SHIFTS, the one whose taken words come nearest its
target. Nothing is random: reruns, retried tasks and other partitionings agree.

Levels in closed form: with sources in the order of cap/weight, those capped are a prefix;
the level at which the rest share is (total - caps before) / (weights from here on) at the
first source that isn't. Running sums over the table of sources give it, without a loop; the
window has one row per source, spills, and never visits the driver. These windows are over all
sources, in one task: meant for sources as they are named in a mix, up to millions, not for one
per page.

Plan: sizes are counted once and cut to the shared folder as narrow rows (doc_id, source,
size). Totals and the shifts' sums are aggregations with map-side partial sums: a source with
a third of all rows sends one row per map task. The table of sources joins back by Spark's
own choice: broadcast below spark.sql.autoBroadcastJoinThreshold, else a sort-merge join
whose hot partitions AQE splits.

Defined results: null text is size 0; null source is a source of its own, last; a source of
size 0 has target 0; with a total of 0 all targets are 0; rows with the same doc_id are each
mixed, with the same u; columns with any other names pass through `emit`; empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from graphloom.llm.common import count_words, cut, fresh, read

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SHIFTS = 32
SEED = "mix-1"


def unit_hash(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1): 48 bits of MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(u: Column, shift: Column, rate: Column) -> Column:
    turned = u + shift / F.lit(float(SHIFTS))
    turned = F.when(turned >= 1, turned - 1).otherwise(turned)
    return (F.floor(rate) + F.when(turned < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals (source, source_size) with weight, target and rate."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*by).rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / F.sum("weight").over(after).cast("double"))
    t = t.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.coalesce(F.max(F.when(~F.col("capped"), F.col("level"))).over(everything), F.lit(0.0))
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.withColumn("rate", rate).select("source", "source_size", "target", "rate")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: source, source_size, target, rate, shift. sizes: doc_id, source, size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = cut(targets(totals, weights, max_epochs), "mix-targets")
    a, s = aimed.alias("a"), sizes.alias("s")
    rows = s.join(a, F.col("s.source").eqNullSafe(F.col("a.source"))).select("a.*", "s.size", unit_hash(F.col("s.doc_id"), seed).alias("u"))
    tried = rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS - 1))))
    taken = tried.groupBy("source", "source_size", "target", "rate", "shift").agg(F.sum(F.col("size") * copies(F.col("u"), F.col("shift"), F.col("rate"))).alias("taken"))
    best = F.min(F.struct(F.abs(F.col("taken") - F.col("target")).alias("off"), "shift")).alias("best")
    out = taken.groupBy("source", "source_size", "target", "rate").agg(best)
    return cut(out.select("source", "source_size", "target", "rate", F.col("best.shift").alias("shift")), "mix-plan")


def sizes_of(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    return cut(docs.select("doc_id", F.col(source).alias("source"), count_words(F.col(text)).alias("size")), "mix-sizes", compact=True)


def decide(sizes: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    s, p = sizes.alias("s"), planned.alias("p")
    n = copies(unit_hash(F.col("s.doc_id"), seed), F.col("p.shift"), F.col("p.rate"))
    return s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")), "left").select("s.doc_id", "s.size", "p.source_size", "p.target", (F.col("s.size") * n).alias("taken"))


def emit(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns."""
    own, rate, shift, n, copy = (fresh(docs.columns, c) for c in ("_source", "_rate", "_shift", "_n", "_copy"))
    planned = plan(sizes_of(docs, text, source), weights, max_epochs, seed).select(F.col("source").alias(own), F.col("rate").alias(rate), F.col("shift").alias(shift))
    joined = docs.join(planned, F.col(source).eqNullSafe(F.col(own)))
    repeated = joined.withColumn(n, copies(unit_hash(F.col("doc_id"), seed), F.col(shift), F.col(rate)).cast("int")).where(F.col(n) > 0)
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(copy)).drop(copy)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(read(spark, sf_dir, "documents"))
    return decide(sizes, plan(sizes))


def mix_sql(table: str) -> str:
    """CTEs ending in `taken_rows` (doc_id, size, source, source_size, target, n) over table."""
    return f"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 12))::BIGINT / {1 << 48}.0::DOUBLE AS u FROM {table}
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * {MAX_EPOCHS} AS cap FROM totals
), levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM weighed
), aimed AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE coalesce(max(CASE WHEN cap > level * weight THEN level END) OVER (), 0.0) * weight END AS target FROM levels
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed
), tried AS (
  SELECT s.doc_id, s.size, r.*, shift, (floor(rate) + CASE WHEN (CASE WHEN u + shift / {SHIFTS}.0::DOUBLE >= 1 THEN u + shift / {SHIFTS}.0::DOUBLE - 1 ELSE u + shift / {SHIFTS}.0::DOUBLE END) < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS n
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, range({SHIFTS}) AS x(shift)
), chosen AS (
  SELECT source, arg_min(shift, (off, shift)) AS shift FROM (SELECT source, shift, abs(sum(size * n) - any_value(target)) AS off FROM tried GROUP BY source, shift) GROUP BY source
), taken_rows AS (
  SELECT t.doc_id, t.size, t.source, t.source_size, t.target, t.n FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.shift = c.shift
)"""


OP6_SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken FROM taken_rows"
