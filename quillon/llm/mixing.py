"""Mixing sources to target weights by repetition, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.storage import materialize, table, unused

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = 17


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null. Splitting is linear, where counting matches copies the text for each of them."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row for each source of sizes(source, size): source, source_size, target.

    Sources in code-point order, null last, weigh weights in turn. All targets add up to all sizes. A target stops at
    max_repeat times its source's size; the excess is shared again by weight until no target is above. That end state
    is target = min(max_repeat * size, level * weight) with one level for all, so no loop is needed: in order of
    max_repeat * size / weight, the capped sources are a prefix, and the level follows from the prefix sums.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_open": F.sum("_weight").over(after),
    }).withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    # the first source that stays below its cap sets the level
    level = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level")))).over(everything)
    per = per.withColumn("_at", level[F.lit("_level")])
    return per.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("_weight")), F.lit(0.0)).alias("target"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the id: the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(size: Column, source_size: Column, target: Column, doc_id: Column, seed: int = SEED) -> Column:
    """floor(rate) copies and one more with the fraction as its probability; rate = target / source_size."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and _copies.

    docs needs doc_id, text and source; any may be null, other columns are ignored. Null sources are one source.
    Rows with the same doc_id draw alike. An empty table gives no rows. Only the counts are kept between the two
    passes (sums per source, then copies), in a table in the shared folder.
    """
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes).withColumnRenamed("source", "_source")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "size", "source_size", "target", copies(F.col("size"), F.col("source_size"), F.col("target"), F.col("doc_id"), seed).alias("_copies"))


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; its columns, whatever their names, and their order stay.

    The defined results are those of mixing_plan. Rows that the mix takes 0 times go.
    """
    size, of, total, target, number, copy = (unused(docs, f"__mix_{c}") for c in ("size", "source", "total", "target", "n", "copy"))
    sized = docs.withColumn(size, n_words(F.col("text")))
    targets = source_targets(docs.select("source", n_words(F.col("text")).alias("size")))
    targets = targets.select(F.col("source").alias(of), F.col("source_size").alias(total), F.col("target").alias(target))
    joined = sized.join(targets, sized["source"].eqNullSafe(F.col(of)))
    n = copies(F.col(size), F.col(total), F.col(target), sized["doc_id"], seed)
    repeated = joined.withColumn(number, n).filter(F.col(number) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number).cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
         source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::BIGINT AS total FROM per
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), fixed AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE cap >= level * w
), targets AS (
  SELECT source, source_size, coalesce(least(cap, fixed.level * w), 0::DOUBLE) AS target FROM levels, fixed
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
