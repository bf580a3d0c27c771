"""Mixing sources to target weights.

Each source gets a share of all words by weight, but at most ``most`` times what it has; what is over goes to the
others by weight until none is above. A document is emitted ``floor(rate)`` times, and once more with the fraction as
probability, drawn from a hash of its id, so that reruns agree.

Edge cases: null and empty texts have size 0 (they are emitted like others and take nothing); a null source is a source of
its own, last in order; repeated rows get the same number of copies; documents without an id draw by a hash of
their text; an empty table gives an empty result; other columns pass through ``mixed``; ``mix_plan`` replaces a column that has a
result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, fresh, written

#: Sources up to which the table of targets is broadcast.
BROADCAST_ROWS = 20_000


def n_words(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source. The table has one row a source, not a document.

    Filling by weight up to a cap: in ascending order of cap over weight, the first source that its share of what is left doesn't fill sets the level.
    """
    alphabetic = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(alphabetic) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
                     .over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


#: What ``mix_plan`` adds.
PLAN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 42, into: tuple[str, ...] = PLAN) -> DataFrame:
    """All columns of ``docs`` with a document's size, its source's size and target, and how often it is taken, named by ``into``."""
    size, source_size, target, taken = into
    docs = docs.drop(*into)
    (key_source,) = fresh(docs, "source")
    sized = docs.withColumn(size, n_words())
    sums = sized.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("source_size"))
    targets = bounded(written(source_targets(sums, weights, most), "targets"), BROADCAST_ROWS)
    targets = targets.select(F.col("source").alias(key_source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(1.0)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    joined = sized.join(targets, F.col("source").cast("string").eqNullSafe(F.col(key_source)))
    return joined.withColumn(taken, copies.cast("int")).drop(key_source)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as the plan says."""
    into = fresh(docs, *PLAN, "copy")
    plan = mix_plan(docs, into=tuple(into[:4]), **options).where(F.col(into[3]) > 0)
    return plan.withColumn(into[4], F.explode(F.sequence(F.lit(1), F.col(into[3])))).select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ()
      - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap))::DOUBLE AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate,
      ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
