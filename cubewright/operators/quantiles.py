"""Quantiles of groups of any size: exact ones in two passes, and sketches that can be stored and merged.

Exact: a first pass brackets each quantile by approximate ones around it. A second pass counts the rows below a bracket, with
partial sums, and keeps the values within, a few thousandths of the group; only these are put in order. So a group of all rows is
neither sorted nor held by one task, and results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
#: Rank error of the approximate quantiles (1 in ACCURACY), how far from a quantile its bracket reaches, and the rows up to which all values are kept.
ACCURACY, REACH, SMALL = 10_000, 3e-4, 20_000


def exact_quantiles(long: DataFrame, keys: list[str], value: str, facts: dict[str, Column] | None = None, at: tuple[float, ...] = QUARTILES) -> DataFrame:
    """``keys, n, q`` (an array, interpolated between neighbours) and the aggregates of ``facts``. Null values don't count; keys are not null."""
    known = long.where(F.col(value).isNotNull())
    around = sorted({min(1.0, max(0.0, p + d)) for p in at for d in (-REACH, REACH)})
    edges = F.percentile_approx(value, around, ACCURACY).alias("__edges")
    groups = known.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (facts or {}).items()), edges)
    # what is known of a group goes with its rows, so that it is worked out once
    known_of = F.struct("n", *(facts or {})).alias("__of")
    j = known.select(*keys, F.col(value).alias("__v")).join(groups.select(*keys, known_of, "__edges"), keys)
    v, n = F.col("__v"), F.col("__of.n")
    part = F.size(F.filter("__edges", lambda e: e <= v))  # edges at or below the value
    inside = n <= SMALL
    for p in at:
        lo, hi = (1 + around.index(min(1.0, max(0.0, p + d))) for d in (-REACH, REACH))
        inside |= (v >= F.element_at("__edges", lo)) & (v <= F.element_at("__edges", hi))
    cells = j.select(*keys, "__of", part.alias("__part"), F.when(inside, v).alias("__v")).groupBy(*keys, "__of", "__part", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part", F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    place = lambda p: F.lit(p) * (n - 1)
    picks = []
    for i, p in enumerate(at):
        for name, rank in (("lo", F.floor(place(p))), ("hi", F.ceil(place(p)))):
            held = (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
            picks.append(F.max(F.when(held, v)).alias(f"__{name}{i}"))
    found = cells.withColumn("__upto", upto).where("__v is not null").groupBy(*keys, "__of").agg(*picks)
    missed = F.raise_error(F.lit("a quantile is outside its bracket")).cast("double")
    q = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (place(p) - F.floor(place(p))) for i, p in enumerate(at)]
    whole = [F.when(F.col(f"__lo{i}").isNull() | F.col(f"__hi{i}").isNull(), missed).otherwise(c) for i, c in enumerate(q)]
    return found.select(*keys, "__of.*", F.array(*whole).alias("q"))


def sketches(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, min, max, total, sketch``: what is stored of a group, to be merged with others (``merged_sketches``)."""
    v = F.col(value).cast("double")
    return long.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v).alias("sketch"))


def merged_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(stored: DataFrame, keys: list[str], at: tuple[float, ...] = QUARTILES) -> DataFrame:
    """``keys, n, min, max, mean, q`` of stored sketches; a quantile is off by about 1.3 % of the rank."""
    q = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in at))
    return stored.select(*keys, "n", "min", "max", (F.col("total") / F.col("n")).alias("mean"), q.alias("q"))
