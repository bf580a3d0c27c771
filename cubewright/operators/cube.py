"""The observation cube: one row for each record and each subset of its active dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import all_of, nan_aggregate, nullif_nan, nullif_nonfinite


def dealt(leaf: DataFrame, rec: list[str], partitions: int | None = None) -> DataFrame:
    """Rows by record over a number of partitions (default: as many as shuffles have): partitions that are coalesced by their bytes would expand to gigabytes in a task."""
    return leaf.repartition(partitions or int(leaf.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rec)


def observation_cube(leaf: DataFrame, rec: list[str], dims: list[str], metrics: dict[str, str], weight: str | None = None, tiled: set[str] = frozenset(), spatial: set[str] = frozenset({"dim_x", "dim_y"}), sizes: dict[str, str] | None = None, whole: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """``rec, dims, obs_level`` and the metrics, from leaf rows.

    A dimension is active for a record if it has more than one coordinate there; spatial ones only if the user tiled them.
    ``metrics``: column -> ``sum``, ``min``, ``max``, ``mean`` (weighted by ``weight``, plain where its sum is 0) or ``std:<mean column>``
    (pooled); means and deviations leave NaN and infinities out. ``sizes``: dimension -> column with a block's extent; a fixed dimension keeps it, blocks of different extent
    at one coordinate are an error, and a free one has the full extent (column ``full_<size>`` where there is one, else the largest block). ``whole``: like ``metrics``, for the row of the whole record only.

    Records are dealt over ``partitions`` (default: as many as shuffles have), once: what is known of a record, the expansion and its sums need no other shuffle, and a row is only
    expanded to sets of its record's active dimensions.
    """
    allowed = [d for d in dims if d not in spatial or d in tiled]
    means = {k: m.partition(":")[2] for k, m in metrics.items() if m.startswith("std:")}
    of = Window.partitionBy(*rec)
    facts = {f"__act_{d}": F.min(d).over(of) < F.max(d).over(of) for d in allowed}
    facts |= {f"__mid_{m}": F.avg(nullif_nonfinite(m)).over(of) for m in means.values()}  # pooled squares are taken about it, so that little cancels
    facts |= {f"__full_{c}": F.max(f"full_{c}" if f"full_{c}" in leaf.columns else c).over(of) for c in (sizes or {}).values()}
    joined = dealt(leaf, rec, partitions)
    joined = joined.where(all_of(F.col(c).isNotNull() for c in rec)).withColumns(facts) if facts else joined
    joined = joined.withColumns({d: F.when(F.col(f"__act_{d}"), F.col(d)) if d in allowed else F.lit(None).cast(leaf.schema[d].dataType) for d in dims})
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def aggregate(name: str, how: str) -> Column:
        c = F.col(name)
        if how == "sum":
            return F.sum(c.cast("long") if dict(leaf.dtypes)[name] in ("int", "bigint", "smallint", "tinyint") else nullif_nan(c))
        if how in ("min", "max"):
            return nan_aggregate(F.min if how == "min" else F.max, c)
        v = nullif_nonfinite(c)
        used = F.sum(F.when(v.isNotNull(), w))
        if how == "mean":
            return F.when(used > 0, F.sum(v * w) / used).otherwise(F.avg(v))
        mid, mean = F.col(f"__mid_{means[name]}"), nullif_nonfinite(means[name])
        both = v.isNotNull() & mean.isNotNull()
        used = F.sum(F.when(both, w))
        squares = F.sum(w * (v * v + (mean - mid) * (mean - mid)))
        shift = F.try_divide(F.sum(F.when(both, w * (mean - mid))), used)
        return F.when(used > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares, used) - shift * shift)))

    active = [d for d in dims if d in allowed]
    fixed = {d: F.col("__set").bitwiseAND(1 << i) != 0 for i, d in enumerate(active)}
    cols = [aggregate(k, how).alias(k) for k, how in metrics.items()]
    cols += [aggregate(k, how).alias(f"__whole_{k}") for k, how in (whole or {}).items()]
    for d, c in (sizes or {}).items():
        mixed = F.raise_error(F.concat(F.lit(f"blocks of different {c} at {d} = "), F.coalesce(F.col(d).cast("string"), F.lit("null")))).cast(leaf.schema[c].dataType)
        same = F.when(F.count(c) == 0, F.lit(None)).when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).otherwise(mixed)
        cols.append((F.when(fixed[d], same).otherwise(F.max(f"__full_{c}")) if d in active else F.max(f"__full_{c}")).alias(c))
    level = sum((f.cast("int") for f in fixed.values()), F.lit(0)).cast("int").alias("obs_level")
    if active:
        sets = F.explode(F.array(*map(F.lit, range(1 << len(active)))))
        rows = joined.withColumn("__set", sets).where(all_of(~f | F.col(d).isNotNull() for d, f in fixed.items())).withColumns({d: F.when(f, F.col(d)) for d, f in fixed.items()})
        out = rows.groupBy(*rec, *active, "__set").agg(level, *cols).drop("__set")
        out = out.withColumns({d: F.lit(None).cast(leaf.schema[d].dataType) for d in dims if d not in active}) if len(active) < len(dims) else out
    else:
        out = joined.groupBy(*rec).agg(level, *cols).withColumns({d: F.lit(None).cast(leaf.schema[d].dataType) for d in dims})
    for k in whole or {}:
        out = out.withColumn(k, F.when(F.col("obs_level") == 0, F.col(f"__whole_{k}"))).drop(f"__whole_{k}")
    return out


def registered_cube(leaf: DataFrame, rec: list[str], dims: list[str], names: list[str] | None = None, **options) -> DataFrame:
    """The cube of what the registered metrics gave (``rasters.measure``), each output added up as its metric says.

    Outputs of metrics of scope ``record`` are on the row of the whole record only.
    """
    from .rasters import REGISTRY

    chosen = [m for n, m in REGISTRY.items() if names is None or n in names]
    by = {scope: {k: how for m in chosen if m.scope == scope for k, how in m.aggregates.items()} for scope in ("block", "record")}
    return observation_cube(leaf, rec, dims, by["block"], whole=by["record"], **options)


def merge_histograms(long: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """``keys, lo, hi, bin, n`` of histograms in long form (``lo, hi, bin, n`` for each non-zero bin) over the group's common range.

    A bin's centre decides, an exact edge going to the left bin; a range of one value puts all in bin 0; histograms
    whose bounds agree to 1e-9 are added bin by bin.
    """
    bounds = long.groupBy(*keys).agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"), F.max("lo").alias("__lo2"), F.min("hi").alias("__hi2"))
    j = long.join(bounds, keys)
    centre = F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / bins)
    step = (F.col("__hi") - F.col("__lo")) / bins
    moved = F.ceil(F.try_divide(centre - F.col("__lo"), step)).cast("int") - 1
    alike = (F.col("__lo2") - F.col("__lo") <= 1e-9) & (F.col("__hi") - F.col("__hi2") <= 1e-9)
    bin_ = F.when(F.col("__hi") <= F.col("__lo"), 0).when(alike, F.col("bin")).otherwise(F.least(F.greatest(moved, F.lit(0)), F.lit(bins - 1)))
    return j.select(*keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), bin_.cast("int").alias("bin"), "n").groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n"))


def dense(long: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """One row per key with ``counts`` as an array of ``bins`` numbers."""
    m = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    g = long.groupBy(*keys, "lo", "hi").agg(m.alias("m"))
    return g.withColumn("counts", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))).drop("m")


def across_dims(cube: DataFrame, dims: list[str], dim: str, metrics: list[str], group: str | None = None, use_level: bool = True) -> DataFrame:
    """Mean, deviation and number of each metric for each slice of ``dim``, in long form, with the retention against the fullest slice."""
    from ..functions.scalar import dim_subset

    g = F.col(group) if group else F.lit("all")
    rows = cube.where(dim_subset(dims, split=[dim], use_level=use_level)).select(g.alias("grp"), F.col(dim).alias("slice"), *(F.col(m).cast("double").alias(m) for m in metrics))
    long = rows.unpivot(["grp", "slice"], metrics, "metric", "value")
    stats = long.groupBy("grp", "slice", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n")).where("n > 0")
    return stats.withColumn("retention", F.col("n") / F.max("n").over(Window.partitionBy("grp", "metric")) * 100)
