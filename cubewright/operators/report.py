"""Report operators on the observation table. Each gives a DataFrame; nothing is drawn here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ancestors, any_of, dtype_kind, dtype_scale, missing, nullif_nan
from .quantiles import exact_quantiles


def grouped(df: DataFrame, group: str | None) -> DataFrame:
    """``df`` with the group in ``grp`` (``all`` without one)."""
    return df.withColumn("grp", missing(group) if group else F.lit("all"))


# -- counts and sizes ---------------------------------------------------------------------------------------------


def summary(df: DataFrame, group: str | None = None, images: str | None = None) -> DataFrame:
    """Files, bytes, extensions and images of each group, and of all (``grp`` null)."""
    g = grouped(df, group)
    n = F.sum(images) if images else F.count("*")
    return g.groupingSets([["grp"], []], "grp").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set("file_extension")), ",").alias("extensions"), n.alias("n_images"), F.count_distinct("path").alias("n_paths"))


def uneven_groups(df: DataFrame, group: str, ratio: float = 1.5) -> DataFrame:
    n = grouped(df, group).groupBy("grp").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio")).withColumn("flagged", F.col("ratio") >= ratio)


def extension_counts(df: DataFrame, group: str | None = None) -> DataFrame:
    return grouped(df, group).groupBy("file_extension", "grp").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def category_counts(df: DataFrame, category: str, group: str | None = None) -> DataFrame:
    """Rows by category (``(missing)`` for null) and group."""
    return grouped(df, group).groupBy(missing(category).alias("category"), "grp").agg(F.count("*").alias("n"))


def category_kind(df: DataFrame, category: str) -> DataFrame:
    n = F.count_distinct(category)
    return df.agg(n.alias("n_values")).withColumn("kind", F.when(F.col("n_values") == 0, "empty").when(F.col("n_values") == 1, "invariant").otherwise("chart"))


def size_histogram(df: DataFrame, size: str = "size_bytes", group: str | None = None, most: int = 20) -> DataFrame:
    """``bin, lo, hi, grp, n``: at most ``most`` bins, log-spaced if the largest is 30 times the smallest positive size or more."""
    s = F.col(size).cast("double")
    b = df.agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.min(F.when(s > 0, s)).alias("pos"), F.least(F.count_distinct(s), F.lit(most)).alias("k"))  # one row
    j = grouped(df, group).crossJoin(F.broadcast(b)).where(s.isNotNull())
    log = F.coalesce(F.col("hi") / F.col("pos") >= 30, F.lit(False))
    place = F.when(F.col("hi") <= F.col("lo"), 0.0).when(log, F.when(s <= F.col("pos"), 0.0).otherwise((F.log10(s) - F.log10("pos")) / (F.log10("hi") - F.log10("pos")) * F.col("k"))).otherwise((s - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k"))
    bin_ = F.least(F.floor(F.round(place, 9)), F.col("k") - 1).cast("int")
    edge = lambda i: F.when(log, F.pow(F.lit(10.0), F.log10("pos") + (F.log10("hi") - F.log10("pos")) * i / F.col("k"))).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.col("k"))
    return j.withColumn("bin", bin_).groupBy("bin", edge(F.col("bin")).alias("lo_edge"), edge(F.col("bin") + 1).alias("hi_edge"), "grp").agg(F.count("*").alias("n"))


def timeline(df: DataFrame, ts: str, group: str | None = None, unit: str | None = None) -> DataFrame:
    """``unit, bucket, grp, n``: by ``unit``, or without one by month beyond 20 days, else day, hour, minute or second by the span; one bucket ``invariant`` below a second."""
    at = F.col(ts).cast("timestamp")
    span = F.unix_millis(F.max(at)) - F.unix_millis(F.min(at))
    days = F.count_distinct(F.date_format(ts, "yyyy-MM-dd"))
    b = df.agg(span.alias("span"), days.alias("days"))  # one row
    fmt = F.when(F.col("span") < 1000, "invariant").when(F.col("days") > 20, "month").when(F.col("span") >= 86_400_000, "day").when(F.col("span") >= 3_600_000, "hour").when(F.col("span") >= 60_000, "minute").otherwise("second")
    j = grouped(df, group).withColumn("unit", F.lit(unit)) if unit else grouped(df, group).crossJoin(F.broadcast(b.select(fmt.alias("unit"))))
    shapes = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss"}
    bucket = reduce(lambda acc, x: acc.when(F.col("unit") == x[0], F.date_format(ts, x[1])), shapes.items(), F.when(F.col("unit") == "invariant", "invariant"))
    return j.where(F.col(ts).isNotNull()).groupBy("unit", bucket.alias("bucket"), "grp").agg(F.count("*").alias("n"))


# -- columns ------------------------------------------------------------------------------------------------------


def _per_column(df: DataFrame, columns: list[str], distinct: str | None = None, **facts) -> DataFrame:
    """One row per column with the given aggregates, from a single pass; ``distinct``: a name for how many values there are, after ``column`` (``distinct_counts``)."""
    cells = [F.struct(F.lit(c).alias("column"), *(f(c).alias(k) for k, f in facts.items())).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.agg(F.count("*").alias("__n"), *cells).select(F.explode(F.array(*(f"c{i}" for i in range(len(columns))))).alias("x")).select("x.*")
    if not distinct:
        return rows
    counts = F.broadcast(distinct_counts(df, columns, distinct))  # one row a column
    return rows.join(counts, "column", "left").select("column", F.coalesce(distinct, F.lit(0).cast("long")).alias(distinct), *facts)


def distinct_counts(df: DataFrame, columns: list[str], name: str = "n_distinct") -> DataFrame:
    """``column`` and how many values it has, of those that have any.

    All columns in one pass: a row gives its values as (column, value), which are counted where they are read and then once for all. A copy of
    the row for each column, as several distinct counts in one aggregation would make, carries all of them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        if isinstance(types[c], T.DoubleType | T.FloatType):
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # no zero below zero
        return F.to_json(F.struct(x.alias("x"))) if isinstance(types[c], T.ArrayType | T.StructType | T.MapType) else x.cast("string")

    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`").isNotNull(), text(c)).alias("value")) for c in columns))
    each = df.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one"))
    return each.groupBy("column").agg(F.count("*").alias(name))


def inconsistencies(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, "n_distinct").withColumn("flagged", F.col("n_distinct") > 1)


def constants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns without null that hold one value, and that value as text."""
    one = lambda c: F.when((F.count("*") == F.count(c)) & (F.min(c) == F.max(c)), F.min(F.col(c).cast("string")))
    return _per_column(df, columns, value=one).where("value is not null")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value of each column as text and how often it occurs; of several the least by code point; nulls don't count."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best")).select("column", F.col("best.value").alias("mode"), (-F.col("best.m")).alias("n"))


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, present=F.count, total=lambda c: F.count("*")).withColumn("pct", F.try_divide(F.col("present") * 100, "total"))


def size_availability(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, n_over_one=lambda c: F.count_if(F.col(c) > 1))


def varying_dims(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct sizes and the smallest of each size column; ``ragged``: over 1 in some records only."""
    over = lambda c: F.count_if(F.col(c) > 1)
    out = _per_column(df, columns, "n_distinct", least=lambda c: F.min(F.col(c).cast("double")), n_over=over, total=lambda c: F.count("*"))
    return out.select("column", "n_distinct", "least", (F.col("n_distinct") > 1).alias("varies"), ((F.col("n_over") > 0) & (F.col("n_over") < F.col("total"))).alias("ragged"))


def role(f: T.StructField) -> str:
    """metric, dim, group, date or blob, by name and type."""
    if f.name.startswith("dim_") or f.name == "obs_level":
        return "dim"
    if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "date"
    if isinstance(f.dataType, T.NumericType):
        return "metric"
    return "group" if isinstance(f.dataType, T.StringType | T.BooleanType) else "blob"


def column_profile(df: DataFrame) -> DataFrame:
    """Type, role, nulls and distinct values of each column."""
    fields = [f for f in df.schema.fields if role(f) != "blob"]
    out = _per_column(df, [f.name for f in fields], n=lambda c: F.count("*"), n_null=lambda c: F.count("*") - F.count(c), distinct="n_distinct")
    roles = F.create_map(*(F.lit(x) for f in fields for x in (f.name, role(f))))
    return out.withColumn("role", roles[F.col("column")])


def group_candidates(df: DataFrame, columns: list[str], least: int = 2, most: int = 12) -> DataFrame:
    return _per_column(df, columns, "n_distinct").where(F.col("n_distinct").between(least, most))


def dim_domain(cube: DataFrame, dims: list[str]) -> DataFrame:
    """Sorted distinct coordinates of each dimension, as text."""
    return _per_column(cube, dims, distinct="n", domain=lambda c: F.array_join(F.array_sort(F.collect_set(c)), ","))


def quality_checks(df: DataFrame, group: str, same: list[str], sizes: list[str] = (), ragged: list[str] = (), needed: list[str] = ()) -> DataFrame:
    """``check, value, threshold, flagged``: extensions, group imbalance, columns that should agree, size columns that only some records have over 1 (``ragged``), and columns
    that should be there in each row, such as a histogram's (``needed``)."""
    ext = df.agg(F.count_distinct("file_extension").cast("double").alias("value")).select(F.lit("extensions").alias("check"), "value", F.lit(1.0).alias("threshold"), (F.col("value") > 1).alias("flagged"))
    even = uneven_groups(df, group).select(F.lit("group_imbalance").alias("check"), F.col("ratio").alias("value"), F.lit(1.5).alias("threshold"), "flagged")
    mixed = inconsistencies(df, [*same, *sizes]).select(F.concat(F.lit("mixed_"), "column").alias("check"), F.col("n_distinct").cast("double").alias("value"), F.lit(1.0).alias("threshold"), "flagged")
    out = ext.unionByName(even).unionByName(mixed)
    if ragged:
        some = varying_dims(df, list(ragged))
        out = out.unionByName(some.select(F.concat(F.lit("ragged_"), "column").alias("check"), F.col("ragged").cast("double").alias("value"), F.lit(0.0).alias("threshold"), F.col("ragged").alias("flagged")))
    if needed:
        out = out.unionByName(null_counts(df, list(needed)).select(F.concat(F.lit("missing_"), "column").alias("check"), F.col("n_null").cast("double").alias("value"), F.lit(0.0).alias("threshold"), (F.col("n_null") > 0).alias("flagged")))
    return out


def default_group(df: DataFrame, short: str = "imported_path_short", name: str = "name", least: int = 2, most: int = 12, rows: int = 4) -> DataFrame:
    """One row ``column``: the folder label if there is one, the name in a table of ``rows`` rows at most, else the first column with few values; null if none has."""
    if short in df.columns:
        return df.sparkSession.createDataFrame([(short,)], "column string")
    columns = [f.name for f in df.schema.fields if role(f) == "group" and f.name != name]
    n = df.agg(F.count("*").alias("n"))  # one row
    few = F.lit(None).cast("string")
    if columns:
        place = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (c, i)))
        first = distinct_counts(df, columns).where(F.col("n_distinct").between(least, most)).agg(F.min_by("column", place[F.col("column")]).alias("few"))
        n, few = n.crossJoin(F.broadcast(first)), F.col("few")  # one row
    if name in df.columns:
        few = F.when(F.col("n") <= rows, F.lit(name)).otherwise(few)
    return n.select(few.alias("column"))


# -- distributions ------------------------------------------------------------------------------------------------


def box_stats(df: DataFrame, metrics: list[str], group: str | None = None, category: str | None = None) -> DataFrame:
    """``grp[, category], metric, n, min, max, mean, std, q25, q50, q75``; metrics without a value are dropped. All metrics together; quartiles are exact at any size (``quantiles``)."""
    g = grouped(df, group)
    keys = ["grp"] + (["category"] if category else [])
    g = g.withColumn("category", missing(category)) if category else g
    long = g.select(*keys, *(nullif_nan(F.col(m).cast("double")).alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "v")
    out = exact_quantiles(long, [*keys, "metric"], "v", {"min": F.min("v"), "max": F.max("v"), "mean": F.avg("v"), "std": F.stddev("v")})
    return out.select("*", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75)))).drop("q")


def distribution(df: DataFrame, metrics: list[str], group: str | None = None, raw_rows: int = 5000) -> DataFrame:
    """Box statistics with ``mode``: ``points`` where all groups have ``raw_rows`` rows at most, ``invariant`` where a metric doesn't vary, else ``box``."""
    b = box_stats(df, metrics, group)
    w = Window.partitionBy("metric")
    return b.withColumn("mode", F.when(F.min("min").over(w) == F.max("max").over(w), "invariant").when(F.sum("n").over(w) <= raw_rows, "points").otherwise("box"))


def raw_points(df: DataFrame, metrics: list[str], group: str | None = None, raw_rows: int = 5000) -> DataFrame:
    """``grp, metric, value`` of the metrics that have ``raw_rows`` values at most and vary: what ``distribution`` calls ``points``."""
    long = grouped(df, group).select("grp", *(nullif_nan(F.col(m).cast("double")).alias(m) for m in metrics)).unpivot(["grp"], metrics, "metric", "value").where("value is not null")
    few = long.groupBy("metric").agg(F.count("*").alias("n"), (F.min("value") < F.max("value")).alias("varies")).where((F.col("n") <= raw_rows) & F.col("varies"))
    return long.join(F.broadcast(few.select("metric")), "metric").select("grp", "metric", "value")  # one row a metric


def bubble(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    return grouped(df.where((F.col(x) > 1) & (F.col(y) > 1)), group).groupBy(F.col(x).alias("x"), F.col(y).alias("y"), "grp").agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, x: str, y: str, cells: int = 70) -> DataFrame:
    """``x, y, n, log_n``: bins of at least 1, about ``cells`` along each axis."""
    b = df.agg(*(f(c).cast("double").alias(f"{n}{a}") for a, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))))  # one row
    j = df.crossJoin(F.broadcast(b))
    step = lambda a: F.greatest(F.lit(1.0), F.ceil((F.col(f"hi{a}") - F.col(f"lo{a}")) / cells))
    at = lambda c, a: F.floor((F.col(c) - F.col(f"lo{a}")) / step(a)) * step(a) + F.col(f"lo{a}")
    return j.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(at(x, "x").alias("x"), at(y, "y").alias("y")).agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))


def category_heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts of all combinations of the categories that occur, 0 where none."""
    n = df.groupBy(missing(x).alias("x"), missing(y).alias("y")).agg(F.count("*").alias("n"))
    grid = n.select("x").distinct().crossJoin(n.select("y").distinct())  # categories of a chart, not rows
    return grid.join(n, ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_numbers(df: DataFrame, category: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(missing(category).alias("category")).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def number_by_constant(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col(x).isNull()).alias("n_null"), F.min(x).alias("min"), F.max(x).alias("max"))


def pair_profile(df: DataFrame, x: str, y: str, categories: int = 30) -> DataFrame:
    """Distinct values of two columns, whether they are numbers, and the chart that suits them."""
    number = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    four = df.select(F.col(x).alias("n_x"), F.col(y).alias("n_y"), missing(x).alias("n_x_missing"), missing(y).alias("n_y_missing"))
    counts = distinct_counts(four, four.columns)
    of = [F.coalesce(F.max(F.when(F.col("column") == c, F.col("n_distinct"))), F.lit(0).cast("long")).alias(c) for c in four.columns]
    r = counts.agg(*of).crossJoin(F.broadcast(df.agg(F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("n_null"))))  # one row each
    few = (F.col("n_x_missing") <= categories, F.col("n_y_missing") <= categories)
    if number[x] and number[y]:
        kind = F.when(F.least("n_x", "n_y") <= 1, "table").otherwise("scatter")
    elif number[x] or number[y]:
        kind = F.when(few[1] if number[x] else few[0], "box").otherwise("table")
    else:
        kind = F.when(few[0] & few[1], "heatmap").otherwise("table")
    return r.withColumn("kind", kind)


def plot_kind(df: DataFrame, x: str, y: str | None = None, colour: str | None = None, categories: int = 30, hues: int = 12) -> DataFrame:
    """How to show ``x`` alone or against ``y``, in one row: ``kind, x, y, n_x, n_y, flipped, too_many, hue``.

    ``kind``: ``count_table`` or ``count_bar`` for ``x`` alone; ``invalid`` for a column against itself; ``scatter`` for two numbers (``number_table`` if the second
    doesn't vary), ``heatmap`` for two categories, ``distribution`` for one of each (``category_table`` if either doesn't vary; ``flipped``: the number is
    ``x``). Dates are numbers. A category of over ``categories`` values, missing ones being one, is named in ``too_many`` and the kind is ``message``.
    ``n_x`` and ``n_y`` are distinct values, of categories with the missing one. ``hue``: ``colour`` if it has ``hues`` values at most.
    """
    number = {f.name: isinstance(f.dataType, T.NumericType) or role(f) == "date" for f in df.schema.fields}
    of = {"x": x, "y": y, "colour": colour}
    cells = [(F.col(f"`{c}`") if k != "colour" and number[c] else missing(f"`{c}`")).alias(k) for k, c in of.items() if c]
    some = df.select(*cells)
    counts = distinct_counts(some, some.columns)
    n = {k: F.coalesce(F.max(F.when(F.col("column") == k, F.col("n_distinct"))), F.lit(0)).cast("long") if c else F.lit(None).cast("long") for k, c in of.items()}
    one = counts.agg(n["x"].alias("n_x"), n["y"].alias("n_y"), n["colour"].alias("n_colour"))
    none = F.lit(None).cast("string")
    many = [F.when(F.col(f"n_{k}") > categories, F.lit(of[k])) for k in ("x", "y") if of[k] and not (y and number[of[k]])]
    too_many = none if x == y else F.coalesce(*many, none)
    if x == y:
        kind = F.lit("invalid")
    elif y is None:
        kind = F.when(F.col("n_x") == 1, "count_table").otherwise("count_bar")
    elif number[x] and number[y]:
        kind = F.when(F.col("n_y") <= 1, "number_table").otherwise("scatter")
    elif not number[x] and not number[y]:
        kind = F.lit("heatmap")
    else:
        kind = F.when(F.least("n_x", "n_y") <= 1, "category_table").otherwise("distribution")
    flipped = F.lit(bool(y) and x != y and number[x] and not number[y])
    hue = F.when(F.col("n_colour") <= hues, F.lit(colour)) if colour else none
    return one.select(F.when(too_many.isNotNull(), "message").otherwise(kind).alias("kind"), F.lit(x).alias("x"), F.lit(y).cast("string").alias("y"), "n_x", "n_y", flipped.alias("flipped"), too_many.alias("too_many"), hue.alias("hue"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, n_null=lambda c: F.count_if(F.col(c).isNull()))


# -- histograms ---------------------------------------------------------------------------------------------------


def group_mean_histogram(long: DataFrame, keys: list[str], bins: int = 256, dtype: str | None = None) -> DataFrame:
    """``grp, lo, hi, bin, mean, spread_lo, spread_hi, n_histograms`` of ``keys, grp, lo, hi, bin, n``.

    With ``dtype`` kinds of pixel type (``kind``: uint, int, float) are apart, and types of no kind are left out (``unsupported_dtypes`` counts them).
    Each histogram is scaled to area 1 and moved to its group's common axis, an exact edge going to the right bin. The spread needs two histograms.
    """
    by = ["grp"]
    if dtype:
        long, by = long.withColumn("kind", dtype_kind(dtype)).where("kind is not null"), ["kind", "grp"]
    w = Window.partitionBy(*keys)
    area = long.withColumn("share", F.col("n") / F.sum("n").over(w))
    b = long.groupBy(*by).agg(F.min("lo").alias("lo_all"), F.max("hi").alias("hi_all"), F.count_distinct(*keys).alias("k"))
    j = area.join(b, by)
    centre = F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / bins)
    moved = F.floor(F.try_divide(centre - F.col("lo_all"), (F.col("hi_all") - F.col("lo_all")) / bins))
    at = F.when(F.col("hi_all") <= F.col("lo_all"), 0).when(F.col("hi") <= F.col("lo"), F.least(F.greatest(F.floor(F.try_divide(F.col("lo") - F.col("lo_all"), (F.col("hi_all") - F.col("lo_all")) / bins)), F.lit(0)), F.lit(bins - 1))).otherwise(F.least(F.greatest(moved, F.lit(0)), F.lit(bins - 1)))
    per = j.groupBy(*by, "lo_all", "hi_all", "k", at.cast("int").alias("bin"), *keys).agg(F.sum("share").alias("v"))
    out = per.groupBy(*by, "lo_all", "hi_all", "k", "bin").agg((F.sum("v") / F.col("k")).alias("mean"), (F.sum(F.col("v") * F.col("v")) / F.col("k")).alias("sq"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean")))
    spread = lambda c: F.when(F.col("k") >= 2, c)
    return out.select(*by, F.col("lo_all").alias("lo"), F.col("hi_all").alias("hi"), "bin", "mean", spread(F.greatest(F.lit(0.0), F.col("mean") - sd)).alias("spread_lo"), spread(F.col("mean") + sd).alias("spread_hi"), F.col("k").alias("n_histograms"))


def individual_histograms(long: DataFrame, key: str, group: str | None = None, name=None, most: int = 50) -> DataFrame:
    """``key, lo, hi, bin, share`` of ``key, grp, lo, hi, bin, n``: the histograms of one record (``name``), or of the first ``most`` records of a group, each of area 1."""
    some = long if group is None else long.where(F.col("grp").cast("string") == group)
    if name is not None:
        some = some.where(F.col(key) == name)
    else:
        some = some.join(F.broadcast(some.select(key).distinct().orderBy(key).limit(most)), key)
    return some.select(key, "lo", "hi", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def relative_axis(long: DataFrame, dtype: str) -> DataFrame:
    """Bounds over the range of the pixel type (floats stay)."""
    return long.withColumns({"lo": F.col("lo") / dtype_scale(dtype), "hi": F.col("hi") / dtype_scale(dtype)})


def unsupported_dtypes(df: DataFrame, dtype: str = "dtype") -> DataFrame:
    return df.where(dtype_kind(dtype).isNull()).groupBy(F.col(dtype).alias("dtype")).agg(F.count("*").alias("n"))


def populated_extent(long: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """The range of values of the bins that are not empty."""
    step = (F.col("hi") - F.col("lo")) / bins
    return long.where("n > 0").groupBy(*keys).agg(F.min(F.col("lo") + F.col("bin") * step).alias("from"), F.max(F.col("lo") + (F.col("bin") + 1) * step).alias("to"))


def capped_groups(df: DataFrame, group: str, cap: int) -> DataFrame:
    return grouped(df, group).groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= cap)


# -- samples, top-k, pages ----------------------------------------------------------------------------------------


def _draw(key: str, seed: int) -> Column:
    """What samples are ordered by: a hash of the key as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_per_group(df: DataFrame, group: str, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group, by hash of ``key``: the same rows every time."""
    w = Window.partitionBy(group).orderBy(_draw(key, seed), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def reservoir(df: DataFrame, key: str, k: int, seed: int = 42, group: str | None = None, then: str | None = None) -> DataFrame:
    """``k`` rows by hash of ``key``, with their group in ``grp`` if one is named, and sorted by ``then``."""
    some = df.orderBy(_draw(key, seed), key).limit(k)
    some = grouped(some, group) if group else some
    return some.orderBy(F.col(then).desc_nulls_last(), key) if then else some


def top_k(df: DataFrame, metric: str, key: str, k: int = 256, descending: bool = True) -> DataFrame:
    """The ``k`` best keys on narrow columns, nulls last, with their place in ``ord``."""
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    best = df.select(key, metric).orderBy(order, key).limit(k)
    return best.withColumn("ord", F.row_number().over(Window.orderBy(order, key)))


def fetch(best: DataFrame, df: DataFrame, key: str, wide: list[str]) -> DataFrame:
    """Wide columns of the chosen keys: the second step after ``top_k``, whose rows are few."""
    return F.broadcast(best).join(df.select(key, *wide), key)


def page(df: DataFrame, by: str, key: str, number: int = 0, size: int = 10, descending: bool = False) -> DataFrame:
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return df.orderBy(order, key).offset(number * size).limit(size)


def category_order(df: DataFrame, category: str) -> DataFrame:
    """Distinct categories with their place: alphabetical, ``(missing)`` last."""
    d = df.select(missing(category).alias("category")).distinct()
    return d.withColumn("ord", F.row_number().over(Window.orderBy(F.col("category") == "(missing)", "category")))


def groups_list(df: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    d = grouped(df, group).select("grp").distinct().orderBy("grp")
    return d.limit(limit) if limit else d


def record_page(df: DataFrame, by: str, key: str, first: list[str], needle: str = "", number: int = 0, size: int = 10, descending: bool = False) -> DataFrame:
    """A page of the rows that hold ``needle``, with the columns of ``first`` before the others and the number of all such rows in ``total``."""
    from ..functions.scalar import search

    rows = df.where(search([f.name for f in df.schema.fields if role(f) != "blob"], needle)) if needle else df
    total = rows.agg(F.count("*").alias("total"))  # one row
    columns = [*first, *(c for c in df.columns if c not in first)]
    return page(rows, by, key, number, size, descending).select(*columns).crossJoin(F.broadcast(total))


def scatter(df: DataFrame, x: str, y: str, key: str, k: int = 5000, colour: str | None = None) -> DataFrame:
    """A sample of the rows that have all of x, y and the colour; ``scatter_nulls`` counts the others."""
    columns = [c for c in (x, y, colour) if c]
    return reservoir(df.dropna(subset=columns).select(key, *columns), key, k)


def scatter_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(any_of(F.col(c).isNull() for c in columns)).alias("n_null"))


def cohort(df: DataFrame, cube: DataFrame, key: str, coordinates: dict[str, int]) -> DataFrame:
    """Rows whose record has a row with all the coordinates."""
    hit = reduce(lambda a, b: a & b, (F.col(d) == i for d, i in coordinates.items()))
    return df.join(cube.where(hit).select(key).distinct(), key, "left_semi")


def leaf_cohort(leaf: DataFrame, key: str, coordinates: dict[str, int]) -> DataFrame:
    """Keys of the records that have a leaf at all the coordinates, along dimensions that vary in them: what ``cohort`` finds in the cube, from one pass over its leaves."""
    active = reduce(lambda a, b: a & b, (F.min(d) < F.max(d) for d in coordinates))
    here = reduce(lambda a, b: a & b, (F.col(d) == i for d, i in coordinates.items()))
    return leaf.groupBy(key).agg((active & F.bool_or(here)).alias("__in")).where("__in").select(key)


# -- paths, points, no-data ---------------------------------------------------------------------------------------


def hierarchy(df: DataFrame, path: str = "path", size: str | None = None, group: str | None = None, folders_only: bool = False) -> DataFrame:
    """``node, depth, n, bytes, label`` for each ancestor below the common root (node ``''``): its group, or ``mixed``."""
    g = grouped(df, group)
    ends = g.agg(F.split(F.min(path), "/").alias("a"), F.split(F.max(path), "/").alias("b"))  # the common prefix of the least and the greatest is everyone's
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size("a"), F.size("b")) - 1, F.lit(1))), lambda i: (F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i)) & (i < F.size("a")) & (i < F.size("b"))))
    j = g.crossJoin(F.broadcast(ends.select(same.alias("skip"))))
    parts = F.split(F.col(path), "/")
    rest = F.array_join(F.slice(parts, F.col("skip") + 1, F.greatest(F.size(parts) - F.col("skip"), F.lit(0))), "/")
    nodes = F.concat(F.array(F.lit("")), ancestors(rest, include_self=not folders_only))
    e = j.select("grp", (F.col(size) if size else F.lit(0)).cast("long").alias("bytes"), F.explode(nodes).alias("node"))
    label = F.when(F.min("grp") == F.max("grp"), F.min("grp")).otherwise("mixed")
    return e.groupBy("node").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), label.alias("label")).withColumn("depth", F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "/"))))


def colocated_rows(df: DataFrame, lat: str, lon: str, member: str) -> DataFrame:
    """One row per member with its point and how many are there: for points that hold more than fits a row."""
    at = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(member).alias("member"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return at.join(at.groupBy("lat", "lon").agg(F.count("*").alias("n")), ["lat", "lon"]).select("member", "lat", "lon", "n")


def colocated(df: DataFrame, lat: str, lon: str, member: str) -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias("members"))


def percent_bins(df: DataFrame, pct: Column, group: str | None = None) -> DataFrame:
    """Exactly 0 in a bin of its own (``0``), then ten bins of 10 %."""
    g = grouped(df.withColumn("__p", pct).where("__p is not null"), group)
    bin_ = F.when(F.col("__p") == 0, F.lit(0)).otherwise(F.least(F.ceil(F.col("__p") / 10), F.lit(10)))
    return g.groupBy(bin_.cast("int").alias("bin"), "grp").agg(F.count("*").alias("n"))


def nonfinite_bins(df: DataFrame, finite: str, total: str, dtype: str, group: str | None = None) -> DataFrame:
    """``percent_bins`` of the share of values that are not finite, of rows of float types; ``n_float`` of ``n_total`` rows are such."""
    of = F.col(dtype).startswith("float")
    n = df.agg(F.count_if(of).alias("n_float"), F.count("*").alias("n_total"))  # one row
    return percent_bins(df.where(of), (F.col(total) - F.col(finite)) * 100.0 / F.col(total), group).crossJoin(F.broadcast(n))


def bounds(df: DataFrame, west: str, south: str, east: str, north: str, group: str | None = None) -> DataFrame:
    """The box around all footprints of a group."""
    return grouped(df, group).groupBy("grp").agg(F.min(west).alias("west"), F.min(south).alias("south"), F.max(east).alias("east"), F.max(north).alias("north"))


def nodata_values(df: DataFrame, nodata: str, group: str | None = None) -> DataFrame:
    return grouped(df, group).groupBy(missing(nodata, "not set").alias("value"), "grp").agg(F.count("*").alias("n"))


def text_search(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``needle`` in one of ``columns``, or in any column that isn't a blob."""
    from ..functions.scalar import search

    return df.where(any_of([search(columns or [f.name for f in df.schema.fields if role(f) != "blob"], needle)]))
