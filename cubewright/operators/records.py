"""Records: one N-dimensional array each, with its axes and what is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import INT_RANGE, col

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLOURS = ("r", "g", "b", "a", "red", "green", "blue", "alpha")


def normalise(records: DataFrame) -> DataFrame:
    """Axis letters that don't match the shape are replaced by ``A, B, C ...``; so are names, by ``dimA ...``. Channel names are text, one for each index along C, or null."""
    n = F.size("shape")
    one_letter = F.coalesce(F.forall("dim_names", lambda x: F.length(x) == 1) & (F.size("dim_names") == n), F.lit(False))
    order = F.when(F.length("dim_order") == n, F.col("dim_order")).when(one_letter, F.upper(F.array_join("dim_names", ""))).otherwise(F.substring(F.lit(LETTERS), F.lit(1), n))
    r = records.withColumn("dim_order", order)
    names = F.when(F.size("dim_names") == n, F.col("dim_names")).otherwise(F.transform(F.split("dim_order", ""), lambda d: F.concat(F.lit("dim"), d)))
    r = r.withColumn("dim_names", names)
    if "channel_names" not in r.columns:
        return r
    c = F.transform("channel_names", lambda x: x.cast("string"))
    at = F.instr("dim_order", "C")
    return r.withColumn("channel_names", F.when((at > 0) & (F.size(c) == F.try_element_at("shape", F.greatest(at, F.lit(1)))), c))


def canonical_dtype(c: str | Column) -> Column:
    """``float32`` for ``<f4``, ``>f4``, ``Float32`` and the like."""
    short = F.regexp_extract(col(c), r"^[<>=|]?([a-z])([0-9]+)$", 1)
    bits = (F.regexp_extract(col(c), r"^[<>=|]?([a-z])([0-9]+)$", 2).try_cast("int") * 8).cast("string")
    kind = F.when(short == "f", "float").when(short == "i", "int").when(short == "u", "uint").when(short == "c", "complex")
    return F.when(short == "b", "bool").otherwise(F.coalesce(F.concat(kind, bits), F.lower(F.regexp_replace(col(c), "^[<>=|]", ""))))


def infer_axes(attributes: Column, ndim: Column) -> Column:
    """Axis names in JSON attributes if they fit, else Y and X last after A, B, C ..."""
    axes = F.transform(F.from_json(attributes, "struct<axes:array<struct<name:string>>>")["axes"], lambda a: F.upper(a["name"]))
    return F.when(F.size(axes) == ndim, F.array_join(axes, "")).otherwise(F.concat(F.substring(F.lit(LETTERS), F.lit(1), ndim - 2), F.lit("YX")))


def squeeze(records: DataFrame) -> DataFrame:
    """Axes of size 1 leave shape, letters and names, and their ``size_<axis>`` is null."""
    z = F.filter(F.arrays_zip(F.col("shape").alias("n"), F.split("dim_order", "").alias("d"), F.col("dim_names").alias("name")), lambda x: x["n"] != 1)
    r = records.withColumn("__z", z)
    return r.withColumns({"shape": F.transform("__z", lambda x: x["n"]), "dim_order": F.array_join(F.transform("__z", lambda x: x["d"]), ""), "dim_names": F.transform("__z", lambda x: x["name"]), **{c: F.when(F.col(c) != 1, F.col(c)) for c in r.columns if c.startswith("size_") and len(c) == 6}}).drop("__z")


def capabilities(order: str | Column, shape: str | Column, channels: str | Column) -> Column:
    """spatial-2d, spatial-3d, temporal, multichannel, rgb:S and rgb:C."""
    o, has = col(order), lambda d: F.instr(col(order), d) > 0
    size = lambda d: F.try_element_at(col(shape), F.instr(o, d))
    named = F.coalesce(F.size(col(channels)) > 0, F.lit(False)) & F.coalesce(F.forall(col(channels), lambda c: F.lower(c).isin(*COLOURS)), F.lit(False))
    flat = has("X") & has("Y")
    return F.array_compact(F.array(F.when(flat, "spatial-2d"), F.when(flat & has("Z"), "spatial-3d"), F.when(has("T"), "temporal"), F.when(has("C"), "multichannel"), F.when(has("S") & size("S").isin(3, 4), "rgb:S"), F.when(has("C") & named & size("C").isin(3, 4), "rgb:C")))


def matches(kind: str, axes: str = "", needs: tuple[str, ...] = ()) -> Column:
    """Whether a record's ``kind, dim_order, capabilities`` suit a processor: kind exact, ``*``, ``prefix/*`` or ``re:...``."""
    k = F.col("kind")
    same = F.lit(True) if kind == "*" else k.startswith(kind[:-1]) if kind.endswith("/*") else k.rlike(kind[3:]) if kind.startswith("re:") else k == kind
    subset = F.size(F.array_except(F.array(*map(F.lit, axes)), F.split("dim_order", ""))) == 0 if axes else F.lit(True)
    able = F.size(F.array_except(F.array(*map(F.lit, needs)), F.col("capabilities"))) == 0 if needs else F.lit(True)
    return same & subset & able


def size_columns(records: DataFrame, dims: str) -> DataFrame:
    """``ndim``, the canonical ``dtype`` where there is one, and ``size_<axis>`` of each record, null for axes it lacks; other columns stay."""
    size = {f"size_{d.lower()}": F.when(F.instr("dim_order", d) > 0, F.try_element_at("shape", F.instr("dim_order", d))) for d in dims}
    if "dtype" in records.columns:
        records = records.withColumn("dtype", canonical_dtype("dtype"))
    return records.withColumns({"ndim": F.size("shape"), **size})


def split_untiled(records: DataFrame, steps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a ``reason``): blocks of one element along every axis would give as many rows as pixels."""
    block = F.create_map(*(F.lit(x) for d in LETTERS for x in (d, steps.get(d, -1 if d in "XY" else 1))))
    ones = F.forall(F.split("dim_order", ""), lambda d: block[d] == 1)
    return records.where(~ones), records.where(ones).withColumn("reason", F.lit("every block would be one element"))


def merge_nodata(image: str | Column, bands: str | Column) -> Column:
    """The one no-data value of an image and its bands; null if they differ or there is none."""
    v = F.array_distinct(F.filter(F.concat(F.array(col(image).cast("double")), F.coalesce(col(bands), F.array().cast("array<double>"))), lambda x: x.isNotNull() & ~F.isnan(x)))
    return F.when(F.size(v) == 1, v[0])


def constant_or_null(a: str | Column) -> Column:
    d = F.array_distinct(col(a))
    return F.when(F.size(d) == 1, d[0])


def footprint(west: str, south: str, east: str, north: str) -> dict[str, Column]:
    """GeoJSON polygon and centroid of a box in degrees."""
    w, s, e, n = (col(c).cast("double") for c in (west, south, east, north))
    ring = F.array(*(F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))
    return {"footprint": F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))), "lat": (s + n) / 2, "lon": (w + e) / 2}


def expand_children(files: DataFrame, children: str) -> DataFrame:
    """One row per child of a container: ``child_id`` from the element's place, ``type`` ``sub_file``."""
    c = [x for x in files.columns if x != children]
    return sub_file_type(files.select(*c, F.posexplode(children).alias("__i", "record")).withColumn("child_id", F.col("__i").cast("string")).drop("__i"))


def numbered_children(df: DataFrame, parent: str, order: str, then: list[str], rows: int = 10_000, most: int = 1000) -> DataFrame:
    """Rows of ``df`` as children of ``parent``: ``child_id`` counts them from 0 by ``order`` (a number) and ``then``, nulls last.

    A parent with over ``rows`` rows is numbered by ranges of ``order``, each offset by the rows of the ranges before it; no parent is gathered in
    one row. There are as many ranges as the largest parent has times ``rows``, ``most`` at most. Rows that share ``order`` are in one range, which one task sorts.
    """
    counts = df.groupBy(F.col(parent).alias("__p")).agg(F.count("*").alias("__n"))
    ranges = min(most, -(-(counts.agg(F.max("__n")).first()[0] or 0) // rows))
    large = df.join(counts.where(F.col("__n") > rows).select("__p", F.lit(True).alias("__large")), F.col(parent).eqNullSafe(F.col("__p")), "left").drop("__p")
    bounds = []
    if ranges > 1:
        splits = F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * most)
        bounds = sorted(set(large.where("__large").agg(splits.alias("s")).first()["s"] or []))  # ``most`` numbers at most
    passed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(order))) if bounds else F.lit(0)
    place = F.when(F.col(order).isNull(), len(bounds) + 1).otherwise(passed)
    dealt = large.withColumn("__r", F.when(F.col("__large"), place).otherwise(0))
    inside = Window.partitionBy(parent, "__r").orderBy(*(F.col(c).asc_nulls_last() for c in (order, *then)))
    before = Window.partitionBy("__p").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.where("__large").groupBy(F.col(parent).alias("__p"), "__r").agg(F.count("*").alias("__n"))  # ``ranges`` rows a large parent
    offsets = totals.select("__p", F.col("__r").alias("__s"), F.sum("__n").over(before).alias("__before"))
    ranked = dealt.withColumn("__i", F.row_number().over(inside) - 1)
    out = ranked.join(offsets, F.col(parent).eqNullSafe(F.col("__p")) & (F.col("__r") == F.col("__s")) & F.col("__large"), "left")
    child = (F.col("__i") + F.coalesce("__before", F.lit(0))).cast("string")
    return sub_file_type(out.withColumn("child_id", child).select(*df.columns, "child_id"))


def sub_file_type(df: DataFrame) -> DataFrame:
    own = F.col("type") if "type" in df.columns else F.lit("file")
    return df.withColumn("type", F.when(F.col("child_id").isNotNull(), "sub_file").otherwise(own))


def sidecar(records: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``records`` with the columns of ``side``; a record's own value wins. Of several rows with a key, the least by its columns in order counts."""
    rest = [c for c in side.columns if c != key]
    other = side.groupBy(key).agg(F.min(F.struct(*rest)).alias("__s")).select(key, *(F.col(f"__s.{c}").alias(f"__{c}") for c in rest)) if rest else side.select(key).distinct()
    j = records.join(other, key, "left")
    for c in (x for x in side.columns if x != key):
        j = j.withColumn(c, F.coalesce(c, f"__{c}") if c in records.columns else F.col(f"__{c}")).drop(f"__{c}")
    return j


WIDTH = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def diagonal_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All columns of both; missing ones null, types widened to a common one."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    for c in ta.keys() & tb.keys():
        if ta[c] != tb[c]:
            wide = max((ta[c], tb[c]), key=WIDTH.__getitem__) if ta[c] in WIDTH and tb[c] in WIDTH else "string"
            a, b = a.withColumn(c, F.col(c).cast(wide)), b.withColumn(c, F.col(c).cast(wide))
    return a.unionByName(b, allowMissingColumns=True)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value, from one pass."""
    n = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if not n[c])) if n else df


def shrink(df: DataFrame, keep: tuple[str, ...] = ("size_bytes",)) -> DataFrame:
    """Integers to the narrowest width that holds them, doubles to floats, from one pass."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name not in keep]
    r = df.agg(*(f(c).alias(f"{n}{c}") for c in ints for n, f in (("a", F.min), ("b", F.max)))).first() if ints else {}
    for c in ints:
        lo, hi = r[f"a{c}"], r[f"b{c}"]
        if lo is not None:
            width = next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= lo and hi < 1 << b)
            df = df.withColumn(c, F.col(c).cast(width))
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)} or {})


def ordered(df: DataFrame) -> DataFrame:
    """obs_level, dimensions by name, scalars, then arrays, maps and bytes."""
    blob = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)}
    dims = sorted(c for c in df.columns if c.startswith("dim_") and len(c) == 5)
    first = [c for c in ("obs_level",) if c in df.columns] + dims
    return df.select(*first, *(c for c in df.columns if c not in first and c not in blob), *(c for c in df.columns if c in blob))


def row_ids(df: DataFrame, into: str = "row_id") -> DataFrame:
    """Rows of files as read, numbered from 0: by file name, then by place in the file. ``df`` must come straight from a file source."""
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = at.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))  # one row a file
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return at.join(first, "__file").select(*df.columns, (F.col("__first") + F.col("__row")).alias(into))


def file_metadata(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Observation rows with their file's columns; the file's value wins."""
    return rows.drop(*(c for c in files.columns if c != key)).join(files, key)


def pixel_range(dtype: str) -> tuple[int, int] | None:
    return INT_RANGE.get(dtype)
