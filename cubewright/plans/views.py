"""The given tables seen as arrays, files and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raster8(spark, sf) -> DataFrame:
    """Each embedding as an 8 x 8 plane."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("record_id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("values"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.lit("YX").alias("dim_order"), F.lit("float32").alias("dtype"))


def raster16(spark, sf) -> DataFrame:
    """Four embeddings as the quarters of a 16 x 16 plane, given row by row."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("record_id"), (F.col("vec_id") % 4).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    tiles = e.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("t")).where(F.size("t") == 4)
    half = lambda k, y: F.slice(F.col("t")[k]["v"], 1 + 8 * y, 8)
    rows = [F.concat(half(top, y), half(top + 1, y)) for top in (0, 2) for y in range(8)]
    values = F.concat(*rows)
    return tiles.select("record_id", values.alias("values"), F.array(F.lit(16), F.lit(16)).alias("shape"), F.lit("YX").alias("dim_order"))


def stack(spark, sf) -> DataFrame:
    """Ten planes a record, along t and c."""
    e = table(spark, sf, "embeddings")
    t, c = F.floor(F.col("vec_id") % 10 / 2).cast("int"), (F.col("vec_id") % 2).cast("int")
    return e.select(F.floor(F.col("vec_id") / 10).alias("record_id"), t.alias("dim_t"), c.alias("dim_c"), F.col("embedding").cast("array<double>").alias("values"), F.lit("float32").alias("dtype"))


def leaf(spark, sf) -> DataFrame:
    """Line items as leaf blocks of orders, along z and c."""
    c = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("dim_z"), c.alias("dim_c"), F.col("l_quantity").alias("v"), F.lit(1).cast("long").alias("num_pixels"), F.col("l_linestatus").alias("grp"))


def leaf_cube(spark, sf) -> DataFrame:
    from ..operators.cube import observation_cube

    x = leaf(spark, sf)
    x = x.groupBy("rec", "dim_z", "dim_c").agg(F.sum("num_pixels").alias("num_pixels"), F.sum("v").alias("v_sum"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"))
    return observation_cube(x, ["rec"], ["dim_z", "dim_c"], {"num_pixels": "sum", "v_sum": "sum", "v_min": "min", "v_max": "max", "v_mean": "mean"}, weight="num_pixels")


def inv(spark, sf) -> DataFrame:
    """Documents as files."""
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("file_extension"), F.col("n_chars").alias("size_bytes"), F.col("source").alias("grp"))


def obs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("grp"), F.col("value").alias("v"))


def tree(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.length("html").cast("long").alias("size_bytes"))


def child(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("string").alias("child_id"), F.col("role").alias("grp"))


def inv_side(spark, sf) -> DataFrame:
    """Files with the labels that some of them have."""
    side = table(spark, sf, "labels").withColumn("name", F.col("doc_id").cast("string")).drop("doc_id")
    return inv(spark, sf).join(side, "name", "left")


def holes(spark, sf) -> DataFrame:
    """``raster8`` with NaN and infinite pixels at places that follow from the record's number."""
    nan = lambda i: (F.col("record_id") * 7 + (i + 1) * 3) % 29 == 0
    inf = lambda i: (F.col("record_id") * 5 + i + 1) % 83 == 0
    v = F.transform("values", lambda x, i: F.when(nan(i), F.lit(float("nan"))).when(inf(i), F.lit(float("inf"))).otherwise(x))
    return raster8(spark, sf).withColumn("values", v)


def stacks(spark, sf, planes_each: int = 10) -> DataFrame:
    """Whole records of so many planes at most along t."""
    planes = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / planes_each).alias("record_id"), (F.col("vec_id") % planes_each).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    r = planes.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("t"))  # planes_each at most
    return r.select("record_id", F.flatten(F.transform("t", lambda x: x["v"])).alias("values"), F.array(F.size("t"), F.lit(8), F.lit(8)).alias("shape"), F.lit("TYX").alias("dim_order"))
