"""Keys and tables larger than the given ones."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
from cubewright.functions.scalar import byte_text
from cubewright.operators import cube as C
from cubewright.operators import rasters
from cubewright.plans import record_queries  # noqa: F401
from cubewright.plans.queries import SQL, Q
from cubewright.sources import sinks, tiles
from pyspark.sql import functions as F


def test_sizes_of_large_keys(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT unnest([1, 33158, 33160, 90000, 5400000]::BIGINT[]) AS c_custkey")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    got = sorted(tuple(r) for r in Q["labels_and_sizes"](spark, str(tmp_path)).select("c_custkey", "size", "title").collect())
    assert got == sorted(con.execute(SQL["labels_and_sizes"]).fetchall())


def test_units(spark):
    sizes = [0.0, 1023.0, *(1024.0**k for k in range(1, 7)), None]
    rows = spark.createDataFrame([(n,) for n in sizes], "n double").select(byte_text("n").alias("all"), byte_text("n", "GB").alias("some")).collect()
    assert [r["all"] for r in rows] == ["0 B", "1023 B", "1.0 KB", "1.0 MB", "1.0 GB", "1.0 TB", "1.0 PB", "1024.0 PB", None]
    assert [r["some"] for r in rows][4:7] == ["1.0 GB", "1024.0 GB", "1048576.0 GB"]


def test_patches_are_handed_on_in_small_batches():
    """A patch is many times its record: a batch of 10,000 records may not be held as patches."""
    n = 3 * rasters.BATCH_BYTES // (64 * 64 * 4)
    df = pd.DataFrame({"id": range(n), "values": [np.arange(16.0)] * n, "shape": [[2, 2, 4]] * n, "dim_order": "YXS"})
    place = dict.fromkeys(("dim_y", "dim_x"), 0) | dict.fromkeys(("size_y", "size_x", "full_size_y", "full_size_x"), 2)
    tracemalloc.start()
    got = []
    for part in rasters._beside(df[["id"]], ((k, rasters._painted([p], 64)) for k, p in enumerate(rasters._patches(df.assign(**place), 64, "S"))), ["thumbnail", "norm_min", "norm_max"]):
        assert part["thumbnail"].map(len).sum() <= rasters.BATCH_BYTES + 64 * 64 * 4
        got += part["id"].tolist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == list(range(n)) and most < 4 * rasters.BATCH_BYTES < n * 64 * 64 * 4 * 8


def test_grid_of_tiles(spark):
    shapes = [("TZYX", [7, 30, 48, 58]), ("TZYX", [1, 1, 8, 9]), ("ZYX", [50, 100, 50]), ("YX", [0, 4]), ("TZYX", [1000000, 1000000, 50, 40])]
    r = spark.createDataFrame([(i, s, o, "uint16") for i, (o, s) in enumerate(shapes)], "id int, shape array<int>, dim_order string, dtype string")
    for limit in ({"most": 2000}, {"most_bytes": 3000}):
        got = {x.id: x for x in rasters.tile_grid(r, {}, **limit).collect()}
        assert (got[4].tiles, got[4].pixels) == (10**12 * (1 if "most" in limit else 2), 2 * 10**15)  # too many for a row each
        plan = rasters.tile_plan(r.where("id < 4"), {}, **limit).collect()
        for i in range(4):
            mine = [x.extent for x in plan if x.id == i]
            assert got[i].tiles == len(mine) and got[i].pixels == sum(int(np.prod(e)) for e in mine)
            assert not mine or got[i].extent == np.max(mine, 0).tolist()


def test_small_files_are_read_by_many_tasks(spark, tmp_path):
    """A plan is a few bytes a tile, so that coalesced it would be one task that reads everything."""
    for k in range(20):
        np.save(tmp_path / f"{k}.npy", np.arange(40.0) + k)
    got = tiles.read_tiles(tiles.found_files(spark, f"file://{tmp_path}"), most_bytes=64, dims="X").select("path", "values", "dim_x", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 2 and len(got) == 100
    assert all(len({r.task for r in got if r.path == p}) == 1 for p in {r.path for r in got})  # and a small file by one of them
    assert all(r["values"] == [r.dim_x + x + int(r.path.rsplit("/", 1)[1][:-4]) for x in range(8)] for r in got)


def test_cube_shuffles_records_once_into_many_tasks(spark):
    """One shuffle by record into a number of partitions that is not coalesced; a group expands in a task of a part of the rows."""
    leaf = spark.range(4000).selectExpr("id div 4 AS rec", "cast(id % 2 AS int) AS dim_z", "cast(id div 2 % 2 AS int) AS dim_c", "cast(id AS double) AS v", "1L AS n")
    cube = C.observation_cube(leaf, ["rec"], ["dim_z", "dim_c"], {"v": "mean", "n": "sum"}, weight="n", partitions=16)
    assert cube.rdd.getNumPartitions() == 16
    got = cube.groupBy("obs_level").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("obs_level").collect()
    assert [(r["rows"], r.n) for r in got] == [(1000, 4000), (4000, 8000), (4000, 4000)]
    assert [r.v for r in got] == [sum(range(4000)) / 4, sum(range(4000)), sum(range(4000))]


def test_report_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for df in parts:
            made.add(len(df))
            yield df

    df = spark.range(1000).selectExpr("cast(id AS bigint) AS n", "cast(null AS int) AS nothing").mapInPandas(count, "n long, nothing int")
    sinks.write_report(df, f"file://{tmp_path}/r.parquet", small=True)
    assert made.value == 1000
    assert [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(f"file://{tmp_path}/r.parquet").schema] == [("n", "smallint")]
