"""Tiles by size, thumbnails from tiles, row numbers, modes and missing pixels on small literal inputs."""

import itertools

import numpy as np
import pytest
from cubewright.functions.scalar import predicate
from cubewright.operators import cube, rasters, records, report
from pyspark.sql import functions as F


@pytest.mark.parametrize("order, shape, steps, most, late, want", [
    ("YX", [10, 10], {}, 100, "", [10, 10]),
    ("ZYX", [30, 10, 10], {}, 500, "", [5, 10, 10]),
    ("ZYX", [30, 10, 10], {"Z": 4}, 900, "", [4, 10, 10]),
    ("YX", [100, 50], {}, 500, "", [25, 16]),
    ("YX", [100, 50], {"Y": -1}, 500, "", [100, 5]),
    ("YX", [100, 50], {"Y": -1, "X": -1}, 10, "", [100, 50]),
    ("CZYX", [3, 30, 10, 10], {}, 300, "C", [3, 1, 10, 10]),
    ("CZYX", [3, 2, 10, 10], {}, 100, "C", [1, 1, 10, 10]),
    ("YX", [7, 7], {"Y": 3, "X": 3}, None, "", [3, 3]),
])
def test_tile_steps(order, shape, steps, most, late, want):
    assert rasters.tile_steps(order, shape, steps, most, late) == want


def test_tiles_cover_once(spark):
    df = spark.createDataFrame([(1, [13, 7, 9], "ZYX"), (2, [4, 4], "YX")], "rec long, shape array<int>, dim_order string")
    rows = rasters.tile_plan(df, {"Z": 2}, 130).collect()
    for rec, shape in ((1, (13, 7, 9)), (2, (4, 4))):
        seen = np.zeros(shape, int)
        for r in rows:
            if r.rec == rec:
                assert np.prod(r.extent) <= 130
                seen[tuple(slice(a, a + n) for a, n in zip(r.origin, r.extent))] += 1
        assert (seen == 1).all()


def test_thumbnail_of_tiles(spark):
    """A record's tiles give the thumbnail of the whole where tiles map to whole pixels; the middle plane of others; NaN and constant planes."""
    rng = np.random.default_rng(1)
    planes = rng.normal(size=(3, 64, 32))
    rows = [(1, [float(x) for x in planes.ravel()], [3, 64, 32], "ZYX"), (2, [float("nan")] * 12, [3, 4], "YX"), (3, [5.0] * 12, [3, 4], "YX")]
    df = spark.createDataFrame(rows, "rec long, values array<double>, shape array<int>, dim_order string")
    whole = {r.rec: r for r in rasters.thumbnails(df, ["rec"]).collect()}
    tiled = {r.rec: r for r in rasters.assembled_thumbnails(rasters.tile_records(df, {"Y": 8, "X": 16}, dims="ZYX"), ["rec"]).collect()}
    for k in (1, 2, 3):
        assert whole[k].thumbnail == tiled[k].thumbnail and (whole[k].norm_min, whole[k].norm_max) == (tiled[k].norm_min, tiled[k].norm_max)
    p = np.frombuffer(whole[1].thumbnail, np.uint8).reshape(64, 64, 4)
    lo, hi = min(planes[1].min(), 0), planes[1].max()
    assert (p[:, 16:48, 0] == ((planes[1] - lo) / (hi - lo) * 255).astype(np.uint8)).all()
    assert (p[:, 16:48, 3] == 255).all() and not p[:, :16].any() and not p[:, 48:].any()
    assert (np.frombuffer(whole[3].thumbnail, np.uint8).reshape(64, 64, 4)[8:56, :, 0] == 255).all() and whole[2].norm_max == 0


def test_row_ids_over_files(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 4 + k).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    df = spark.read.parquet(*(str(tmp_path / f"f{k}") for k in (2, 0, 1)))
    got = sorted((r.row_id, r.id) for r in records.row_ids(df).collect())
    assert got == list(enumerate(itertools.chain(range(0, 4), range(10, 15), range(20, 26))))


def test_modes_take_the_least_of_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2), ("a", None), (None, None)], "x string, y int")
    assert {r.column: (r.mode, r.n) for r in report.modes(df, ["x", "y"]).collect()} == {"x": ("a", 2), "y": ("2", 2)}


def test_one_missing_pixel(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(16, 16))
    q = p.copy()
    q[5, 7] = np.nan
    whole, hole = rasters.plane_metrics(p), rasters.plane_metrics(q)
    assert all(np.isfinite(v) and hole[k] == pytest.approx(v, rel=0.3) for k, v in whole.items())
    assert all(np.isnan(v) for v in rasters.plane_metrics(np.full((16, 16), np.nan)).values())


def test_infinite_values_in_the_cube(spark):
    inf = float("inf")
    rows = [(1, 0, 1.0, 1.0, 10), (1, 1, inf, 2.0, 5), (2, 0, inf, 1.0, 3), (2, 1, -inf, 1.0, 3), (3, 0, float("nan"), 0.5, 1), (3, 1, 4.0, 0.5, 1)]
    df = spark.createDataFrame(rows, "rec long, dim_z int, m double, s double, w long").withColumn("top", F.col("m"))
    out = cube.observation_cube(df, ["rec"], ["dim_z"], {"m": "mean", "s": "std:m", "top": "max"}, weight="w")
    got = {r.rec: (r.m, r.s, r.top) for r in out.where("obs_level = 0").collect()}
    assert got[1] == (1.0, 1.0, inf) and got[2][:2] == (None, None) and np.isnan(got[2][2]) and got[3] == (4.0, 0.5, 4.0)


def test_registered_metric_reaches_the_cube(spark):
    df = spark.createDataFrame([(1, z, [float(z), 2.0, 3.0, 4.0], [2, 2], "YX") for z in range(3)], "rec long, dim_z int, values array<double>, shape array<int>, dim_order string")
    rasters.register_metric(rasters.Metric("sum_and_top", {"total": "double", "top": "double"}, lambda a, o: {"total": float(a.sum()), "top": float(a.max())}, "", aggregates={"total": "sum", "top": "max"}))
    try:
        out = cube.registered_cube(rasters.measure(df, ["sum_and_top"]), ["rec"], ["dim_z"], ["sum_and_top"])
        assert {r.dim_z: (r.total, r.top) for r in out.collect()} == {None: (30.0, 4.0), 0: (9.0, 4.0), 1: (10.0, 4.0), 2: (11.0, 4.0)}
    finally:
        del rasters.REGISTRY["sum_and_top"]


def test_comparison_with_text(spark):
    df = spark.createDataFrame([("3",), ("7",), ("x",)], "v string")
    assert [df.where(predicate("v", "gt", x)).count() for x in ("5px", "abc", " 2", "-1e0")] == [1, 0, 2, 2]


def test_sidecar_of_repeated_keys(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k long, x long")
    b = spark.createDataFrame([(1, 9, "b"), (1, 8, "c"), (1, 8, "a")], "k long, x long, y string")
    assert sorted(map(tuple, records.sidecar(a, b, "k").select("k", "x", "y").collect())) == [(1, 8, "a"), (2, 5, None)]
