"""The observation cube on literal rows."""

import math

import pytest
from cubewright.functions.scalar import dim_subset
from cubewright.operators.cube import across_dims, dense, merge_histograms, observation_cube


def cube(spark, rows, dims, metrics=None, **options):
    names = [*dims, "n", "v", "w", "sd"]
    df = spark.createDataFrame([("r", *r) for r in rows], "rec string, " + ", ".join(f"{d} int" for d in dims) + ", n long, v double, w long, sd double")
    assert names
    return observation_cube(df, ["rec"], dims, metrics or {"n": "sum", "v": "mean"}, weight="w", **options).collect()


def levels(rows):
    out = {}
    for r in rows:
        out[r.obs_level] = out.get(r.obs_level, 0) + 1
    return out


def test_one_active_dim(spark):
    got = cube(spark, [(z, 10, float(z), 1, 0.0) for z in range(3)], ["dim_z"])
    assert levels(got) == {0: 1, 1: 3}
    whole = next(r for r in got if r.obs_level == 0)
    assert whole.n == 30 and whole.dim_z is None and whole.v == 1.0


def test_two_and_three_active_dims(spark):
    got = cube(spark, [(z, c, 10 * (1 + c + 2 * z), 1.0, 1, 0.0) for z in (0, 1) for c in (0, 1)], ["dim_z", "dim_c"])
    assert levels(got) == {0: 1, 1: 4, 2: 4}
    assert {r.n for r in got if r.obs_level == 1 and r.dim_c is None} == {30, 70}
    assert {r.n for r in got if r.obs_level == 1 and r.dim_z is None} == {40, 60}
    got = cube(spark, [(z, c, t, 1, 1.0, 1, 0.0) for z in (0, 1) for c in (0, 1) for t in (0, 1)], ["dim_z", "dim_c", "dim_t"])
    assert levels(got) == {0: 1, 1: 6, 2: 12, 3: 8}


def test_constant_and_untiled_dims(spark):
    got = cube(spark, [(z, 0, 1, 1.0, 1, 0.0) for z in range(3)], ["dim_z", "dim_c"])
    assert levels(got) == {0: 1, 1: 3} and all(r.dim_c is None for r in got)
    rows = [(x, 100 * (x + 1), 1.0, 1, 0.0) for x in (0, 1)]
    assert levels(cube(spark, rows, ["dim_x"])) == {0: 1}
    assert levels(cube(spark, rows, ["dim_x"], tiled={"dim_x"})) == {0: 1, 1: 2}


def test_weighted_mean_pooled_deviation_and_nan(spark):
    nan = float("nan")
    got = cube(spark, [(0, 1, 2.0, 1, 1.0), (1, 1, 4.0, 3, 2.0), (2, 1, nan, 0, nan)], ["dim_z"], {"v": "mean", "sd": "std:v"})
    whole = next(r for r in got if r.obs_level == 0)
    assert whole.v == pytest.approx(3.5)
    assert whole.sd == pytest.approx(math.sqrt((1 * (1 + 1.5**2) + 3 * (4 + 0.5**2)) / 4))
    got = cube(spark, [(0, 1, nan, 1, 0.0), (1, 1, nan, 1, 0.0)], ["dim_z"], {"v": "min"})
    assert all(math.isnan(r.v) for r in got)
    got = cube(spark, [(0, None, None, 1, 0.0), (1, None, None, 1, 0.0)], ["dim_z"], {"v": "max", "n": "sum"})
    assert all(r.v is None and r.n is None for r in got)


def test_whole_only_and_sizes(spark):
    df = spark.createDataFrame([("r", z, 1, 5.0, 2) for z in (0, 1)], "rec string, dim_z int, size_z int, v double, full_size_z int")
    got = {r.dim_z: r for r in observation_cube(df, ["rec"], ["dim_z"], {}, sizes={"dim_z": "size_z"}, whole={"v": "sum"}).collect()}
    assert got[None].size_z == 2 and got[0].size_z == 1 and got[None].v == 10 and got[0].v is None


def test_subset_and_slices(spark):
    df = spark.createDataFrame([("a", z, c, 1, float(z + c)) for z in (0, 1) for c in (0, 1)] + [("b", z, c, 1, 1.0) for z in (0,) for c in (0, 1)], "rec string, dim_z int, dim_c int, n long, v double")
    c = observation_cube(df, ["rec"], ["dim_z", "dim_c"], {"v": "mean"})
    dims = ["dim_z", "dim_c"]
    assert c.where(dim_subset(dims)).count() == 2
    assert c.where(dim_subset(dims, {"dim_c": 1})).count() == 2
    assert c.where(dim_subset(dims, {"dim_z": 1}, ["dim_c"])).count() == 2
    got = {(r.slice): (r.n, r.retention) for r in across_dims(c, dims, "dim_c", ["v"]).collect()}
    assert got == {0: (2, 100.0), 1: (2, 100.0)}


def test_histogram_merge(spark):
    rows = [("a", 0.0, 256.0, 0, 3), ("a", 0.0, 256.0, 255, 2), ("a", 0.0, 512.0, 128, 5), ("b", 1.0, 1.0, 0, 4), ("c", 0.0, 1.0, 7, 1), ("c", 0.0, 1.0 + 1e-12, 7, 1)]
    got = merge_histograms(spark.createDataFrame(rows, "g string, lo double, hi double, bin int, n long"), ["g"])
    assert {(r.g, r.bin, r.n) for r in got.collect()} == {("a", 0, 3), ("a", 127, 2), ("a", 128, 5), ("b", 0, 4), ("c", 7, 2)}
    full = {r.g: r.counts for r in dense(got, ["g"]).collect()}
    assert len(full["a"]) == 256 and sum(full["a"]) == 10
