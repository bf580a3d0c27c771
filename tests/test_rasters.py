"""Kernels, histograms, tiles and thumbnails on small arrays."""

import math

import numpy as np
import pytest
from cubewright.operators import rasters
from pyspark.sql import functions as F

SCHEMA = "id int, values array<double>, shape array<int>, dim_order string, dtype string"


def records(spark, *arrays, order="YX", dtype="float32"):
    return spark.createDataFrame([(i, [float(x) for x in a.ravel()], list(a.shape), order, dtype) for i, a in enumerate(arrays)], SCHEMA)


def test_basic(spark):
    r = records(spark, np.arange(1.0, 10).reshape(3, 3), np.array([[0, 1, 2], [3, 4, np.nan]]))
    for got in (rasters.measure(r, ["basic"]).orderBy("id").collect(), r.select("id", *rasters.basic_columns("values")).orderBy("id").collect()):
        assert (got[0].mean_intensity, got[0].min_intensity, got[0].max_intensity) == (5, 1, 9) and got[0].std_intensity == pytest.approx(2.5819888)
        assert got[1].mean_intensity == 2 and got[1].finite_pixel_count == 5


def test_image_metrics_order():
    rng = np.random.default_rng(0)
    noise, gradient = rng.normal(size=(32, 32)), np.tile(np.linspace(0, 1, 32), (32, 1))
    checker = np.indices((32, 32)).sum(0) % 2.0
    m = {k: rasters.plane_metrics(v) for k, v in {"noise": noise, "gradient": gradient, "checker": checker}.items()}
    assert m["checker"]["michelson_contrast"] > m["gradient"]["michelson_contrast"]
    assert m["noise"]["laplacian_variance"] > m["gradient"]["laplacian_variance"]
    assert m["noise"]["mscn_variance"] > m["gradient"]["mscn_variance"]
    blocks = np.kron(rng.normal(size=(4, 4)), np.ones((8, 8)))
    assert rasters.plane_metrics(blocks)["blocking_index"] > m["gradient"]["blocking_index"]
    assert all(math.isnan(v) for v in rasters.plane_metrics(np.ones((2, 2))).values())


def test_leading_dims_and_failures(spark):
    a = np.stack([np.ones((9, 9)), np.random.default_rng(1).normal(size=(9, 9))])
    got = rasters.measure(records(spark, a, order="ZYX"), ["image", "basic"]).first()
    assert got.laplacian_variance == pytest.approx(np.mean([rasters.plane_metrics(p)["laplacian_variance"] for p in a]))
    rasters.register_metric(rasters.Metric("broken", {"x": "double"}, lambda a, o: 1 / 0))
    try:
        got = rasters.measure(records(spark, a, order="ZYX"), ["broken", "basic"]).first()
        assert got.x is None and got.mean_intensity is not None and got.errors[0].startswith("broken")
    finally:
        del rasters.REGISTRY["broken"]


@pytest.mark.parametrize(("values", "dtype", "bounds"), [([0, 128, 255, 50], "uint8", (0, 256)), (range(10, 21), "uint8", (0, 256)), (range(100, 121), "uint16", (100, 356)), (range(1024), "uint16", (0, 1023)), ([0.5, 1.5], "float32", (0.5, 1.5))])
def test_histogram_bounds(spark, values, dtype, bounds):
    a = np.array([list(values)], float)
    got = rasters.block_histograms(records(spark, a, dtype=dtype), ["id"]).collect()
    assert {(r.lo, r.hi) for r in got} == {bounds} and sum(r.n for r in got) == a.size
    if dtype == "uint8":
        assert {r.bin for r in got} == set(values)


def test_nan_and_nodata_counts(spark):
    a = np.array([[1, np.nan, np.nan, np.nan, 2, 1, 0, 1]])
    r = records(spark, a)
    assert {x.nan_count for x in rasters.block_histograms(r, ["id"]).collect()} == {3}
    for value, n in ((1.0, 3), (float("nan"), 3), (None, 0)):
        assert r.select(rasters.nodata_count("values", F.lit(value).cast("double")).alias("n")).first().n == n


def test_tiles_cover_everything(spark):
    a = np.arange(2 * 5 * 7.0).reshape(2, 5, 7)
    t = rasters.tile_records(records(spark, a, order="CYX"), {"Y": 2, "X": -1, "C": 1}, "CYX").collect()
    assert len(t) == 6 and sum(r.num_pixels for r in t) == a.size and sum(sum(r["values"]) for r in t) == a.sum()
    assert {r.size_y for r in t} == {2, 1} and {r.full_size_x for r in t} == {7}


def test_thumbnails(spark):
    got = rasters.thumbnails(records(spark, np.linspace(0, 255, 10000).reshape(100, 100)), ["id"])
    r = got.first()
    assert len(r.thumbnail) == 64 * 64 * 4 and (r.norm_min, r.norm_max) == (0, 255)
    back = np.frombuffer(rasters.denormalise(got, "uint8").first().thumbnail, np.uint8).reshape(-1, 4)
    assert abs(int(back[-1, 0]) - 255) <= 1


def canvas(spark, a, order="YX", dtype="uint8", **kw):
    r = rasters.thumbnails(records(spark, a, order=order, dtype=dtype), ["id"], **kw).first()
    return np.frombuffer(r.thumbnail, np.uint8).reshape(64, 64, 4), r


@pytest.mark.parametrize(
    ("order", "shape", "fill", "pixel"),
    [
        ("YXS", (64, 64, 3), [100, 150, 200], [127, 191, 255]),
        ("YXS", (64, 64, 4), [100, 150, 200, 128], [127, 191, 255]),  # the fourth is left out
        ("YXS", (4, 4, 3), [250, 0, 0], [255, 0, 0]),
        ("YXS", (20, 20, 3), [1.0, 0.5, 0.0], [255, 127, 0]),
        ("YXC", (64, 64, 3), [100, 150, 200], [255, 255, 255]),  # the middle channel, grey
    ],
)
def test_colour(spark, order, shape, fill, pixel):
    c, _ = canvas(spark, np.broadcast_to(np.array(fill, float), shape), order)
    assert c[32, 32].tolist() == [*pixel, 255]


def test_colour_axis_of_choice_and_two_samples(spark):
    a = np.zeros((3, 20, 20))
    a[0], a[1], a[2] = 100, 150, 200
    assert canvas(spark, a, "CYX", colour="C")[0][32, 32].tolist() == [127, 191, 255, 255]
    assert canvas(spark, a[:2] * [[[0]], [[1]]], "SYX")[0][32, 32].tolist() == [0, 255, 0, 255]
    t = np.zeros((3, 2, 5, 20, 20))
    t[1, :, 2] = 200
    assert canvas(spark, t, "TCZYX")[0][32, 32].tolist() == [255] * 4


def test_range_and_missing_pixels(spark):
    a = np.zeros((64, 64))
    a[:, 32:] = 50
    a[:, :32] = -50
    c, r = canvas(spark, a)
    assert (c[32, 16, 0], c[32, 48, 0], r.norm_min, r.norm_max, r.thumbnail_dtype) == (0, 255, -50, 50, "uint8")
    a[:, :32], a[:, 32:48], a[:, 48:] = np.nan, 0, 1
    c, r = canvas(spark, a)
    assert (c[32, 16, 0], c[32, 48, 0], r.norm_min, r.norm_max) == (0, 255, 0, 1)
    c, r = canvas(spark, np.full((32, 32), np.nan))
    assert c[..., 0].max() == 0 and (r.norm_min, r.norm_max) == (0, 0)
    c, r = canvas(spark, np.where(np.indices((64, 64))[1] > 40, np.inf, 1.0))
    assert (r.norm_min, r.norm_max) == (0, 0)
    assert rasters.thumbnails(records(spark, np.zeros((1, 0))), ["id"]).count() == 0


def test_wide_and_tall(spark):
    c, _ = canvas(spark, np.full((1, 256), 200.0))
    assert np.flatnonzero(c[..., 3].any(1)).tolist() == [31] and c[31, :, 3].all()
    c, _ = canvas(spark, np.full((256, 1), 200.0))
    assert np.flatnonzero(c[..., 3].any(0)).tolist() == [31] and c[:, 31, 3].all()


def test_coloured_tiles_equal_the_whole(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, (5, 48, 64, 3)).astype(float)
    whole, _ = canvas(spark, a, "ZYXS")
    cut = rasters.tile_records(records(spark, a, order="ZYXS", dtype="uint8"), {"Y": 16, "X": 32, "S": -1}, "ZYX")
    tiles = rasters.assembled_thumbnails(cut, ["id"]).first()
    # tiles of the middle plane alone, with its range
    top = min(a[2].min(), 0), a[2].max()
    got = np.frombuffer(tiles.thumbnail, np.uint8).reshape(64, 64, 4)
    assert (tiles.norm_min, tiles.norm_max, tiles.thumbnail_dtype) == (*top, "uint8") and (got == whole).all()
    sent = cut.groupBy("dim_z").count().collect()
    assert len(sent) == 5 and {r["count"] for r in sent} == {6}


@pytest.mark.parametrize(
    ("order", "shape", "most", "steps", "late", "size"),
    [
        ("YX", [1000, 1000], 10_000, {}, "", [100, 100]),
        ("TZYX", [100, 50, 10, 10], 20_000, {}, "", [20, 10, 10, 10]),
        ("ZYX", [7, 100, 50], 20_000, {}, "", [3, 100, 50]),
        ("YX", [256, 256], 104_857 / 4, {}, "", [128, 128]),
        ("YX", [256, 256], 65_536 / 4, {"Y": 32}, "", [64, 256]),
        ("YX", [512, 512], 262_144 / 4, {"Y": 32, "X": 32}, "", [256, 256]),
        ("ZYX", [3, 256, 256], 209_715 / 4, {"Y": 32}, "", [1, 128, 256]),
        ("TYXC", [50, 32, 32, 3], 104_857 / 4, {}, "C", [8, 32, 32, 3]),
        ("YX", [64, 64], 4096, {}, "", [64, 64]),
        ("YX", [64, 64], 10, {"Y": -1, "X": -1}, "", [64, 64]),
        ("Z", [1000], 256, {"Z": 100}, "", [200]),
    ],
)
def test_budget_is_shared_over_a_tier(order, shape, most, steps, late, size):
    assert rasters.tile_steps(order, shape, steps, most, late) == size


def test_tile_plan(spark):
    r = spark.createDataFrame([(1, [7, 100, 50], "ZYX", "uint16", "", "x"), (2, [3, 4], "YX", "float64", "", "x"), (3, [0, 4], "YX", "uint8", "", "x"), (4, [40, 30, 3], "YXC", "uint8", "C", "x")], "id int, shape array<int>, dim_order string, dtype string, late string, at string")
    got = rasters.tile_plan(r, {}, most_bytes=40_000).collect()
    assert sorted((x.id, tuple(x.origin), tuple(x.extent)) for x in got if x.id < 3) == [(1, (0, 0, 0), (3, 100, 50)), (1, (3, 0, 0), (3, 100, 50)), (1, (6, 0, 0), (1, 100, 50)), (2, (0, 0), (3, 4))]
    small = [x for x in rasters.tile_plan(r.where("id = 4"), {}, most_bytes=1000).collect()]
    assert {tuple(x.extent) for x in small} == {(40, 30, 1)} or all(x.extent[2] == 1 for x in small)
    assert sum(np.prod(x.extent) for x in small) == 3600 and rasters.tile_plan(r.limit(0), {}, 5).count() == 0
