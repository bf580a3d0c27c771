"""A cube that grows by batches against the cube of all rows at once."""

import random

import pytest
from cubewright.operators.cube import observation_cube
from cubewright.streaming.incremental import IncrementalCube, ingest_cube
from pyspark.sql import functions as F

SCHEMA = "rec string, dim_z int, dim_c int, n int, lo double, mean double, sd double, w long, part int"
HOW = {"n": "sum", "lo": "min", "mean": "mean", "sd": "std:mean"}


@pytest.fixture(scope="module")
def leaf(spark):
    r = random.Random(4)
    odd = [float("nan"), float("inf"), None]
    rows = [(rec, r.randrange(k), r.choice([0, None, 0]) if rec == "b" else r.randrange(2), r.randint(1, 9), r.choice([*odd, 1.5, -2.0]), 1e6 + r.random() if r.random() < 0.8 else r.choice(odd), r.choice([0.0, 2.0, *odd]), r.choice([0, 1, 7]), r.randrange(4)) for rec, k in (("a", 4), ("b", 1), ("c", 3), (None, 2)) for _ in range(60)]
    return spark.createDataFrame([*rows, ("d", 1, 1, 1, 1.0, 1.0, 0.0, 0, 0), ("d", 2, 1, 1, 1.0, 4.0, 0.0, 0, 3)], SCHEMA).persist()


def table(df):
    return sorted((repr((r.rec, r.dim_z, r.dim_c)), r.obs_level, r.n, r.lo if r.lo == r.lo else "nan", None if r.mean is None else round(r.mean, 6), None if r.sd is None else round(r.sd, 5)) for r in df.collect())


def whole(leaf):
    known = observation_cube(leaf.where("rec is not null"), ["rec"], ["dim_z", "dim_c"], HOW, "w")
    return table(known)


def test_batches_replays_and_compaction(spark, leaf, tmp_path):
    cube = IncrementalCube(f"file://{tmp_path}/cube", ["rec"], ["dim_z", "dim_c"], HOW, "w")
    with pytest.raises(ValueError):
        cube.snapshot(spark)
    batches = [leaf.where(F.col("part") == k) for k in range(4)]
    for k in range(3):
        cube.add(batches[k], k)
    cube.add(batches[1], 1)
    cube.compact(spark)
    cube.add(batches[2], 2)  # held by the compacted folder
    cube.add(batches[3], 3)
    got = cube.snapshot(spark)
    assert table(got.where("rec is not null")) == whole(leaf)
    assert got.where("rec is null and obs_level = 0").count() == 1  # a missing key is a record of its own
    before = [p for *_, p in cube._folders(spark)]
    (tmp_path / "cube" / "batches=9-9").mkdir()  # never finished
    cube.vacuum(spark)
    assert [p for *_, p in cube._folders(spark)] == before and len(before) == 2 and table(cube.snapshot(spark).where("rec is not null")) == whole(leaf)


def test_stream_in_parts(spark, leaf, tmp_path):
    cube = IncrementalCube(f"file://{tmp_path}/cube", ["rec"], ["dim_z", "dim_c"], HOW, "w")
    for k in range(4):
        leaf.where(F.col("part") == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        ingest_cube(spark.readStream.schema(leaf.schema).parquet(f"{tmp_path}/in/*"), cube, f"{tmp_path}/checkpoint", lambda df: df, every=2).awaitTermination()
    assert len(cube._folders(spark)) == 2 and table(cube.snapshot(spark).where("rec is not null")) == whole(leaf)


def test_without_dimensions(spark, leaf, tmp_path):
    cube = IncrementalCube(f"file://{tmp_path}/cube", ["rec"], [], {"n": "sum", "sd": "std:mean"}, "w")
    cube.add(leaf.where("part < 2"), 0)
    cube.add(leaf.where("part >= 2"), 1)
    got = {r.rec: (r.n, None if r.sd is None else round(r.sd, 5)) for r in cube.snapshot(spark).collect()}
    want = {r.rec: (r.n, None if r.sd is None else round(r.sd, 5)) for r in observation_cube(leaf, ["rec"], [], {"n": "sum", "sd": "std:mean"}, "w").collect()}
    assert {k: v for k, v in got.items() if k} == {k: v for k, v in want.items() if k}
