"""Walks over folders, reports that can't be read, columns' meanings, failures as data, blocks of mixed size."""

import os

import pytest
from cubewright.operators import rasters
from cubewright.operators.cube import observation_cube, registered_cube
from cubewright.plans import views as V
from cubewright.sources import sinks, walk
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    for name, size in {"file1.txt": 3, "a/fileA.JPG": 5, "a/aa/fileAA.csv": 7, "b/set.zarr/0/chunk": 100, "b/set.zarr/meta.json": 10, "b/x.txt": 2}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"." * size)
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_walk(spark, tree, monkeypatch):
    got = {r.name: r for r in walk.walk(spark, [tree]).collect()}
    assert set(got) == {"file1.txt", "fileA.JPG", "fileAA.csv", "chunk", "meta.json", "x.txt"}
    a = got["fileAA.csv"]
    assert (a.path, a.parent, a.depth, a.size_bytes, a.file_extension, a.type, a.imported_path) == (f"{tree}/a/aa/fileAA.csv", f"{tree}/a/aa", 3, 7, "csv", "file", tree)
    assert abs(a.modification_date.timestamp() - os.path.getmtime(a.path)) < 3600 * 24 and got["fileA.JPG"].file_extension == "jpg"


def test_datasets_are_not_looked_into(spark, tree):
    got = {r.name: r for r in walk.walk(spark, [tree], is_dataset=walk.by_extension("zarr"), folders=True).collect()}
    assert set(got) == {"file1.txt", "fileA.JPG", "fileAA.csv", "set.zarr", "x.txt", "a", "aa", "b", "empty"}
    assert (got["set.zarr"].type, got["set.zarr"].size_bytes, got["set.zarr"].file_extension, got["set.zarr"].depth) == ("dataset", 0, "zarr", 2)
    assert (got["aa"].type, got["aa"].size_bytes, got["aa"].file_extension) == ("folder", 0, None) and got["aa"].modification_date
    looked = []
    listed = walk._listed
    rows = []
    todo = [tree]
    while todo:
        looked.append(todo[0])
        more = listed(todo.pop(0), tree, walk.by_extension("zarr"))
        rows += more
        todo += [x[0] for x in more if x[2] == "folder"]
    assert not any("zarr" in x for x in looked) and len(rows) == len(got)
    own = walk.walk(spark, [tree], is_dataset=lambda p: os.path.exists(f"{p}/meta.json")).collect()  # any predicate
    assert {r.name for r in own if r.type == "dataset"} == {"set.zarr"}


def test_extensions_bases_and_relative_paths(spark, tree):
    assert {r.name for r in walk.walk(spark, [tree], {".TXT", "zarr"}, walk.by_extension("zarr")).collect()} == {"file1.txt", "x.txt", "set.zarr"}
    assert {r.name for r in walk.walk(spark, [tree], {"txt"}, walk.by_extension("zarr")).collect()} == {"file1.txt", "x.txt"}
    got = {r.name: r for r in walk.walk(spark, [f"{tree}/a", f"{tree}/b", f"{tree}/a/aa"], relative_to=tree).collect()}
    assert (got["fileA.JPG"].path, got["fileA.JPG"].parent, got["fileA.JPG"].imported_path, got["fileA.JPG"].imported_path_short) == ("a/fileA.JPG", "a", "a", "a")
    assert got["x.txt"].common_base == os.path.basename(tree) and got["fileAA.csv"].depth == 2
    top = {r.name: r for r in walk.walk(spark, [tree], relative_to=tree).collect()}
    assert (top["file1.txt"].path, top["file1.txt"].parent, top["file1.txt"].imported_path) == ("file1.txt", ".", ".")
    assert "imported_path_short" not in walk.walk(spark, [tree]).columns


def test_nothing_to_walk(spark, tree):
    for bases in ([], [f"{tree}/none"], [f"{tree}/file1.txt"], [f"{tree}/empty"]):
        empty = walk.walk(spark, bases)
        assert empty.count() == 0 and "file_extension" in empty.columns


def test_reports_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, f"{tmp_path}/none.parquet")
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="expected"):
        sinks.read_report(spark, f"{tmp_path}/t.csv")
    (tmp_path / "bad.parquet").write_text("no such thing")
    with pytest.raises(ValueError, match="not readable"):
        sinks.read_report(spark, f"{tmp_path}/bad.parquet")
    (tmp_path / "empty").mkdir()
    df, about = sinks.read_report(spark, f"{tmp_path}/empty")
    assert df.count() == 0 and about == {}


def test_every_column_of_a_cube_report_has_a_meaning(spark, sf, tmp_path):
    leaf = rasters.measure(V.stack(spark, sf).withColumns({"shape": F.array(F.lit(8), F.lit(8)), "dim_order": F.lit("YX"), "size_t": F.lit(1), "full_size_t": F.lit(5)}))
    cube = registered_cube(leaf.withColumnRenamed("record_id", "path"), ["path"], ["dim_t", "dim_c"], ["basic", "image"], weight="finite_pixel_count", sizes={"dim_t": "size_t"})
    sinks.write_report(cube, f"{tmp_path}/r", {"a": 1})
    df, _ = sinks.read_report(spark, f"{tmp_path}/r")
    assert {f.name for f in df.schema.fields if not f.metadata.get("comment")} == set()
    assert sinks.meaning("pixel_size_x_unit") and sinks.meaning("full_size_y") and sinks.meaning("what is this") is None
    rasters.register_metric(rasters.Metric("own", {"own_value": "double"}, lambda a, o: {}, meanings={"own_value": "mine"}))
    try:
        assert sinks.meaning("own_value") == "mine"
    finally:
        del rasters.REGISTRY["own"]


def test_failures_are_data(spark, sf):
    def fussy(a, order):
        if a[0, 0] < 0:
            raise ValueError("below: zero")
        return {"x": 1.0}

    rasters.register_metric(rasters.Metric("fussy", {"x": "double"}, fussy))
    try:
        measured, seen = rasters.observed(rasters.measure(V.raster8(spark, sf), ["fussy", "basic"]), ["fussy", "basic"])
    finally:
        del rasters.REGISTRY["fussy"]
    got = {r.metric: r for r in rasters.failures(measured, ["fussy", "basic"]).collect()}
    n = V.raster8(spark, sf).where("values[0] < 0").count()
    assert 0 < n == got["fussy"].n_failed < got["fussy"].n_rows and got["fussy"].example == "below: zero" and (got["basic"].n_failed, got["basic"].example) == (0, None)
    measured.write.format("noop").mode("overwrite").save()
    assert seen.get["fussy"] == n and seen.get["basic"] == 0 and seen.get["rows"] == got["fussy"].n_rows


def test_blocks_of_mixed_size_are_an_error(spark):
    rows = [("r", 0, 0, 4, 1), ("r", 0, 1, 4, 1), ("r", 1, 0, 2, 1), ("r", 1, 1, 2, 1)]
    schema = "rec string, dim_z int, dim_c int, size_z int, n long"
    sizes = {"dim_z": "size_z"}
    got = observation_cube(spark.createDataFrame(rows, schema), ["rec"], ["dim_z", "dim_c"], {"n": "sum"}, sizes=sizes).collect()
    assert {(r.dim_z, r.size_z) for r in got if r.dim_z is not None} == {(0, 4), (1, 2)} and {r.size_z for r in got if r.dim_z is None} == {4}
    for odd in (("r", 0, 2, 3, 1), ("r", 0, 2, None, 1)):
        with pytest.raises(Exception, match="blocks of different size_z at dim_z = 0"):
            observation_cube(spark.createDataFrame([*rows, odd], schema), ["rec"], ["dim_z", "dim_c"], {"n": "sum"}, sizes=sizes).collect()
