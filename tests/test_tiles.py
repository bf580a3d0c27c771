"""Arrays in files, read tile by tile."""

import numpy as np
import pytest
from cubewright.operators import rasters
from cubewright.sources import inventory, tiles


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    arrays = {"a": rng.normal(size=(7, 30, 20)), "f": np.asfortranarray(rng.integers(0, 99, (5, 40)).astype("uint16")), "b": np.arange(12, dtype=">i4"), "one": np.float32(3), "none": np.zeros((0, 4))}
    for k, v in arrays.items():
        np.save(tmp_path / f"{k}.npy", v)
    (tmp_path / "bad.npy").write_bytes(b"no array")
    np.save(tmp_path / "objects.npy", np.array([{}], object), allow_pickle=True)
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-100])
    return f"file://{tmp_path}", arrays


def test_tiles_put_together_are_the_arrays(spark, folder):
    path, arrays = folder
    got = tiles.read_tiles(tiles.found_files(spark, path), most_bytes=900, dims="ABYX").collect()
    name = lambda r: r.path.rsplit("/", 1)[1][:-4]
    for k in ("a", "f", "b", "one"):
        a, mine = arrays[k], [r for r in got if name(r) == k]
        back, seen = np.full(a.shape, np.nan), np.zeros(a.shape, int)
        for r in mine:
            place = {d: (r[f"dim_{d.lower()}"], r[f"size_{d.lower()}"]) for d in r.dim_order}
            where = tuple(slice(at, at + n) for at, n in place.values())
            back[where] = np.array(r["values"]).reshape(r.shape)
            seen[where] += 1
            assert r.error is None and r.num_pixels == len(r["values"]) <= max(1, 900 // a.dtype.itemsize) and r.dtype == a.dtype.newbyteorder("=").name
        assert (back == a).all() and (seen == 1).all()
    assert len([r for r in got if name(r) == "a"]) > 30 and not [r for r in got if name(r) == "none"]
    bad = {name(r): r for r in got if r.error}
    assert set(bad) == {"bad", "objects", "short"} and all(r["values"] is None for r in bad.values())
    assert [r["values"] is None for r in got if name(r) == "short"].count(True) < len([r for r in got if name(r) == "short"])  # the tiles before its end are read


def test_metrics_of_tiles(spark, folder):
    path, arrays = folder
    t = tiles.read_tiles(tiles.found_files(spark, path, "a.npy"), {"A": 1}, most_bytes=30 * 20 * 8, dim_order="ZYX", dims="ZYX")
    got = {r.dim_z: r.mean_intensity for r in rasters.measure(t, ["basic"]).collect()}
    assert got == pytest.approx({z: arrays["a"][z].mean() for z in range(7)})
    one = rasters.assembled_thumbnails(t, ["path"]).first()
    whole = rasters.thumbnails(inventory.npy_records(spark, [path + "/a.npy"], "ZYX"), ["path"]).first()
    assert one.thumbnail == whole.thumbnail


def test_only_the_bytes_of_a_tile_are_read():
    asked = []

    class File:
        def read_at(self, n, at):
            asked.append((at, n))
            return bytes(n)

    head = tiles.Head((100, 50, 40), "<f4", "ZYX", offset=128)
    assert tiles.npy_tile(File(), head, [10, 0, 0], [5, 50, 40]).shape == (5, 50, 40)
    assert asked == [(128 + 10 * 2000 * 4, 5 * 2000 * 4)]
    asked.clear()
    tiles.npy_tile(File(), head, [10, 7, 0], [2, 3, 40])
    assert asked == [(128 + (z * 2000 + 280) * 4, 480) for z in (10, 11)]


def test_own_loader_and_writer(spark, tmp_path):
    text = tiles.register_loader(tiles.Loader("rows", lambda f, order: tiles.Head((f.size() // 4,), "uint8", "X", late="X"), lambda f, h, at, n: np.array([int(f.read_at(3, 4 * k)) for k in range(at[0], at[0] + n[0])], float)))
    try:
        (tmp_path / "v.txt").write_text("".join(f"{k:03d}\n" for k in range(50)))
        got = tiles.read_tiles(tiles.found_files(spark, f"file://{tmp_path}", "*.txt"), {"X": 10}, most_bytes=10, loader="rows", dims="X", partitions=3).collect()
        assert sorted((r.dim_x, r["values"]) for r in got) == [(k, list(range(k, k + 10))) for k in range(0, 50, 10)]
    finally:
        del tiles.LOADERS[text.name]
    r = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0], [2, 2], "int16")], "k string, values array<double>, shape array<int>, dtype string")
    for _ in range(2):
        assert tiles.write_npy(r, f"file://{tmp_path}/out", "k").first().path == f"file://{tmp_path}/out/p.npy"
    assert np.load(tmp_path / "out/p.npy").tolist() == [[1, 2], [3, 4]] and len(list((tmp_path / "out").iterdir())) == 1
