"""Report operators, records, sources, sinks and streams on small inputs; every registered query against its SQL."""

import datetime
import math
import random

import duckdb
import numpy as np
import pytest
from cubewright.functions import scalar
from cubewright.operators import ranktest, records
from cubewright.operators import report as R
from cubewright.plans.queries import SQL, Q
from cubewright.sources import inventory, sinks
from cubewright.streaming import ingest
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v + 0.0, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q))
def test_against_sql(spark, duck, sf, name):
    df = Q[name](spark, sf)
    got = sorted((tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect()))
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(str(plain(r[cols.index(c)])) for c in sorted(cols)) for r in res.fetchall())


def test_predicates(spark):
    df = spark.createDataFrame([("a%b", "10"), ("axb", "x"), (None, None)], "s string, n string")
    n = lambda *a, **k: df.where(scalar.predicate(*a, **k)).count()
    assert (n("s", "contains", "a%b"), n("s", "contains", "a%b", like=True), n("s", "not_contains", "q"), n("n", "gt", "5"), n("n", "??", "5"), n("s", "in", "axb, a%b")) == (1, 2, 2, 1, 3, 2)
    assert df.where(scalar.search(["s", "n"], "A%")).count() == 1


def test_timeline_units(spark):
    t0 = datetime.datetime(2024, 1, 1)
    for steps, unit in (([0, 0], "invariant"), ([0, 5], "second"), ([0, 300], "minute"), ([0, 7200], "hour"), ([0, 3 * 86400], "day"), ([86400 * k for k in range(25)], "month")):
        df = spark.createDataFrame([(t0 + datetime.timedelta(seconds=s),) for s in steps], "ts timestamp")
        assert {r.unit for r in R.timeline(df, "ts").collect()} == {unit}


def test_rank_test_small_and_ties(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i) + 4) for i in range(10)] + [("c", 1.0)], "g string, v double")
    got = {(r.a, r.b): r for r in ranktest.mann_whitney(df, "v", "g", ["a", "b", "c"]).collect()}
    u = sum((x > y) + (x == y) / 2 for x in range(10) for y in range(4, 14))
    assert got["a", "b"].u == u and got["a", "c"].p == 1.0


def test_numbered_children(spark, tmp_path):
    """Large parents by ranges, ties and nulls; the registered query gathers no group in a row."""
    rng = random.Random(4)
    rows = [(None if k % 9 == 0 else k % 4 // 2, None if k % 50 == 7 else rng.randrange(30), f"t{k:03}") for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    key = lambda r: (r[1] is None, r[1] or 0, r[2])
    want = {(p, t, x): str(i) for p in (None, 0, 1) for i, (_, t, x) in enumerate(sorted((r for r in rows if r[0] == p), key=key))}
    for limit in (5, 1000):
        out = records.numbered_children(df, "conv_id", "turn", ["text"], rows=limit, most=8 if limit == 5 else 1000)
        assert {(r.conv_id, r.turn, r.text): r.child_id for r in out.collect()} == want and out.count() == 200
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    plan = Q["container_expansion"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_timeline_by_a_given_unit(spark, tmp_path):
    """30 days by day, all counted; without a unit such a span goes by month."""
    df = spark.range(720).selectExpr("id AS event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts", "'a' AS event_type", "1.0D AS value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = Q["timeline_day_all"](spark, str(tmp_path)).collect()
    assert {(r.unit, r.n) for r in got} == {("day", 24)} and len(got) == 30
    assert {r.unit for r in R.timeline(df, "ts").collect()} == {"month"}


def test_rank_test_compares_all_groups(spark, tmp_path):
    """35 groups: every pair by brute force, through the registered query."""
    rng = random.Random(5)
    rows = [(k, k % 35, float(rng.randrange(40) + k % 35)) for k in range(700)]
    spark.createDataFrame([(i, f"g{g:02}", v) for i, g, v in rows], "event_id long, event_type string, value double").selectExpr("*", "timestamp '2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.a, r.b): r for r in Q["rank_test"](spark, str(tmp_path)).collect()}
    by = {f"g{g:02}": [v for _, h, v in rows if h == g] for g in range(35)}
    want = {(a, b): sum((x > y) + (x == y) / 2 for x in by[a] for y in by[b]) for a in by for b in by if a < b}
    assert {p: r.u for p, r in got.items()} == want and {(r.n_a, r.n_b) for r in got.values()} == {(20, 20)}
    assert all(abs(r.p_adj - min(1, 595 * r.p)) < 1e-3 for r in got.values())


def test_records(spark):
    df = spark.createDataFrame([([1, 3, 4, 5], "TCYX", ["T", "C", "Y", "X"], ["red", "G", "b"]), ([4, 5], "bad", None, None)], "shape array<int>, dim_order string, dim_names array<string>, channels array<string>")
    n = records.normalise(df).collect()
    assert [r.dim_order for r in n] == ["TCYX", "AB"] and n[1].dim_names == ["dimA", "dimB"]
    s = records.squeeze(records.normalise(df)).first()
    assert (s["shape"], s.dim_order) == ([3, 4, 5], "CYX")
    caps = df.select(records.capabilities("dim_order", "shape", "channels").alias("c")).first().c
    assert set(caps) == {"spatial-2d", "temporal", "multichannel", "rgb:C"}
    kept, out = records.split_untiled(df.limit(1), {"X": 1, "Y": 1})
    assert (kept.count(), out.count()) == (0, 1)
    b = spark.createDataFrame([(1.0, [1.0, float("nan"), None]), (1.0, [2.0]), (None, None)], "a double, b array<double>")
    assert [r.v for r in b.select(records.merge_nodata("a", "b").alias("v")).collect()] == [1.0, None, None]


def test_axes_sizes_and_matching(spark):
    df = spark.createDataFrame([('{"axes":[{"name":"c"},{"name":"y"},{"name":"x"}]}', 3), (None, 4)], "j string, n int")
    assert [r.o for r in df.select(records.infer_axes(F.col("j"), F.col("n")).alias("o")).collect()] == ["CYX", "ABYX"]
    r = spark.createDataFrame([("image/tiff", "CYX", ["spatial-2d"], [3, 4, 5])], "kind string, dim_order string, capabilities array<string>, shape array<int>")
    assert r.where(records.matches("image/*", "YX", ("spatial-2d",))).count() == 1 and r.where(records.matches("image/*", "Z")).count() == 0
    s = records.size_columns(r, "CYXZ").first()
    assert (s.size_c, s.size_x, s.size_z, s.ndim) == (3, 5, None, 3)
    f = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "w double, s double, e double, n double").select(*(c.alias(k) for k, c in records.footprint("w", "s", "e", "n").items())).first()
    assert (f.lat, f.lon) == (3.0, 2.0) and '"Polygon"' in f.footprint


def test_union_shrink_order(spark):
    a = spark.createDataFrame([(1, 2.5, None)], "x int, y double, z string")
    b = spark.createDataFrame([(1 << 40, "q")], "x long, w string")
    u = records.diagonal_union(a, b)
    assert dict(u.dtypes)["x"] == "bigint" and u.count() == 2
    assert records.drop_all_null(a).columns == ["x", "y"]
    assert dict(records.shrink(a.withColumn("size_bytes", F.lit(1))).dtypes) == {"x": "tinyint", "y": "float", "z": "string", "size_bytes": "int"}
    o = spark.createDataFrame([([1], 1, 2, 0)], "arr array<int>, v int, dim_z int, obs_level int")
    assert records.ordered(o).columns == ["obs_level", "dim_z", "v", "arr"]


def test_inventory(spark, tmp_path):
    for p, n in (("a/one.TXT", 3), ("a/b/two.txt", 4), ("a/b/x.zarr/0", 5), ("a/b/x.zarr/1/2", 6), ("c/three.bin", 7)):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * n)
    bases = [str(tmp_path / "a"), str(tmp_path / "a/b"), str(tmp_path / "c")]
    assert inventory.distinct_bases(bases) == [bases[0], bases[2]]
    got = {r.name: r for r in inventory.scan(spark, bases, folder_ext="zarr").collect()}
    assert {k: (r.size_bytes, r.type, r.file_extension) for k, r in got.items()} == {"one.TXT": (3, "file", "txt"), "two.txt": (4, "file", "txt"), "x.zarr": (11, "folder", "zarr"), "three.bin": (7, "file", "bin")}
    assert got["three.bin"].imported_path_short == "c"
    files = inventory.scan(spark, bases, {".TXT"})
    assert {r.name for r in files.collect()} == {"one.TXT", "two.txt"}
    sizes = {r.path: r.size_bytes for r in inventory.folder_sizes(inventory.with_folders(files)).collect()}
    assert sizes[str(tmp_path / "a")] == 7 and sizes[str(tmp_path / "a/b")] == 4
    assert inventory.inventory_only(files).where("obs_level = 0").count() == 2


def test_npy(spark, tmp_path):
    np.save(tmp_path / "ok.npy", np.arange(6, dtype=np.int16).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in inventory.npy_records(spark, [str(tmp_path)]).collect()}
    assert got["ok.npy"]["values"] == [0, 1, 2, 3, 4, 5] and got["ok.npy"].dim_order == "YX" and got["bad.npy"].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 5, 1.5, None, "a\tb", [1]), (1, 300, 2.5, None, "c", [2])], "obs_level int, num_pixels long, v double, gone string, name string, thumbnail array<int>")
    sinks.write_report(df, str(tmp_path / "r"), {"project": "p"}, small=True)
    back, provenance = sinks.read_report(spark, str(tmp_path / "r"))
    assert provenance == {"project": "p"} and "gone" not in back.columns and back.schema["num_pixels"].metadata["comment"]
    sinks.export_parquet(back, str(tmp_path / "s"), F.col("v") > 0, summary=True)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    sinks.export_csv(back, str(tmp_path / "c"))
    assert "thumbnail" not in spark.read.option("header", True).csv(str(tmp_path / "c")).columns
    sinks.export_embeddings(df, str(tmp_path / "e"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "e/tensors")).count() == 2
    assert sinks.merge_parts(spark, [str(tmp_path / "r"), str(tmp_path / "s")]).count() == 3


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.select("event_id", "value"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = ingest.running_snapshot(stream, "event_type", "value").writeStream.format("memory").queryName("snap").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("snap").agg(F.sum("n")).first()[0] == events.count()
    q = ingest.stream_timeline(stream, "ts", "event_type", late="60 days").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("days")) == key(ingest.stream_timeline(events, "ts", "event_type"))


def test_samples_are_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = R.sample_per_group(df, "g", "id", 50)
    assert a.count() == 150 and a.exceptAll(R.sample_per_group(df.repartition(7), "g", "id", 50)).count() == 0
    assert R.reservoir(df, "id", 20).count() == 20


def test_big_sides_stay_spread(spark, sf):
    """The rank test and the sample never bring the value table into one partition."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    plan = R.sample_per_group(df, "event_type", "event_id", 10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_plot_kind(spark):
    df = spark.createDataFrame([(1, 2.0, "a", None, "k"), (1, 3.0, "b", None, "k"), (1, None, None, None, "k")], "one int, v double, c string, none string, same string")
    of = lambda *a, **k: R.plot_kind(df, *a, **k).first()
    assert of("c").kind == "count_bar" and of("c").n_x == 3  # the missing one counts
    assert (of("same").kind, of("none").kind, of("none").n_x) == ("count_table", "count_table", 1)
    assert of("v", "one").kind == "number_table" and of("one", "v").kind == "scatter"
    assert of("c", "one").kind == "category_table" and of("same", "v").kind == "category_table"
    assert (of("v", "c").kind, of("v", "c").flipped, of("c", "v").flipped) == ("distribution", True, False)
    assert (of("c", categories=2).kind, of("c", categories=2).too_many) == ("message", "c")
    assert of("c", "c", categories=2).kind == "invalid"
    assert (of("v", "one", "c").hue, of("v", "one", "c", hues=2).hue) == ("c", None)
