"""Large arrays read tile by tile: headers, a plan of tiles and their bytes are each read in tasks, and no row holds a whole array.

A ``Loader`` tells an array's shape, type and axes from its head and reads one tile from its bytes; ``npy`` is one, others are
registered beside it. Files are opened through ``pyarrow.fs``, so that their store can be a shared folder or an object store.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rasters import BATCH_BYTES, tile_plan

#: Values of an array, in C order, that are dealt to one task.
STRETCH = 8 << 20


@dataclass(frozen=True)
class Head:
    """What is known of an array before its values are read; ``late``: axes to be cut late, ``offset``: where values begin."""

    shape: tuple[int, ...]
    dtype: str
    dim_order: str
    late: str = ""
    offset: int = 0
    fortran: bool = False


@dataclass(frozen=True)
class Loader:
    """``head``: of an open file and the axes asked for; ``read``: the tile of an open file at an origin with an extent."""

    name: str
    head: Callable[[pa.NativeFile, str | None], Head]
    read: Callable[[pa.NativeFile, Head, list[int], list[int]], np.ndarray]


LOADERS: dict[str, Loader] = {}


def register_loader(loader: Loader) -> Loader:
    LOADERS[loader.name] = loader
    return loader


def opened(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def default_axes(n: int) -> str:
    """Y and X last, letters before them."""
    return "ABCDEFGHIJKLMNOP"[: max(n - 2, 0)] + "YX"[-n:] if n else ""


def npy_head(file: pa.NativeFile, dim_order: str | None = None) -> Head:
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return Head(shape, dtype.str, dim_order if dim_order and len(dim_order) == len(shape) else default_axes(len(shape)), offset=file.tell(), fortran=fortran)


def npy_tile(file: pa.NativeFile, head: Head, origin: list[int], extent: list[int]) -> np.ndarray:
    """The tile from the byte ranges that hold it: one range for each index of the axes before the last one that is cut."""
    shape, at, n = (list(x)[::-1] if head.fortran else list(x) for x in (head.shape, origin, extent))
    item = np.dtype(head.dtype)
    lead = max((k for k in range(len(shape)) if n[k] < shape[k]), default=0)  # from here on a range is contiguous
    stride = np.cumprod([1, *shape[:0:-1]])[::-1] if shape else np.ones(0, np.int64)
    length = int(np.prod(n[lead:], dtype=np.int64)) * item.itemsize
    start = sum(int(a) * int(s) for a, s in zip(at, stride))
    parts = []
    for index in itertools.product(*(range(x) for x in n[:lead])):
        place = start + sum(i * int(s) for i, s in zip(index, stride))
        part = file.read_at(length, head.offset + place * item.itemsize)
        if len(part) < length:
            raise ValueError("the file ends before the tile does")
        parts.append(part)
    tile = np.frombuffer(b"".join(parts), item).reshape(n)
    return tile.T if head.fortran else tile


register_loader(Loader("npy", npy_head, npy_tile))

HEAD = "shape array<int>, dtype string, dim_order string, late string, offset long, fortran boolean, error string"


def heads(files: DataFrame, loader: str = "npy", dim_order: str | None = None) -> DataFrame:
    """``files`` (``path``) with what their heads say. A file without a readable head has its ``error`` and nulls."""
    load, keep = LOADERS[loader], files.schema.fields

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for path in df["path"]:
                try:
                    with opened(path) as f:
                        h = load.head(f, dim_order)
                    out.append((list(map(int, h.shape)), h.dtype, h.dim_order, h.late, h.offset, h.fortran, None))
                except Exception as e:  # one unreadable file
                    out.append((None, None, None, None, None, None, str(e)))
            yield pd.concat([df, pd.DataFrame(out, columns=[c.split()[0] for c in HEAD.split(", ")], index=df.index).astype({"offset": "Int64", "fortran": "boolean"})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return files.mapInPandas(run, f"{schema}, {HEAD}")


def read_tiles(files: DataFrame, steps: dict[str, int] | None = None, most_bytes: float = 64 << 20, loader: str = "npy", dim_order: str | None = None, dims: str = "YX", partitions: int | None = None) -> DataFrame:
    """Tiles of the arrays at ``files`` (``path``), as ``rasters.tile_records`` gives them: ``values, shape, dim_order, dtype, num_pixels``, ``dim_``, ``size_`` and
    ``full_size_`` of each axis of ``dims``, ``error``.

    The plan (``rasters.tile_plan``) is dealt over ``partitions`` (default: as many as shuffles have) before anything is read, by path and stretches of ``STRETCH`` values, so that one
    large array is read by many tasks and a small one is opened once. A file or tile that can't be read is one row with its ``error``; each row reads its own bytes, so a task that is
    run again reads the same.
    """
    load = LOADERS[loader]
    keep = [f.name for f in files.schema.fields]
    found = heads(files, loader, dim_order)
    axes = [d.lower() for d in dims]
    plan = tile_plan(found.where("error is null"), steps or {}, most_bytes=most_bytes)
    before = F.aggregate(F.arrays_zip("origin", "shape"), F.lit(0).cast("long"), lambda n, x: n * x["shape"] + x["origin"])
    # a number, as a plan is small and would be coalesced into a task that reads everything
    dealt = plan.repartition(partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", F.floor(before / STRETCH))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    places = [f"{p}_{a}" for p in ("dim", "size", "full_size") for a in axes]
    schema = f"{own}, values array<double>, shape array<int>, dim_order string, dtype string, num_pixels long, " + "".join(f"{p} int, " for p in places) + "error string"

    def made(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, values, types, errors = zip(*rows)
        plan = b.take(pa.array(at, pa.int64()))
        gone = pa.array([v is None for v in values])
        ends = np.cumsum([0, *(0 if v is None else v.size for v in values)])
        flat = np.concatenate([np.empty(0), *(v for v in values if v is not None)])
        extents = plan.column("extent").to_pylist()
        where = {p: [] for p in places}
        for order, *of in zip(plan.column("dim_order").to_pylist(), plan.column("origin").to_pylist(), extents, plan.column("shape").to_pylist()):
            for p, numbers in zip(("dim", "size", "full_size"), of):
                place = dict(zip(order.lower(), numbers))
                for a in axes:
                    where[f"{p}_{a}"].append(place.get(a))
        new = {"values": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()), mask=gone), "shape": plan.column("extent"), "dim_order": plan.column("dim_order"), "dtype": pa.array(types, pa.string()), "num_pixels": pa.array([math.prod(x) for x in extents], pa.int64())}
        new |= {p: pa.array(v, pa.int32()) for p, v in where.items()} | {"error": pa.array(errors, pa.string())}
        return pa.RecordBatch.from_arrays([*(plan.column(c) for c in keep), *new.values()], names=[*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        try:
            for b in batches:
                rows, held = [], 0
                columns = (b.column(c).to_pylist() for c in ("path", "shape", "dtype", "dim_order", "late", "offset", "fortran", "origin", "extent"))
                for i, (name, shape, dtype, order, late, offset, fortran, origin, extent) in enumerate(zip(*columns)):
                    values, error = None, None
                    try:
                        if name != path or file is None:
                            path, old, file = name, file, None
                            if old is not None:
                                old.close()
                            file = opened(name)
                        values = load.read(file, Head(tuple(shape), dtype, order, late, offset, fortran), origin, extent).astype(np.float64).ravel()
                        held += values.nbytes
                    except Exception as e:  # one tile
                        error = str(e)
                    rows.append((i, values, np.dtype(dtype).name, error))
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield made(b, rows)
                        rows, held = [], 0
                if rows:
                    yield made(b, rows)
        finally:
            if file is not None:
                file.close()

    tiles = dealt.mapInArrow(run, schema)
    bad = found.where("error is not null").select(*keep, "error")
    return tiles.unionByName(bad, allowMissingColumns=True)


def write_npy(records: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``values`` (``shape``, ``dtype``) of each record as ``folder/<name>.npy`` and gives ``name, path``. A file appears whole or not at all, and a task that is run again writes the same."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for df in parts:
            for key, values, shape, dtype in zip(df[name], df["values"], df["shape"], df["dtype"]):
                part = f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    np.lib.format.write_array(f, np.asarray(values, dtype).reshape(tuple(shape)))
                where.move(part, f"{base}/{key}.npy")
            yield pd.DataFrame({name: df[name], "path": [f"{folder}/{k}.npy" for k in df[name]]})

    return records.select(name, "values", "shape", "dtype").mapInPandas(run, f"`{name}` {records.schema[name].dataType.simpleString()}, path string")


def found_files(spark, folder: str, pattern: str = "*.npy") -> DataFrame:
    """``path`` of the files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
