"""Per-block metrics of numeric arrays, tiles and thumbnails. Blocks are independent: kernels run in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import INT_RANGE, col

SIDE = 64
#: Bytes of values or pixels that a task gathers in Python before it hands them on.
BATCH_BYTES = 4 << 20


def _neighbours(p: np.ndarray) -> np.ndarray:
    """The nine shifted views of the interior."""
    h, w = p.shape
    return np.stack([p[y : h - 2 + y, x : w - 2 + x] for y in range(3) for x in range(3)])


def plane_metrics(p: np.ndarray) -> dict[str, float]:
    """Sharpness, contrast and artefact measures of one plane; NaN where it is too small.

    Pixels that are NaN are left out: of means and deviations, and with them each 3 x 3 window or jump that holds one; a window's contrast is that of its other pixels.
    """
    nan = float("nan")
    out = dict.fromkeys(("michelson_contrast", "mscn_variance", "texture_heterogeneity", "blocking_index", "ringing_index", "laplacian_variance"), nan)
    h, w = p.shape
    known = ~np.isnan(p)

    def fine(a: np.ndarray) -> np.ndarray:
        return a[~np.isnan(a)]

    def mean(a: np.ndarray) -> float:
        a = fine(a)
        return float(a.mean()) if len(a) else nan

    def variance(a: np.ndarray) -> float:
        a = fine(a)
        return float(a.var()) if len(a) else nan

    if h >= 3 and w >= 3 and known.any():
        n = _neighbours(p)
        middle, inner = n.mean(0), p[1:-1, 1:-1]
        local = np.sqrt(np.maximum((n * n).mean(0) - middle * middle, 0))
        sd = fine(p).std()
        if sd > 0:
            out["michelson_contrast"] = mean(np.fmax.reduce(n) - np.fmin.reduce(n)) / float(sd)
        out["mscn_variance"] = variance((inner - middle) / (local + max((np.nanmax(p) - np.nanmin(p)) * 1e-3, 1e-10)))
        if mean(local) > 0:
            out["texture_heterogeneity"] = variance(local) ** 0.5 / mean(local)
        out["ringing_index"] = variance(inner - middle)
        out["laplacian_variance"] = variance(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * inner)
    if h > 8 and w > 8:
        out["blocking_index"] = (mean(np.abs(np.diff(p, axis=1))[:, 7::8]) + mean(np.abs(np.diff(p, axis=0))[7::8])) / 2
    return out


@dataclass
class Metric:
    """A registered kernel: what it needs of a record, what it gives for an array, and how its outputs are added up over blocks (``cube.registered_cube``)."""

    name: str
    outputs: dict[str, str]
    kernel: Callable[[np.ndarray, str], dict]
    axes: str = "YX"
    scope: str = "block"
    aggregates: dict[str, str] = field(default_factory=dict)
    meanings: dict[str, str] = field(default_factory=dict)  # of the outputs, for reports


REGISTRY: dict[str, Metric] = {}


def register_metric(metric: Metric) -> Metric:
    REGISTRY[metric.name] = metric
    return metric


def _planes(a: np.ndarray, order: str) -> dict:
    """Image metrics for each leading index, then the mean without NaN."""
    b = np.moveaxis(a, (order.index("Y"), order.index("X")), (-2, -1)).reshape(-1, a.shape[order.index("Y")], a.shape[order.index("X")])
    each = pd.DataFrame([plane_metrics(p) for p in b])
    return each.mean(skipna=True).to_dict()


def _basic(a: np.ndarray, order: str) -> dict:
    v = a[~np.isnan(a)]
    n = int(np.isfinite(a).sum())
    if not v.size:
        return dict.fromkeys(("min_intensity", "max_intensity", "mean_intensity", "std_intensity"), float("nan")) | {"finite_pixel_count": n}
    with np.errstate(all="ignore"):
        return {"min_intensity": float(v.min()), "max_intensity": float(v.max()), "mean_intensity": float(v.mean()), "std_intensity": float(v.std()), "finite_pixel_count": n}


register_metric(Metric("basic", {"min_intensity": "double", "max_intensity": "double", "mean_intensity": "double", "std_intensity": "double", "finite_pixel_count": "long"}, _basic, "", aggregates={"min_intensity": "min", "max_intensity": "max", "mean_intensity": "mean", "std_intensity": "std:mean_intensity", "finite_pixel_count": "sum"}, meanings={"min_intensity": "least value", "max_intensity": "greatest value", "mean_intensity": "mean of the values", "std_intensity": "deviation of the values from their mean", "finite_pixel_count": "values that are numbers"}))
register_metric(Metric("image", dict.fromkeys(plane_metrics(np.zeros((1, 1))), "double"), _planes, aggregates=dict.fromkeys(plane_metrics(np.zeros((1, 1))), "mean"), meanings={
    "michelson_contrast": "mean range of 3 x 3 windows over the deviation of the plane", "mscn_variance": "variance of pixels normalised by their surroundings", "texture_heterogeneity": "how much local deviation varies, over its mean",
    "blocking_index": "mean jump across borders of 8 x 8 blocks", "ringing_index": "variance of pixels about the mean of their surroundings", "laplacian_variance": "variance of the Laplacian, a measure of sharpness"}))


def measure(records: DataFrame, metrics: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``records`` (``values, shape, dim_order``) without ``values``, with the outputs of the chosen metrics and ``errors``.

    A kernel that fails on a block, or whose axes the block lacks, leaves nulls; its error is noted and the others go on.
    """
    chosen = [m for n, m in REGISTRY.items() if (n in metrics if metrics else n not in exclude)]
    keep = [f for f in records.schema.fields if f.name != "values"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{k} {t}" for m in chosen for k, t in m.outputs.items()] + ["errors array<string>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for values, shape, order in zip(df["values"], df["shape"], df["dim_order"]):
                row, errors = {k: None for m in chosen for k in m.outputs}, []
                for m in chosen:
                    try:
                        if set(m.axes) <= set(order):
                            row |= m.kernel(np.asarray(values, np.float64).reshape(tuple(shape)), order)
                    except Exception as e:  # one kernel on one block
                        errors.append(f"{m.name}: {e}")
                out.append(row | {"errors": errors})
            yield pd.concat([df.drop(columns="values"), pd.DataFrame(out, index=df.index)], axis=1)

    return records.mapInPandas(run, schema)


def failures(measured: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, n_failed, n_rows, example`` of a measured table, for each of ``metrics``, those that never failed too. The example is the first by text."""
    bad = measured.select(F.explode("errors").alias("e")).select(F.regexp_extract("e", "^([^:]*): ", 1).alias("metric"), F.regexp_replace("e", "^[^:]*: ", "").alias("example"))
    counts = bad.groupBy("metric").agg(F.count("*").alias("n_failed"), F.min("example").alias("example"))
    every = measured.agg(F.count("*").alias("n_rows")).select("n_rows", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))  # a row a metric
    return every.join(F.broadcast(counts), "metric", "left").select("metric", F.coalesce("n_failed", F.lit(0).cast("long")).alias("n_failed"), "n_rows", "example")


def observed(measured: DataFrame, metrics: list[str], name: str = "failures") -> tuple[DataFrame, Observation]:
    """``measured`` and what its next action counts on its way: ``rows``, and for each metric the rows on which it failed."""
    def failed(metric: str) -> Column:
        return F.count_if(F.exists("errors", lambda e: e.startswith(metric + ": "))).alias(metric)

    seen = Observation(name)
    return measured.observe(seen, F.count(F.lit(1)).alias("rows"), *map(failed, metrics)), seen


def basic_columns(values: str | Column) -> list[Column]:
    """The basic metrics as expressions on an array column, without Python."""
    v = F.filter(col(values), lambda x: ~F.isnan(x))
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    square = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    finite = F.size(F.filter(v, lambda x: F.abs(x) < float("inf")))
    return [F.array_min(v).alias("min_intensity"), F.array_max(v).alias("max_intensity"), mean.alias("mean_intensity"), F.sqrt(F.try_divide(square, n)).alias("std_intensity"), finite.cast("long").alias("finite_pixel_count")]


def histogram_bounds(lo: Column, hi: Column, dtype: Column) -> tuple[Column, Column]:
    """Range of a block's histogram: its own for floats and wide integers, else a 256-wide window kept inside the type's range."""
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, (a, _) in INT_RANGE.items() for x in (k, float(a)))), dtype), F.lit(0.0))
    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, (_, b) in INT_RANGE.items() for x in (k, float(b)))), dtype), F.lit(0.0))
    own = dtype.startswith("float") | (hi - lo >= 256)
    start = F.when(dtype == "bool", lo).otherwise(F.greatest(F.least(lo, most - 255), least))
    return F.when(own, lo).otherwise(start), F.when(own, hi).otherwise(start + 256)


def block_histograms(records: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """Long histograms ``keys, lo, hi, nan_count, bin, n`` of ``records`` (``values, dtype``). Finite values only.

    A block's values are counted where they are: what leaves is a row for each bin that isn't empty.
    """
    finite = F.filter("values", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    r = records.withColumn("__f", finite).withColumn("nan_count", F.size(F.filter("values", lambda x: F.isnan(x))).cast("long"))
    lo, hi = histogram_bounds(F.array_min("__f"), F.array_max("__f"), F.col("dtype"))
    r = r.select(*keys, lo.alias("lo"), hi.alias("hi"), "nan_count", "__f").where(F.size("__f") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields if f.name != "__f") + ", bin int, n long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            at, bin_, n = [], [], []
            for i, (a, b, v) in enumerate(zip(df["lo"], df["hi"], df["__f"])):
                place = np.clip(np.floor((v - a) / ((b - a) / bins)), 0, bins - 1).astype(np.int64) if b > a else np.zeros(len(v), np.int64)
                counts = np.bincount(place)
                full = np.flatnonzero(counts)
                at.append(np.full(len(full), i))
                bin_.append(full)
                n.append(counts[full])
            if at:
                yield df.drop(columns="__f").iloc[np.concatenate(at)].assign(bin=np.concatenate(bin_), n=np.concatenate(n))

    return r.mapInPandas(run, schema)


def nodata_count(values: str | Column, nodata: str | Column) -> Column:
    """Values equal to the no-data value, NaN included; 0 where there is none."""
    return F.coalesce(F.size(F.filter(col(values), lambda x: x.eqNullSafe(col(nodata).cast("double")))).cast("long"), F.lit(0)) * F.when(col(nodata).isNull(), 0).otherwise(1)


def tile_steps(order: str, shape: list[int], steps: dict[str, int], most: float | None = None, late: str = "") -> list[int]:
    """Extent of a tile along each axis: ``steps`` (default: whole along Y and X, else 1; -1: whole), in larger tiles of whole steps up to ``most`` elements.

    With ``most`` a tile starts as the whole array and is cut only as far as it must be: axes with a step, then those of ``late``, then axes without one
    unless they are pinned by -1. The axes of one such tier share the cut: the longest first, each into as many parts as the root of what is still too
    much, by how many axes are left, rounded up. ``most`` can be exceeded where the steps leave no more to cut.
    """
    step = [steps.get(d, -1 if d in "YX" else 1) for d in order]
    if most is None:
        return [n if s == -1 else min(s, n) for n, s in zip(shape, step)]
    size = list(shape)
    tiers = ([k for k, d in enumerate(order) if step[k] != -1 and (d not in late or d in steps)], [k for k, d in enumerate(order) if step[k] != -1 and d in late and d not in steps], [k for k, d in enumerate(order) if step[k] == -1 and d not in steps])
    for tier in tiers:
        for done, k in enumerate(sorted(tier, key=lambda k: -shape[k])):
            have, n = math.prod(size), shape[k]
            if have <= most:
                break
            one = max(step[k], 1)
            parts = math.ceil((have / most) ** (1 / (len(tier) - done)))
            steps_each = 1 if one * (have // n) >= most else max(1, n // (one * parts))
            size[k] = min(n, steps_each * one)
    return size


def _origins(shape: list[int], size: list[int]) -> Iterator[tuple[int, ...]]:
    for at in np.ndindex(*(-(-n // max(s, 1)) for n, s in zip(shape, size))):
        yield tuple(k * s for k, s in zip(at, size))


def _sizes(steps: dict[str, int], most: float | None, late: str, most_bytes: float | None) -> Callable[[pa.RecordBatch], Iterator[tuple[list[int], list[int]]]]:
    """Of each record of a batch its shape and the extent of its tiles."""

    def of(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[int]]]:
        dtypes = b.column("dtype").to_pylist() if most_bytes else [None] * len(b)
        lates = b.column("late").to_pylist() if "late" in b.schema.names else [late] * len(b)
        for order, shape, dtype, own in zip(b.column("dim_order").to_pylist(), b.column("shape").to_pylist(), dtypes, lates):
            yield shape, tile_steps(order, shape, steps, most_bytes / np.dtype(dtype).itemsize if most_bytes else most, own)

    return of


def tile_grid(records: DataFrame, steps: dict[str, int], most: float | None = None, late: str = "", most_bytes: float | None = None) -> DataFrame:
    """What ``tile_plan`` comes to for each record, without a row per tile: ``extent`` of its largest tile, number of ``tiles`` and of ``pixels`` in all of them."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields] + ["extent array<int>", "tiles long", "pixels long"])
    sizes = _sizes(steps, most, late, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [([min(n, z) for n, z in zip(shape, size)], math.prod(-(-n // max(z, 1)) for n, z in zip(shape, size)), math.prod(shape)) for shape, size in sizes(b)]
            extent, tiles, pixels = zip(*rows) if rows else ((), (), ())
            made = [pa.array(extent, pa.list_(pa.int32())), pa.array(tiles, pa.int64()), pa.array(pixels, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "extent", "tiles", "pixels"])

    return records.mapInArrow(run, schema)


def tile_plan(records: DataFrame, steps: dict[str, int], most: float | None = None, late: str = "", most_bytes: float | None = None) -> DataFrame:
    """One row per tile of ``records`` (``shape, dim_order``; no values are read) with ``origin`` and ``extent`` along each axis (see ``tile_steps``), for loaders to read.

    ``most_bytes`` instead of ``most``: bytes of a tile, by ``dtype``. Where there is a column ``late``, it holds for its record.
    """
    keep = records.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["origin array<int>", "extent array<int>"])
    sizes = _sizes(steps, most, late, most_bytes)

    def lists(cells: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(c.size for c in cells)])
        offsets = np.concatenate([[0], *(at + np.arange(1, len(c) + 1) * c.shape[1] for at, c in zip(ends, cells))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([c.ravel() for c in cells]), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, origins, extents = [], [], []

            def full() -> pa.RecordBatch:
                rows = b.take(pa.array(np.concatenate(take)))
                return pa.RecordBatch.from_arrays([*rows.columns, lists(origins), lists(extents)], names=[*b.schema.names, "origin", "extent"])

            for i, (shape, size) in enumerate(sizes(b)):
                size = np.array(size, np.int64)
                grid = -(-np.array(shape, np.int64) // np.maximum(size, 1))
                n = math.prod(grid.tolist())
                for k in range(0, n, 10_000):
                    at = np.stack(np.unravel_index(np.arange(k, min(n, k + 10_000)), grid), 1) * size if len(grid) else np.zeros((1, 0), np.int64)
                    take.append(np.full(len(at), i))
                    origins.append(at)
                    extents.append(np.minimum(size, shape - at))
                    if sum(map(len, take)) >= 10_000:
                        yield full()
                        take, origins, extents = [], [], []
            if take:
                yield full()

    return records.mapInArrow(run, schema)


def tile_records(records: DataFrame, steps: dict[str, int], dims: str = "YX", most: int | None = None, late: str = "") -> DataFrame:
    """One row per block: ``steps`` along each axis (see ``tile_steps``), origins in ``dim_<axis>``, sizes in ``size_<axis>``, values cut out; the last block may be short.

    A record's whole array is in one row here; larger ones are read tile by tile (``sources.tiles``).
    """
    keep = [f for f in records.schema.fields if f.name not in ("values", "shape")]
    axes = [d.lower() for d in dims]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["values array<double>", "shape array<int>"] + [f"dim_{a} int" for a in axes] + [f"size_{a} int" for a in axes] + [f"full_size_{a} int" for a in axes] + ["num_pixels long"])

    def made(rows: list[tuple]) -> pd.DataFrame:
        whole = [f"{p}_{a}" for p in ("dim", "size", "full_size") for a in axes]
        df = pd.DataFrame(rows, columns=[*(f.name for f in keep), "values", "shape", *whole, "num_pixels"])
        return df.astype(dict.fromkeys(whole, "Int32"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            kept, rows, held = [df[f.name].tolist() for f in keep], [], 0
            for values, shape, order, *own in zip(df["values"], df["shape"], df["dim_order"], *kept):
                a = np.asarray(values, np.float64).reshape(tuple(shape))
                size = tile_steps(order, list(a.shape), steps, most, late)
                where = [order.index(d) if d in order else None for d in dims]
                for at in _origins(list(a.shape), size):
                    block = a[tuple(slice(x, x + s) for x, s in zip(at, size))]
                    place = (of[k] if k is not None else None for of in (at, block.shape, a.shape) for k in where)
                    rows.append((*own, block.ravel(), block.shape, *place, block.size))
                    held += block.nbytes
                    if len(rows) >= 1000 or held >= BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return records.mapInPandas(run, schema)


def _nearest(n: int, m: int) -> np.ndarray:
    """``m`` of ``n`` indices, evenly."""
    return np.round(np.linspace(0, n - 1, m)).astype(int)


def thumbnail_patch(a: np.ndarray, order: str, side: int = SIDE, colour: str = "S") -> np.ndarray:
    """An array as (Y, X, colour): thinned by nearest index to ``side`` pixels along the longer axis, the middle of all other axes, NaN as 0."""
    y, x = order.index("Y"), order.index("X")
    scale = min(1.0, side / max(a.shape[y], 1), side / max(a.shape[x], 1))
    if scale < 1:
        for k in (y, x):
            a = np.take(a, _nearest(a.shape[k], max(1, int(a.shape[k] * scale))), axis=k)
    for k in sorted((k for k, d in enumerate(order) if d not in ("Y", "X", colour)), reverse=True):
        a, order = np.take(a, a.shape[k] // 2, axis=k), order[:k] + order[k + 1 :]
    a = np.moveaxis(a, (order.index("Y"), order.index("X")), (0, 1))
    return np.where(np.isnan(a), 0.0, a).reshape(*a.shape[:2], -1)


def _spot(at: int, n: int, full: int, scale: float, side: int) -> tuple[int, int]:
    """Where part ``at`` to ``at + n`` of an axis goes on the canvas, centred; a pixel at least."""
    used = max(1, round(full * scale))
    pad = (side - used) // 2
    first = pad + round(at * scale)
    return first, min(pad + used, max(first + 1, pad + round((at + n) * scale)))


def _painted(patches: list[tuple], side: int) -> tuple[bytes, float, float]:
    """The canvas of patches (y, x, pixels, least, greatest) and its range: from 0 or the least to the greatest value of all."""
    lo, hi = min((p[3] for p in patches), default=0.0), max((p[4] for p in patches), default=0.0)
    lo, hi = (min(lo, 0.0), hi) if np.isfinite(lo) and np.isfinite(hi) else (0.0, 0.0)
    canvas = np.zeros((side, side, 4), np.uint8)
    for y, x, v, *_ in patches:
        grey = ((v - lo) / (hi - lo) * 255).clip(0, 255) if hi > lo else np.full(v.shape, 255.0 if hi > 0 else 0.0)
        place = canvas[y : y + v.shape[0], x : x + v.shape[1]]
        shown = grey.astype(np.uint8)
        place[..., :3] = shown if shown.shape[2] == 1 else np.pad(shown[..., :3], ((0, 0), (0, 0), (0, max(0, 3 - shown.shape[2]))))
        place[..., 3] = 255
    return canvas.tobytes(), lo, hi


def _patches(df: pd.DataFrame, side: int, colour: str) -> Iterator[tuple | None]:
    """(y, x, pixels, least, greatest) of each tile: the pixels it covers on the record's canvas, and the range of its patch. None for tiles without pixels. One at a time, as a patch can be much larger than its tile."""
    for values, shape, order, y0, x0, ny, nx, fy, fx in zip(df["values"], df["shape"], df["dim_order"], df["dim_y"], df["dim_x"], df["size_y"], df["size_x"], df["full_size_y"], df["full_size_x"]):
        if values is None or not len(values) or not {"Y", "X"} <= set(order):
            yield None
            continue
        patch = thumbnail_patch(np.asarray(values, np.float64).reshape(tuple(shape)), order, side, colour)
        scale = min(side / fy, side / fx)
        (y, y_end), (x, x_end) = _spot(y0, ny, fy, scale, side), _spot(x0, nx, fx, scale, side)
        small = patch[_nearest(patch.shape[0], max(0, y_end - y))[:, None], _nearest(patch.shape[1], max(0, x_end - x))[None, :]]
        yield y, x, small, float(patch.min()), float(patch.max())


THUMBNAIL = "thumbnail binary, norm_min double, norm_max double, thumbnail_dtype string"


def _beside(df: pd.DataFrame, rows: Iterable[tuple[int, tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of ``df`` at the given places with what was made of them beside, handed on whenever ``BATCH_BYTES`` are held."""
    at, made, held = [], [], 0

    def full() -> pd.DataFrame:
        own = df.iloc[at]
        return pd.concat([own, pd.DataFrame(made, columns=names, index=own.index)], axis=1)

    for k, row in rows:
        at.append(k)
        made.append(row)
        held += sum(len(v) for v in row if isinstance(v, bytes))
        if held >= BATCH_BYTES:
            yield full()
            at, made, held = [], [], 0
    if at:
        yield full()


def _with_dtype(records: DataFrame) -> DataFrame:
    return records if "dtype" in records.columns else records.withColumn("dtype", F.lit(None).cast("string"))


def assembled_thumbnails(tiles: DataFrame, rec: list[str], side: int = SIDE, colour: str = "S") -> DataFrame:
    """``rec, thumbnail`` (RGBA bytes), ``norm_min, norm_max, thumbnail_dtype`` from a record's tiles (of ``tile_records``): scaled to fit and centred, from 0 or
    the least to the greatest value. Axis ``colour`` gives red, green and blue (more are left out); without it all three are alike.

    A tile sends one binary patch, the pixels that it covers on the canvas, at least one. Of several tiles at one place (along other axes) the middle one is taken before
    a record's patches meet, so these hold ``side * side`` pixels and one more a place at most. One shuffle, by record. Missing pixels are 0; a record without pixels has no row.
    """
    keys = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in rec)
    other = sorted(c for c in tiles.columns if c.startswith("dim_") and len(c) == 5 and c not in ("dim_y", "dim_x"))
    place = ["dim_y", "dim_x", *(F.coalesce(c, F.lit(0)).alias(c) for c in other)]
    names = ["y", "x", "patch", "lo", "hi", "h", "w"]
    schema = f"{keys}, dim_y int, dim_x int, " + "".join(f"{c} int, " for c in other) + "dtype string, y int, x int, patch binary, lo double, hi double, h int, w int"

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            own = df[[*rec, "dim_y", "dim_x", *other, "dtype"]]
            rows = ((k, (y, x, v.tobytes(), lo, hi, v.shape[0], v.shape[1])) for k, (y, x, v, lo, hi) in ((k, p) for k, p in enumerate(_patches(df, side, colour)) if p is not None))
            yield from _beside(own, rows, names)

    needed = ["values", "shape", "dim_order", "size_y", "size_x", "full_size_y", "full_size_x", "dtype"]
    patches = _with_dtype(tiles).select(*rec, *place, *needed).mapInPandas(thin, schema).repartition(*rec)  # serves the windows too
    if other:
        at = Window.partitionBy(*rec, "dim_y", "dim_x")
        patches = patches.withColumns({"__i": F.row_number().over(at.orderBy(*other)) - 1, "__n": F.count("*").over(at)}).where(F.col("__i") == F.floor(F.col("__n") / 2)).drop("__i", "__n")

    def paint(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def close() -> tuple:
            every = [(y, x, np.frombuffer(z).reshape(h, w, -1) if h and w else np.zeros((h, w, 1)), lo, hi) for y, x, z, lo, hi, h, w, _ in held]
            return (*now, *_painted(every, side), held[len(held) // 2][-1])

        def made(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=[*rec, *(c.split()[0] for c in THUMBNAIL.split(", "))])

        for df in parts:
            out = []
            for row in zip(*(df[c].tolist() for c in [*rec, *names, "dtype"])):
                key = tuple(None if k != k else k for k in row[: len(rec)])  # missing keys are one record
                if key != now:
                    if held:
                        out.append(close())
                    now, held = key, []
                    if len(out) * side * side * 4 >= BATCH_BYTES:
                        yield made(out)
                        out = []
                held.append(row[len(rec) :])
            yield made(out)
        if held:
            yield made([close()])

    return patches.sortWithinPartitions(*rec, "dim_y", "dim_x").mapInPandas(paint, f"{keys}, {THUMBNAIL}")


def thumbnails(records: DataFrame, rec: list[str], side: int = SIDE, colour: str = "S") -> DataFrame:
    """``assembled_thumbnails`` of whole records, one row each: painted where they are read."""
    keys = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in rec)

    def paint(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            n = {d: [s[o.index(d)] if d in o else 0 for s, o in zip(df["shape"], df["dim_order"])] for d in "YX"}
            every = _patches(df.assign(dim_y=0, dim_x=0, size_y=n["Y"], size_x=n["X"], full_size_y=n["Y"], full_size_x=n["X"]), side, colour)
            own = df[[*rec, "dtype"]].rename(columns={"dtype": "thumbnail_dtype"})
            yield from _beside(own, ((k, _painted([p], side)) for k, p in enumerate(every) if p is not None), ["thumbnail", "norm_min", "norm_max"])

    return _with_dtype(records).select(*rec, "values", "shape", "dim_order", "dtype").mapInPandas(paint, f"{keys}, {THUMBNAIL}")


def denormalise(thumbs: DataFrame, dtype: str) -> DataFrame:
    """``thumbs`` with ``thumbnail`` moved from its own scale to the range of ``dtype`` (floats stay)."""

    @F.pandas_udf("binary")
    def move(blob: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        a, b = INT_RANGE.get(dtype, (None, None))
        out = []
        for raw, x, y in zip(blob, lo, hi):
            p = np.frombuffer(raw, np.uint8).reshape(-1, 4).copy()
            if a is not None:
                p[:, :3] = ((x + p[:, :3] / 255 * (y - x) - a) / (b - a) * 255).clip(0, 255)
            out.append(p.tobytes())
        return pd.Series(out)

    return thumbs.withColumn("thumbnail", move("thumbnail", "norm_min", "norm_max"))
