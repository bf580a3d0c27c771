"""Files as rows, and arrays out of files."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ancestors, base_of, extension


def distinct_bases(bases: list[str]) -> list[str]:
    """Base folders without those that lie in another."""
    clean = sorted({b.rstrip("/") for b in bases})
    return [b for b in clean if not any(b != o and b.startswith(o + "/") for o in clean)]


def scan(spark: SparkSession, bases: list[str], accepted: set[str] | str = "all", folder_ext: str | set[str] | None = None) -> DataFrame:
    """One row per file (or folder dataset with an extension of ``folder_ext``) under ``bases``. Contents are not read.

    ``path, name, type, parent, depth, size_bytes, file_extension, modification_date, imported_path, common_base`` and, with
    several bases, ``imported_path_short``. A folder dataset has the summed size and the latest date of its files.
    """
    own = distinct_bases(bases)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(own).select("path", "length", "modificationTime")
    files = raw.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    if folder_ext:
        kinds = "|".join(re.escape(x.lstrip(".")) for x in ({folder_ext} if isinstance(folder_ext, str) else folder_ext))
        inside = F.regexp_extract("path", rf"^(.*?\.(?:{kinds}))(?:/.*)?$", 1)
        files = files.withColumn("__f", F.nullif(inside, F.lit("")))
        files = files.groupBy(F.coalesce("__f", "path").alias("path"), F.when(F.col("__f") != F.col("path"), "folder").otherwise("file").alias("type")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    else:
        files = files.withColumn("type", F.lit("file"))
    base = base_of("path", own)
    prefix = common_prefix(own)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "type", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modification_date"), base.alias("imported_path"))
    out = out.withColumns({"file_extension": extension("name"), "common_base": F.lit(prefix.rsplit("/", 1)[-1])})
    if len(own) > 1:
        out = out.withColumn("imported_path_short", F.expr(f"substring(imported_path, {len(prefix) + 2})"))
    return out if accepted == "all" else out.where(F.col("file_extension").isin(sorted(a.lower().lstrip(".") for a in accepted)))


def common_prefix(paths: list[str]) -> str:
    """The longest folder that all paths share, part by part."""
    first, *rest = (p.split("/") for p in paths)
    n = next((i for i, x in enumerate(first) if any(len(r) <= i or r[i] != x for r in rest)), len(first))
    return "/".join(first[:n])


def inventory_only(files: DataFrame) -> DataFrame:
    """A table for reports without any array: each file a whole observation."""
    return files.withColumn("obs_level", F.lit(0))


def with_folders(files: DataFrame) -> DataFrame:
    """Folder rows for all parents, with the sizes of what they hold; null parent at the root."""
    up = files.select("size_bytes", F.explode(ancestors("path", include_self=False)).alias("path")).where("path <> ''")
    sums = up.groupBy("path").agg(F.sum("size_bytes").alias("size_bytes"))
    parent = F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(""))
    rows = sums.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("folder").alias("type"), parent.alias("parent"), (F.size(F.split("path", "/")) - 1).alias("depth"), "size_bytes")
    return files.unionByName(rows, allowMissingColumns=True)


def folder_sizes(tree: DataFrame) -> DataFrame:
    """Folder rows of ``path, type, size_bytes`` with the sum of all files below, 0 for empty ones."""
    sums = tree.where("type = 'file'").select("size_bytes", F.explode(ancestors("path", include_self=False)).alias("path")).groupBy("path").agg(F.sum("size_bytes").alias("total"))
    folders = tree.where("type = 'folder'").drop("size_bytes").join(sums, "path", "left")
    return folders.withColumn("size_bytes", F.coalesce("total", F.lit(0).cast("long"))).drop("total")


def npy_records(spark: SparkSession, paths: list[str], dim_order: str | None = None) -> DataFrame:
    """``path, values, shape, dtype, dim_order, error`` of ``.npy`` files. A file that can't be read has its error and nulls."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for path, content in zip(df["path"], df["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    order = dim_order if dim_order and len(dim_order) == a.ndim else "ABCDEFGHIJKLMNOP"[: max(a.ndim - 2, 0)] + "YX"[-a.ndim :]
                    out.append((path, a.astype(np.float64).ravel(), list(a.shape), str(a.dtype), order, None))
                except Exception as e:  # one unreadable file
                    out.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "values", "shape", "dtype", "dim_order", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(paths).select("path", "content")
    return files.mapInPandas(load, "path string, values array<double>, shape array<int>, dtype string, dim_order string, error string")


def file_frame(files: DataFrame) -> DataFrame:
    """Month of change and the name after the common base."""
    return files.withColumns({"modification_month": F.month("modification_date"), "file_extension": F.coalesce("file_extension", extension("name"))})
