"""Folders walked level by level in tasks: what is a dataset is one record and is not looked into.

Each level is a table of folders; tasks list a folder each through ``pyarrow.fs``. What a level found is written before the next one
starts, so nothing is listed twice, and the driver only learns how many folders are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import extension
from .inventory import common_prefix, distinct_bases
from .sinks import scratch

ENTRY = "path string, base string, kind string, size_bytes long, modification_date timestamp"


def by_extension(*kinds: str) -> Callable[[str], bool]:
    """Whether a folder's name has one of these extensions."""
    ends = tuple("." + k.lower().lstrip(".") for k in kinds)
    return lambda path: path.lower().endswith(ends)


def _listed(folder: str, base: str, is_dataset: Callable[[str], bool] | None) -> list[tuple]:
    """What a folder holds: (path, base, ``file``, ``dataset`` or ``folder``, size, time). A folder that can't be listed holds nothing."""
    where, name = fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
    out = []
    try:
        found = where.get_file_info(fs.FileSelector(name))
    except OSError:  # unreadable, gone, or no folder
        return out
    for x in found:
        kind = "file" if x.type == fs.FileType.File else "dataset" if is_dataset and is_dataset(x.path) else "folder"
        out.append((scheme + x.path, base, kind, x.size if kind == "file" else 0, x.mtime))
    return out


def walk(spark: SparkSession, bases: list[str], accepted: set[str] | str = "all", is_dataset: Callable[[str], bool] | None = None, folders: bool = False, relative_to: str | None = None, partitions: int = 64) -> DataFrame:
    """One row per file and dataset under ``bases``, with ``folders`` also per plain folder (size 0, its own date, no extension).

    ``path, name, type`` (``file``, ``dataset``, ``folder``), ``parent, depth`` (below the base), ``size_bytes, file_extension, modification_date, imported_path,
    common_base`` and, with several bases, ``imported_path_short``. ``accepted``: extensions of files; datasets are taken if theirs is one of them too. A dataset's size is
    0, as what it holds isn't read. A level is dealt over ``partitions`` tasks, more if they would have over a thousand folders each. ``relative_to``: paths below it are given from there, itself as ``.``. Bases that are no folders give nothing.
    """
    own = distinct_bases(bases)

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = [r for path, base in zip(df["path"], df["base"]) for r in _listed(path, base, is_dataset)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])
            yield out.assign(modification_date=pd.to_datetime(out["modification_date"], utc=True))

    folder = scratch(spark, "walk")
    level, left, levels = spark.createDataFrame([(b, b) for b in own], "path string, base string"), len(own), []
    while left:
        listed = level.repartition(min(left, max(partitions, left // 1000)), "path").mapInPandas(step, ENTRY)
        listed.write.parquet(f"{folder}/{len(levels)}")
        levels.append(spark.read.schema(ENTRY).parquet(f"{folder}/{len(levels)}"))
        level = levels[-1].where("kind = 'folder'").select("path", "base")
        left = level.count()
    every = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], ENTRY)
    parts = lambda c: F.size(F.split(c, "/"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = every.select("path", name.alias("name"), F.col("kind").alias("type"), F.regexp_replace("path", "/[^/]*$", "").alias("parent"), (parts("path") - parts("base")).alias("depth"), "size_bytes", F.when(F.col("kind") != "folder", extension(name)).alias("file_extension"), "modification_date", F.col("base").alias("imported_path"))
    prefix = common_prefix(own) if own else ""
    rows = rows.withColumn("common_base", F.lit(prefix.rsplit("/", 1)[-1]))
    if len(own) > 1:
        rows = rows.withColumn("imported_path_short", F.expr(f"substring(imported_path, {len(prefix) + 2})"))
    if accepted != "all":
        kept = F.col("file_extension").isin(sorted(a.lower().lstrip(".") for a in accepted))
        rows = rows.where(kept | (F.col("type") == "folder") if folders else kept)
    if not folders:
        rows = rows.where("type <> 'folder'")
    if relative_to:
        root = relative_to.rstrip("/")
        short = lambda c: F.when(F.col(c) == root, ".").when(F.col(c).startswith(root + "/"), F.substr(c, F.lit(len(root) + 2))).otherwise(F.col(c))
        rows = rows.withColumns({c: short(c) for c in ("path", "parent", "imported_path")})
    return rows
