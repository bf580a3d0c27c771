"""Writing report tables, with where they come from and what their columns mean."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import drop_all_null, ordered, shrink

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``); where none is set a temporary one, in a single process only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN_DIR[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: What columns mean that no metric gives, by name, and by pattern for families whose names depend on the data.
MEANINGS = {
    "path": "where the file is",
    "name": "last part of the path",
    "type": "file, folder, dataset, or sub_file for a part of a container",
    "parent": "the folder it is in",
    "depth": "folders below the base",
    "size_bytes": "size on disk; of a folder the sum of what it holds",
    "file_extension": "extension in lower case, without its dot",
    "modification_date": "when it was changed last",
    "modification_month": "month in which it was changed last",
    "imported_path": "the base under which it was found",
    "imported_path_short": "the base without what all bases share",
    "common_base": "last folder that all bases share",
    "child_id": "which part of its container",
    "obs_level": "number of fixed dimensions (0: the whole array)",
    "num_pixels": "elements covered",
    "ndim": "number of axes",
    "shape": "extent along each axis",
    "dim_order": "a letter for each axis",
    "dtype": "type of the values",
    "capabilities": "what the array can be measured for",
    "nodata_count": "values that stand for no data",
    "errors": "metrics that failed, with their messages",
    "thumbnail": "pixels of a small picture, red, green, blue and alpha",
    "norm_min": "value shown as black in the thumbnail",
    "norm_max": "value shown as white in the thumbnail",
    "thumbnail_dtype": "type of the values that the thumbnail shows",
}
FAMILIES = {
    "^dim_[a-z]+$": "coordinate along an axis, null if free",
    "^size_[a-z]$": "extent along an axis",
    "^full_size_[a-z]$": "extent of the whole array along an axis",
    "^pixel_size_[a-z](_unit)?$": "physical size of an element, or its unit",
    "^channel_names?$": "what the channels show",
    "^hist(ogram)?_?(counts|min|max|lo|hi)?$": "histogram of the values, and its bounds",
    "(?:^|_)count$": "how many there are",
}


def meaning(column: str) -> str | None:
    """What a column means: by name, else as an output of a registered metric, else by family."""
    from ..operators.rasters import REGISTRY

    by_metric = {k: v for m in REGISTRY.values() for k, v in m.meanings.items()}
    family = next((text for pattern, text in FAMILIES.items() if re.search(pattern, column, re.I)), None)
    return MEANINGS.get(column) or by_metric.get(column) or family


def described(df: DataFrame, provenance: dict | None = None) -> DataFrame:
    """``df`` with a comment on each known column, and the provenance on the first one."""

    def meta(i: int, name: str) -> dict:
        text = meaning(name)
        return ({"comment": text} if text else {}) | ({"provenance": json.dumps(provenance)} if provenance and i == 0 else {})

    return df.select(*(F.col(f"`{c}`").alias(c, metadata=m) if (m := meta(i, c)) else F.col(f"`{c}`") for i, c in enumerate(df.columns)))


def write_report(df: DataFrame, path: str, provenance: dict | None = None, small: bool = False) -> None:
    """Parquet, zstd, by ``obs_level`` where there is one. Empty structs become null; ``small``: narrow types, no empty columns."""
    empty = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType) and not f.dataType.fields]
    df = df.withColumns({c: F.lit(None).cast("string") for c in empty}) if empty else df
    held = df.persist(StorageLevel.DISK_ONLY) if small else None  # made once: what its columns hold is asked for twice before it is written
    try:
        df = described(ordered(shrink(drop_all_null(df)) if small else df), provenance)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if held is not None:
            held.unpersist()


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table, provenance); bad or missing provenance is empty.

    Nothing there is a ``FileNotFoundError``, another suffix than ``.parquet`` or what isn't Parquet a ``ValueError``; a folder in which nothing was written is an empty table.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(where):
        raise FileNotFoundError(f"no report at {path}")
    suffix = re.search(r"\.[^./]*$", where.getName())
    if suffix and suffix[0].lower() != ".parquet":
        raise ValueError(f"a .parquet report is expected, not {path}")
    if files.getFileStatus(where).isDirectory() and not any(s.getPath().getName()[:1] not in "._" for s in files.listStatus(where)):
        return spark.createDataFrame([], T.StructType()), {}
    try:
        df = spark.read.parquet(path)
    except (AnalysisException, SparkRuntimeException, Py4JError) as e:
        raise ValueError(f"{path} is not readable as a report: {e}") from e
    for f in df.schema.fields:
        if "provenance" in (f.metadata or {}):
            try:
                return df, json.loads(f.metadata["provenance"])
            except ValueError:
                break
    return df, {}


def merge_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Part files of different columns as one table."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def merged_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Part files as one report: all columns, without those that hold nothing, in narrow types and in order."""
    return ordered(shrink(drop_all_null(merge_parts(spark, paths))))


def export_parquet(report: DataFrame, path: str, where=None, summary: bool = False) -> None:
    """A filtered report: all rows, or those of whole arrays. Column comments stay."""
    rows = report.where("obs_level = 0") if summary else report
    (rows.where(where) if where is not None else rows).drop("file_row_number").write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_csv(report: DataFrame, path: str, where=None) -> None:
    rows = report.where(where) if where is not None else report
    rows = rows.drop(*(c for c in rows.columns if "thumbnail" in c))
    nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    rows = rows.withColumns({c: F.to_json(c) for c in nested} | {f.name: F.base64(f.name) for f in rows.schema.fields if isinstance(f.dataType, T.BinaryType)})
    rows.write.mode("overwrite").option("header", True).csv(path)


def embedding_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, metadata): numbers as a vector with nulls as 0, the rest as text on one line."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    rest = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType | T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers))
    text = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\n\\r\\t]", " ").alias(c) for c in rest]
    return df.select(vector.alias("vector"), *text), df.select(*text)


def export_embeddings(df: DataFrame, path: str) -> None:
    both, _ = embedding_tables(df)
    n = len([f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    rows = both.persist()
    rows.select(*(F.col("vector")[i].alias(f"v{i}") for i in range(n))).write.mode("overwrite").option("sep", "\t").csv(f"{path}/tensors")
    rows.drop("vector").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/metadata")
    rows.unpersist()
