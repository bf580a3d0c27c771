"""An observation cube that grows with each micro-batch: batches leave mergeable partial rows, and no earlier row is measured again.

A partial row belongs to a record and a subset of its coordinates. It holds sums, extremes, and for means and deviations the weight, the mean and the
centred squares, which are merged about the common mean, so that little cancels. Which dimensions of a record are active can
change as more of it arrives, so partial rows are kept for every subset and chosen when the cube is read.

Each batch is a folder of its own number: one that runs again replaces itself. ``compact`` merges all batches so far into one
folder; a batch that runs again after that is already in it and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import all_of, nan_aggregate, nullif_nan, nullif_nonfinite


@dataclass
class IncrementalCube:
    """``metrics`` and ``weight`` as in ``cube.observation_cube``; all of ``dims`` can be active."""

    path: str
    rec: list[str]
    dims: list[str]
    metrics: dict[str, str]
    weight: str | None = None
    _keys: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._keys = [*self.rec, *self.dims, "__set"]

    # -- partial rows -------------------------------------------------------------------------------------------------

    def partials(self, leaf: DataFrame) -> DataFrame:
        """Partial rows of some leaf rows: a set of grouping sets over all dimensions, each leaf added to its own."""
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        types = dict(leaf.dtypes)
        rows = leaf.select(*self.rec, *self.dims, *(F.col(d).alias(f"__at_{d}") for d in self.dims), *(c for name, how in self.metrics.items() for c in self._single(name, how, w, types[name])))
        sets = [[d for k, d in enumerate(self.dims) if mask >> k & 1] for mask in range(1 << len(self.dims))]
        mask = sum(((1 - F.grouping(d)) * (1 << k) for k, d in enumerate(self.dims)), F.lit(0)).cast("int").alias("__set")
        facts = [f(f"__at_{d}").alias(f"__{n}_{d}") for d in self.dims for n, f in (("min", F.min), ("max", F.max))]
        centred = self._about(rows, self.rec)  # one centre a record: rows are not sent by coordinate twice
        if not self.dims:
            return centred.groupBy(*self.rec).agg(F.lit(0).alias("__set"), *self._sums())
        return centred.groupingSets([[*self.rec, *s] for s in sets], *self.rec, *self.dims).agg(mask, *facts, *self._sums())

    def _single(self, name: str, how: str, w: Column, kind: str) -> list[Column]:
        """A leaf's own state: a mean of weight ``w`` whose centred squares are those of its deviation."""
        c = F.col(name)
        if how == "sum":
            return [(c.cast("long") if kind in ("int", "bigint", "smallint", "tinyint") else nullif_nan(c)).alias(f"{name}__s")]
        if how in ("min", "max"):
            return [c.alias(f"{name}__s")]
        value = nullif_nonfinite(c)
        if how == "mean":
            return [F.when(value.isNotNull(), w).alias(f"{name}__w"), value.alias(f"{name}__m"), F.lit(0.0).alias(f"{name}__q"), F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias(f"{name}__n"), value.alias(f"{name}__t")]
        mean = nullif_nonfinite(how.partition(":")[2])
        both = value.isNotNull() & mean.isNotNull()
        return [F.when(both, w).alias(f"{name}__w"), F.when(both, mean).alias(f"{name}__m"), F.when(both, w * value * value).alias(f"{name}__q"), F.lit(0).cast("long").alias(f"{name}__n"), F.lit(0.0).alias(f"{name}__t")]

    def _weighed(self) -> list[str]:
        return [n for n, how in self.metrics.items() if how not in ("sum", "min", "max")]

    def _about(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``rows`` with a common centre for each weighed metric of the rows of a key."""
        at = Window.partitionBy(*keys)
        centre = {f"{n}__c": F.coalesce(F.try_divide(F.sum(F.col(f"{n}__w") * F.col(f"{n}__m")).over(at), F.sum(f"{n}__w").over(at)), F.lit(0.0)) for n in self._weighed()}
        return rows.withColumns(centre) if centre else rows

    def _sums(self) -> list[Column]:
        """States of several rows as one. Means and squares about a row's centre, moved to the common mean."""
        out: list[Column] = []
        for n, how in self.metrics.items():
            s = F.col(f"{n}__s")
            if how == "sum":
                out.append(F.sum(s).alias(f"{n}__s"))
            elif how in ("min", "max"):
                out.append(nan_aggregate(F.min if how == "min" else F.max, s).alias(f"{n}__s"))
            else:
                w, m, q, c = (F.col(f"{n}__{k}") for k in "wmqc")
                weight, off = F.sum(w), F.sum(w * (m - c))
                shift = F.try_divide(off, weight)  # of the common mean from the centre
                out += [
                    weight.alias(f"{n}__w"),
                    F.when(weight > 0, F.max(c) + shift).alias(f"{n}__m"),
                    F.greatest(F.lit(0.0), F.sum(q + w * (m - c) * (m - c)) - F.coalesce(weight * shift * shift, F.lit(0.0))).alias(f"{n}__q"),
                    F.sum(f"{n}__n").alias(f"{n}__n"),
                    F.sum(f"{n}__t").alias(f"{n}__t"),
                ]
        return out

    def merged(self, partial: DataFrame) -> DataFrame:
        """Partial rows of several batches as one for each record and subset of coordinates."""
        facts = [f(f"__{n}_{d}").alias(f"__{n}_{d}") for d in self.dims for n, f in (("min", F.min), ("max", F.max))]
        return self._about(partial, self._keys).groupBy(*self._keys).agg(*facts, *self._sums())

    # -- folders ------------------------------------------------------------------------------------------------------

    def _folders(self, spark: SparkSession) -> list[tuple[int, int, str]]:
        """(first batch, last batch, folder) of what holds: the widest compacted folder and the batches after it. Unfinished folders don't count."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(root):
            return []
        found = []
        for s in files.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("batches=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                first, last = map(int, name.removeprefix("batches=").split("-"))
                found.append((first, last, s.getPath().toString()))
        whole = max((x for x in found if x[0] == 0 and x[1] > 0), key=lambda x: x[1], default=None)
        return sorted([whole] + [x for x in found if x[0] > whole[1]] if whole else found)

    def add(self, leaf: DataFrame, number: int) -> None:
        """Partial rows of a batch, unless a compacted folder has them."""
        held = self._folders(leaf.sparkSession)
        if not any(first <= number <= last and (first, last) != (number, number) for first, last, _ in held):
            self.partials(leaf).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batches={number}-{number}")

    def _read(self, spark: SparkSession) -> DataFrame:
        held = self._folders(spark)
        if not held:
            raise ValueError(f"no batch yet in {self.path}")
        return reduce(DataFrame.unionByName, (spark.read.parquet(p) for _, _, p in held))

    def compact(self, spark: SparkSession) -> None:
        """All batches so far in one folder. Batches are numbered from 0 without gaps, as Structured Streaming does; folders that it replaces stay until ``vacuum``."""
        held = self._folders(spark)
        if len(held) > 1:
            self.merged(self._read(spark)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batches=0-{held[-1][1]}")

    def vacuum(self, spark: SparkSession) -> None:
        """Deletes folders that a compacted one holds. Only when nobody reads them."""
        kept = {p for _, _, p in self._folders(spark)}
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for s in files.listStatus(root):
            if s.getPath().toString() not in kept and s.getPath().getName().startswith("batches="):
                files.delete(s.getPath(), True)

    # -- the cube -----------------------------------------------------------------------------------------------------

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """``rec, dims, obs_level`` and the metrics of everything so far, as ``cube.observation_cube`` gives them for all leaf rows at once."""
        m = self.merged(self._read(spark))
        if self.dims:
            whole = m.where("__set = 0").select(*self.rec, *(F.coalesce(F.col(f"__min_{d}") < F.col(f"__max_{d}"), F.lit(False)).alias(f"__act_{d}") for d in self.dims))
            fixed = {d: F.col("__set").bitwiseAND(1 << k) != 0 for k, d in enumerate(self.dims)}
            same = [F.col(f"__m.{r}").eqNullSafe(F.col(f"__w.{r}")) for r in self.rec]
            j = m.alias("__m").join(whole.alias("__w"), reduce(lambda a, b: a & b, same))
            j = j.where(all_of(~f | (F.col(f"__act_{d}") & F.col(f"__m.{d}").isNotNull()) for d, f in fixed.items()))
            m = j.select("__m.*")
        level = sum((F.col("__set").bitwiseAND(1 << k) / (1 << k) for k in range(len(self.dims))), F.lit(0)).cast("int").alias("obs_level")
        return m.select(*self.rec, *self.dims, level, *(self._value(n, how).alias(n) for n, how in self.metrics.items()))

    def _value(self, n: str, how: str) -> Column:
        if how in ("sum", "min", "max"):
            return F.col(f"{n}__s")
        if how == "mean":
            return F.when(F.col(f"{n}__w") > 0, F.col(f"{n}__m")).otherwise(F.try_divide(f"{n}__t", F.col(f"{n}__n").cast("double")))
        return F.when(F.col(f"{n}__w") > 0, F.sqrt(F.try_divide(F.col(f"{n}__q"), F.col(f"{n}__w"))))


def ingest_cube(records: DataFrame, cube: IncrementalCube, checkpoint: str, process: Callable[[DataFrame], DataFrame], every: int = 16) -> StreamingQuery:
    """Kernels of each micro-batch, and its partial rows into ``cube``; all that is there now. Folders are merged after each ``every`` batches."""

    def batch(df: DataFrame, number: int) -> None:
        cube.add(process(df), number)
        if number and number % every == 0:
            cube.compact(df.sparkSession)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completed(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An aggregation of a stream, written whole after each batch into a folder of its number; ``latest`` reads the last one."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return result.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    last = df.agg(F.max("batch")).first()[0]
    return df.where(F.col("batch") == last).drop("batch")
