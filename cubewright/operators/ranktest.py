"""Ranks and pairwise rank tests without a global sort in one task.

Distinct values are dealt into ranges by value; as many as there are shuffle partitions, so they grow with the rows. A range is
sorted and passes by in a stream, so a task holds a batch and a number for each group it has met. What ranges have to know of
each other is one row for each range (and group).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_two_sided, stars
from ..sources.sinks import scratch

#: Cells of the tables that a range's batch is worked on in.
CELLS = 1 << 21


def _once(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder: what is read twice must have been dealt into the same ranges."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_ranges(counts: DataFrame) -> DataFrame:
    return counts.repartitionByRange("value").sortWithinPartitions("value")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value, rank``: for each distinct value the mean of the row numbers of its rows; null and NaN have none."""
    v = F.col(value)
    known = v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[value] in ("double", "float") else v.isNotNull()
    counts = df.where(known).groupBy(v.alias("value")).agg(F.count("*").alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for b in parts:
            upto = before + b["n"].cumsum()
            yield b.assign(before=upto - b["n"], part=part)
            before = int(upto.iloc[-1]) if len(b) else before

    kind = counts.schema["value"].dataType.simpleString()
    ranges = _once(_in_ranges(counts).mapInPandas(run, f"value {kind}, n long, before long, part int"), "ranks")
    totals = ranges.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row a range
    return ranges.join(F.broadcast(offsets), "part").select("value", (F.col("offset") + F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


class _Pairs:
    """Of some rows in order of value: for each pair of groups how often the first is above the second, ties by half."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.seen = np.zeros(0)
        self.above = np.zeros((0, 0))

    def add(self, value: np.ndarray, group: list[str], n: np.ndarray) -> None:
        """Rows of whole values: none of them comes again."""
        g = np.array([self.place.setdefault(x, len(self.place)) for x in group])
        more = len(self.place) - len(self.seen)
        self.seen, self.above = np.pad(self.seen, (0, more)), np.pad(self.above, ((0, more), (0, more)))
        new = np.concatenate([[True], value[1:] != value[:-1]])
        row = np.cumsum(new) - 1
        here = np.zeros((row[-1] + 1, len(self.seen)))
        here[row, g] = n
        upto = self.seen + np.cumsum(here, 0)
        below = (upto - here / 2)[row] * n[:, None]
        order = np.argsort(g, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0]))
        self.above[g[order][starts]] += np.add.reduceat(below[order], starts)
        self.seen = upto[-1]

    def stream(self, parts: Iterator[pd.DataFrame]) -> None:
        held: pd.DataFrame | None = None  # rows of the last value, of which there may be more
        for b in parts:
            b = pd.concat([held, b]) if held is not None else b
            last = b["value"].to_numpy() == b["value"].iloc[-1] if len(b) else np.zeros(0, bool)
            held, b = b[last], b[~last]
            self._chunks(b)
        if held is not None:
            self._chunks(held)

    def _chunks(self, b: pd.DataFrame) -> None:
        v, g, n = b["value"].to_numpy(), b["g"].tolist(), b["n"].to_numpy(float)
        at = 0
        while at < len(v):
            end = min(len(v), at + max(1, CELLS // (len(self.place) + 64)))
            while end < len(v) and v[end] == v[end - 1]:
                end += 1
            self.add(v[at:end], g[at:end], n[at:end])
            at = end


def mann_whitney(df: DataFrame, value: str, group: str, groups: list[str] | None = None) -> DataFrame:
    """All pairs of groups (or of ``groups``), as text: U, z, p by the normal approximation without corrections, Bonferroni-adjusted; p is 1 below three rows.

    Each range gives, for the groups that it holds, how often one is above another in it; rows of earlier ranges come in by the ranges' totals. So no
    row is sent once for each group. Null and NaN values don't count.
    """
    v, g = F.col(value).cast("double"), F.col(group)
    place = F.array_position(F.array(*map(F.lit, groups)).cast("array<string>"), g.cast("string")) if groups is not None else g
    rows = df.where(g.isNotNull() & (g.isin(groups) if groups is not None else F.lit(True))).select(g.cast("string").alias("g"), place.alias("place"), v.alias("value"))
    counts = rows.where("value is not null and not isnan(value)").groupBy("value", "g").agg(F.count("*").alias("n"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, pairs = TaskContext.get().partitionId(), _Pairs()
        pairs.stream(parts)
        who = np.array(list(pairs.place), object)
        yield pd.DataFrame({"part": part, "g": who, "h": None, "u": pairs.seen})
        for k in range(len(who)):
            met = np.flatnonzero((pairs.above[k] > 0) & (np.arange(len(who)) != k))
            yield pd.DataFrame({"part": part, "g": who[k], "h": who[met], "u": pairs.above[k][met]})

    sent = _once(_in_ranges(counts).mapInPandas(run, "part int, g string, h string, u double"), "pairs")
    totals = sent.where("h is null").select("part", "g", F.col("u").alias("n"))
    in_order = Window.partitionBy("g").orderBy("part")
    last = totals.agg(F.max("part").alias("last"))  # one row
    steps = totals.select("g", F.sum("n").over(in_order).alias("m"), "part", F.lead("part").over(in_order).alias("next")).crossJoin(F.broadcast(last))
    # how many rows of a group are in earlier ranges, for each range after its first one
    until = F.coalesce("next", "last")
    earlier = steps.where(F.col("part") < until).select(F.explode(F.sequence(F.col("part") + 1, until)).alias("part"), F.col("g").alias("h"), "m")
    across = totals.join(earlier, "part").where("g <> h").select("g", "h", (F.col("n") * F.col("m")).alias("u"))
    u = sent.where("h is not null").select("g", "h", "u").unionByName(across).groupBy("g", "h").agg(F.sum("u").alias("u"))
    known = F.count_if(F.col("value").isNotNull() & ~F.isnan("value"))
    groups_in_order = Window.orderBy("place")  # a row a group
    sized = rows.groupBy("g", "place").agg(known.alias("n")).withColumns({"i": F.row_number().over(groups_in_order), "of": F.count("*").over(Window.partitionBy())})
    later = sized.where("i > 1").select(F.col("g").alias("h"), F.col("n").alias("n_b"), "of", F.explode(F.sequence(F.lit(1), F.col("i") - 1)).alias("i"))
    pairs = later.join(sized.select("i", "g", F.col("n").alias("n_a")), "i")
    out = pairs.join(u, ["g", "h"], "left").select(F.col("g").alias("a"), F.col("h").alias("b"), "n_a", "n_b", F.coalesce("u", F.lit(0.0)).alias("u"), (F.col("of") * (F.col("of") - 1) / 2).alias("pairs"))
    sd = F.sqrt(F.col("n_a").cast("double") * F.col("n_b") * (F.col("n_a") + F.col("n_b") + 1) / 12)
    z = F.try_divide(F.col("u") - F.col("n_a").cast("double") * F.col("n_b") / 2, sd)
    out = out.withColumn("z", z).withColumn("p", F.when((F.col("n_a") < 3) | (F.col("n_b") < 3), 1.0).otherwise(F.least(F.lit(1.0), normal_two_sided(F.col("z")))))
    return out.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.col("pairs"))).drop("pairs").withColumn("sign", stars(F.col("p_adj")))
