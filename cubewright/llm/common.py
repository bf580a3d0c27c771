"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir

#: What counts as a word everywhere in this folder: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_MADE: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lineage ends there and nothing is computed twice. ``release`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def made() -> int:
    """How many tables ``written`` has made so far: where ``release`` is to start."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables made since then. Only once nothing that reads them is still to run."""
    while len(_MADE) > since:
        delete(spark, _MADE.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = "__" + n
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most`` rows at most; beyond that Spark joins it by shuffle.

    ``df`` should be a written table: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: texts can be long, and a worker holds a batch at once.

    Spark reads the setting when a query runs, so it stays for the session; a lower one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space (0x09-0x0D, 0x20)."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text starts (one more entry for the end)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each place on as a number; ``data`` has 8 bytes more after the last place."""
    w = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(np.uint64).ravel()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(size >= 8, w, w & ~(full << (np.minimum(size, 7).astype(np.uint64) << np.uint64(3))))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places: eight bytes at a time through a bijective mix, the length first; XXH3 for words of over 64 bytes.

    Not from prefix sums: sums of powers modulo 2**64 are alike for some pairs of long words, whatever the base.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    size = stops - starts
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(size)), 0
    while len(live):
        h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + eight(data, starts[live] + at, size[live] - at))
        at += 8
        live = live[(size[live] > at) & (size[live] <= 64)]
    raw = memoryview(data)
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : stops[i]])
    return h


class Rolling:
    """Hashes of any substrings of a byte array in constant time each, from prefix sums of ``byte * base**i`` modulo 2**64.

    Some different strings have equal hashes: only for choosing and grouping, where what is grouped is compared afterwards.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        up, self.down = self._table(base | 1, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] * up[: len(data)], out=self.sums[1:])

    @classmethod
    def _table(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = pow(base, -1, 1 << 64)
            both = []
            for b in (base, inverse):
                a = np.empty(size, np.uint64)
                a[0], have, step = 1, 1, b
                while have < size:
                    a[have : 2 * have] = a[:have] * np.uint64(step)
                    have, step = 2 * have, step * step & (1 << 64) - 1
                both.append(a)
            if size > 1 << 24:  # not kept: a single text of this size is rare
                return both[0], both[1]
            cls._powers[base] = (both[0], both[1])
        return cls._powers[base]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])
