"""Periodic runs: stretches of words that repeat themselves right away, and texts without the repeats.

Online sparse diagonal DP. Word ``i`` and its earlier occurrence ``i - lag`` are a cell of diagonal ``lag``; cells that follow
each other on a diagonal add up to its match length, and a diagonal that ends with enough of them is a run at once. A run of
period ``q`` has at least ``3 * q`` matches, so single words need not open diagonals: for lags from ``first`` up to ``end`` a
cell counts where the word *with the ``size`` words from it on* (``size = 3 * first``) occurs earlier, nearest occurrence only.
That is exact: two lags of one class add up to ``size`` at most, so of two occurrences of a context nearer than that the
farther one is no smallest period (Fine and Wilf). So each word has one cell a class at most, with some 2.5 * log2(n) classes,
instead of one for each earlier occurrence, which a text of one repeated word would make n**2 / 2.

Contexts have exact names, not hashes: those of a class are pairs of names of the class before, and only what occurs again in
its text goes on, so most texts leave after the first classes.

Edge cases: null and empty texts have no words and no runs, and nothing is left of them; a missing ``doc_id`` is never rewritten
in ``op13_runs``; repeated rows are treated alike; an empty table gives an empty result; other columns pass through
``periodic_runs``, but one that has its result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, text_or_empty

#: Words looked at together, but for a longer text.
TOGETHER = 1 << 19
PERIODIC = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, end of lags, words of a context) for texts of so many words."""
    first, end, size = 1, 3, 5
    while 4 * first <= longest:
        yield first, end, size
        first, end = end, (3 * end + 3) // 2
        size = 3 * first


class Names:
    """Where contexts of ``size`` words that occur at least twice in their text start, and exact names for them."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray):
        """``ids``: a number for each word, different between texts; ``owner``: its text."""
        self.owner, self.size, self.at = owner, 1, np.arange(len(ids))
        self.name = np.full(len(ids), -1, np.int64)
        self._keep(ids, 4)  # a run has each of its words four times

    def _keep(self, key: np.ndarray, least: int = 2) -> None:
        _, label, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[label] >= least
        self.name[self.at] = np.where(again, label, -1)
        self.at, self.label, self.many = self.at[again], label[again], len(count)

    def grow(self, size: int) -> None:
        while self.size < size:
            to = min(size, 2 * self.size)
            last, step = self.at + to - 1, to - self.size
            inside = last < len(self.name)
            inside[inside] = self.owner[last[inside]] == self.owner[self.at[inside]]
            ahead = np.full(len(self.at), -1, np.int64)
            ahead[inside] = self.name[self.at[inside] + step]
            self.name[self.at[ahead < 0]] = -1
            self.at, key = self.at[ahead >= 0], (self.label * self.many + ahead)[ahead >= 0]
            self._keep(key)
            self.size = to

    def cells(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Words whose context's nearest earlier occurrence is at a lag of the class, in order, and the lag."""
        order = np.argsort(self.label, kind="stable")
        at, label = self.at[order], self.label[order]
        lag = at[1:] - at[:-1]
        ok = (label[1:] == label[:-1]) & (lag >= first) & (lag < end)
        at, lag = at[1:][ok], lag[ok]
        order = np.argsort(at)
        return at[order], lag[order]


def find_runs(ids: np.ndarray, owner: np.ndarray, longest: int) -> np.ndarray:
    """Rows (place of the first word, length, period) of all runs, by place and period."""
    names, found = Names(ids, owner), [np.zeros((0, 3), np.int64)]
    for first, end, size in lag_classes(longest):
        names.grow(size)
        if not len(names.at):
            break
        at, lag = names.cells(first, end)
        if not len(at):
            continue
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(lag) != 0)]))
        closes = np.concatenate([opens[1:], [len(at)]]) - 1
        period, matches = lag[opens], at[closes] - at[opens] + size
        done = matches >= np.maximum(6 - period, 3 * period)
        found.append(np.stack([at[opens] - period, matches + period, period], 1)[done])
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _together(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for t in texts:
        held.append(t.split())  # of bytes: at ASCII white space only
        n += len(held[-1])
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def _batch(words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(runs in words of their text, texts without repeats, runs of each text)"""
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    ids, used = np.empty(sizes.sum(), np.int64), 0
    for ws, s in zip(words, starts.tolist()):
        own: dict[bytes, int] = {}
        ids[s : s + len(ws)] = [own.setdefault(w, len(own)) for w in ws]
        ids[s : s + len(ws)] += used
        used += len(own)
    owner = np.repeat(np.arange(len(words)), sizes)
    runs = find_runs(ids, owner, int(sizes.max(initial=0)))
    of = owner[runs[:, 0]]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    some = set(of.tolist())
    texts = [b" ".join(compress(ws, keep[s : s + len(ws)].tolist()) if k in some else ws) for k, (ws, s) in enumerate(zip(words, starts.tolist()))]
    runs[:, 0] -= starts[of]
    return runs, texts, np.bincount(of, minlength=len(words))


def _detect(col: pa.Array) -> pa.Array:
    raw = [t or b"" for t in col.cast(pa.large_binary()).to_pylist()]
    runs, texts, counts = [np.zeros((0, 3), np.int64)], [], [np.zeros(1, np.int64)]
    for words in _together(raw):
        r, t, c = _batch(words)
        runs.append(r)
        texts += t
        counts.append(c)
    every = np.concatenate(runs)
    each = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), each)
    return pa.StructArray.from_arrays([lists, pa.array(texts, pa.string())], names=["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", result: str = "periodic") -> DataFrame:
    """``docs`` with ``result``: ``runs`` (start, length and period in words, by start and period) and ``collapsed``, the text
    without what any run holds after its first period, its words joined by one space."""
    small_batches(docs.sparkSession)
    (words,) = fresh(docs, "words")
    names = [c for c in docs.columns if c != result]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), text_or_empty(text).alias(words))
    kind = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in names)).schema.fields, T.StructField(result, T._parse_datatype_string(PERIODIC))])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _detect(b.columns[-1])], names=[*names, result])

    return rows.mapInArrow(detect, kind)


def rewritten(id_col: str = "doc_id", text: str = "text") -> Column:
    """The text in which, for a tenth of the ids, the words from some place on repeat periodically."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    # one array of words, bound to a name, so that it isn't split again for each word
    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), turned)[0], F.lit(""))).otherwise(text_or_empty(text))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = periodic_runs(docs.select("doc_id", rewritten().alias("text")))
    runs = F.col("periodic.runs")
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = done.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
