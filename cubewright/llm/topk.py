"""Exact top-k inner-product search by pivot elimination.

Every vector carries its distances to a few pivots. For a query ``q`` and a vector ``v`` the largest
``|d(q, p) - d(v, p)|`` over the pivots is a lower bound of ``d(q, v)``, which with the norms bounds the inner product from
above: ``q . v = (|q|^2 + |v|^2 - d(q, v)^2) / 2``. Candidates are evaluated in the order of that bound until the k-th best
score beats the next bound.

Vectors are dealt into blocks by nearest pivot and distance to it, so that a block's distances to each pivot lie close together.
A query first meets the block that it lies in, whose k-th best score is what others have to beat. A block in which no vector can do so for any query of a
query block, by the least and greatest distances to each pivot, is left out before queries and vectors are brought together.

Edge cases: null vectors and those with null or non-finite components take no part, as query or candidate; every row is a query or
candidate of its own, equal and missing ids too, and only itself is no answer to it; shorter vectors count as padded with zeros; ties go to the
smaller id, missing ones last; the id 2**63 - 1 is taken for a missing one; components beyond 64 bits and scores beyond 64 bits are cut to the nearest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EXACT = 1 << 53
#: Stands for a missing id, after all others.
MISSING = (1 << 63) - 1
BLOCK = "block long, ids binary, places binary, asks binary, dim int, vectors binary, kind string, pivots binary"


def clean_vectors(vectors: DataFrame, is_query: Column, scale: int = 1024) -> DataFrame:
    """``vec_id, asks, v``: components as ``floor(scale * x)``, without rows that take no part."""
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    most = float(1 << 62)
    whole = F.transform(e, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))))
    return vectors.where(e.isNotNull() & ok).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(MISSING)).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"))


def _matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = max(v.shape[1], p.shape[1])
    a, b = np.zeros((len(v), d)), np.zeros((len(p), d))
    a[:, : v.shape[1]], b[:, : p.shape[1]] = v, p
    return np.sqrt(np.stack([((a - x) ** 2).sum(1) for x in b], 1)) if len(b) else np.zeros((len(v), 0))


def _distance_rows(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the nearest pivot and the distance to it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            if len(df):
                d = _distances(_matrix(list(df["v"]), max(map(len, df["v"]))), pivots)
                yield df.assign(near=d.argmin(1), dist=d.min(1)) if d.shape[1] else df.assign(near=0, dist=0.0)

    return rows.mapInPandas(run, "vec_id long, asks boolean, v array<long>, near int, dist double")


def _packed(block: int, ids: np.ndarray, places: np.ndarray, asks: np.ndarray, m: np.ndarray, pivots: np.ndarray) -> pd.DataFrame:
    top = int(np.abs(m).max(initial=0))
    small = m.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
    return pd.DataFrame({"block": [block], "ids": [ids.astype(np.int64).tobytes()], "places": [places.astype(np.int64).tobytes()], "asks": [asks.astype(np.bool_).tobytes()], "dim": [m.shape[1]], "vectors": [small.tobytes()], "kind": [small.dtype.str], "pivots": [pivots.astype(np.float64).tobytes()]})


def blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Rows of ``_distance_rows`` in order, ``size`` at most in each block. A row's place is a number of its own."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n = TaskContext.get().partitionId() << 40, 0
        for df in parts:
            for k in range(0, len(df), size):
                own = df.iloc[k : k + size]
                m = _matrix(list(own["v"]), max(map(len, own["v"])))
                yield _packed(first + n, own["vec_id"].to_numpy(), first + n + np.arange(len(own)), own["asks"].to_numpy(), m, _distances(m, pivots))
                n += len(own)

    return rows.mapInPandas(pack, BLOCK)


class Block:
    """A block's rows: ids, places, which of them ask, vectors, and distances to the pivots."""

    def __init__(self, r):
        self.block = r.block
        self.ids, self.places, self.asks = np.frombuffer(r.ids, np.int64), np.frombuffer(r.places, np.int64), np.frombuffer(r.asks, np.bool_)
        self.vectors = np.frombuffer(r.vectors, np.dtype(r.kind)).reshape(len(self.ids), r.dim)
        self.pivots = np.frombuffer(r.pivots).reshape(len(self.ids), -1)
        self.norms = (self.vectors.astype(np.float64) ** 2).sum(1)

    def only(self, which: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.block = self.block
        for k in ("ids", "places", "asks", "vectors", "pivots", "norms"):
            setattr(out, k, getattr(self, k)[which])
        return out


def highest(q_norm, q_pivots: np.ndarray, norm, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What an inner product is at most, with vectors whose distances to the pivots lie between ``low`` and ``high``, rounding allowed for."""
    gap = np.maximum(np.maximum(low - q_pivots, q_pivots - high).max(-1, initial=0), 0)
    gap = np.maximum(gap - 1e-9 * (1 + gap + q_pivots.max(initial=0)), 0)
    bound = (q_norm + norm - gap**2) / 2
    return bound + np.abs(bound) * 1e-9 + 1


def search(queries: Block, vectors: Block, k: int, least: np.ndarray | None = None, first: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query number, vector ids and scores of the ``k`` best of one block for each query of another; and how many products were evaluated.

    ``least``: for each query a score below which nothing counts.
    """
    q, v = queries.vectors, vectors.vectors
    d = min(q.shape[1], v.shape[1])
    big = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(d, 1) >= EXACT
    kind = object if big else np.float64  # doubles are exact below 2**53; beyond, Python's integers
    vectors_ = v[:, :d].astype(kind)
    out_q, out_v, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        bound = highest(queries.norms[i], queries.pivots[i], vectors.norms, vectors.pivots, vectors.pivots)
        order = np.argsort(-bound)
        order = order[vectors.places[order] != queries.places[i]]
        if least is not None:
            order = order[bound[order] >= least[i]]
        x, at, step = q[i, :d].astype(kind), 0, first
        best_v, best_s = vectors.ids[:0], np.zeros(0, kind)
        while at < len(order) and not (len(best_s) >= k and best_s[-1] > bound[order[at]]):
            some = order[at : at + step]
            at, step, evaluated = at + step, step * 2, evaluated + len(some)
            ids, scores = np.concatenate([best_v, vectors.ids[some]]), np.concatenate([best_s, vectors_[some] @ x])
            keep = np.lexsort((ids, -scores))[:k] if kind is not object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
            best_v, best_s = ids[keep], scores[keep]
        out_q.append(np.full(len(best_v), i))
        out_v.append(best_v)
        out_s.append(np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in best_s], np.int64))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_v), cat(out_s), evaluated


FOUND = "place long, query_id long, vec_id long, score long, evaluated long"


def _found(queries: Block, vectors: Block, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    q, v, s, evaluated = search(queries, vectors, k, least)
    return pd.DataFrame({"place": queries.places[q], "query_id": queries.ids[q], "vec_id": v, "score": s, "evaluated": np.where(np.arange(len(q)) == 0, evaluated, 0)})


def candidates(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, block: int = 4096, query_block: int = 256) -> DataFrame:
    """``place, query_id, vec_id, score, evaluated``: the ``k`` best of each block that a query meets, and how many products that took (in one row each).

    ``pivots`` vectors, drawn by hash, come to the driver; so does nothing else.
    """
    rows = clean_vectors(vectors, is_query)
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(pivots).collect()]
    p = _matrix(drawn, max(map(len, drawn), default=0))
    order = ["near", "dist", F.xxhash64("vec_id")]  # the hash deals out equal vectors
    dealt = _distance_rows(rows, p).repartitionByRange(max(1, -(-rows.count() // block)), *order)
    held = written(blocks(dealt.sortWithinPartitions(*order), p, block), "blocks")

    def home(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query: its vector, what its own block has to offer, and the k-th best score there."""
        for df in chunks:
            for r in df.itertuples(index=False):
                b = Block(r)
                q = b.only(np.flatnonzero(b.asks))
                at, v, score, evaluated = search(q, b, k)
                cut = np.searchsorted(at, np.arange(len(q.ids) + 1))
                ends = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                least = [float(score[y - 1]) if y - x == k else -np.inf for x, y in ends]
                each = {"vector": q.vectors.astype(np.int64), "pivots": q.pivots}
                best = {"best": [v[x:y].tobytes() for x, y in ends], "scores": [score[x:y].tobytes() for x, y in ends]}
                yield pd.DataFrame({"place": q.places, "query_id": q.ids, "home": b.block, "least": least, **{c: [x.tobytes() for x in m] for c, m in each.items()}, **best, "evaluated": np.where(np.arange(len(ends)) == 0, evaluated, 0)})

    queries = written(held.mapInPandas(home, "place long, query_id long, home long, least double, vector binary, pivots binary, best binary, scores binary, evaluated long"), "queries")

    def gather(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries that lie close together in blocks of ``query_block``."""
        for df in chunks:
            for x in range(0, len(df), query_block):
                own = df.iloc[x : x + query_block]
                v = [np.frombuffer(b, np.int64) for b in own["vector"]]
                pack = _packed(int(own["place"].iloc[0]), own["query_id"].to_numpy(), own["place"].to_numpy(), np.ones(len(own)), _matrix(v, max(map(len, v))), np.stack([np.frombuffer(b) for b in own["pivots"]]))
                yield pack.assign(homes=[own["home"].to_numpy().tobytes()], least=[own["least"].to_numpy().tobytes()])

    near = queries.repartitionByRange(max(1, -(-queries.count() // query_block)), "place").sortWithinPartitions("place")
    asked = written(near.mapInPandas(gather, f"{BLOCK}, homes binary, least binary"), "asked")

    def shape(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per block what bounds its vectors: the greatest norm, and least and greatest distances to the pivots."""
        for df in chunks:
            b = [Block(r) for r in df.itertuples(index=False)]
            if b:
                yield pd.DataFrame({"blocks": [np.array([x.block for x in b], np.int64).tobytes()], "norms": [np.array([x.norms.max() for x in b]).tobytes()], "low": [np.stack([x.pivots.min(0) for x in b]).tobytes()], "high": [np.stack([x.pivots.max(0) for x in b]).tobytes()]})

    shapes = held.mapInPandas(shape, "blocks binary, norms binary, low binary, high binary")

    def reach(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in chunks:
            for r in df.itertuples(index=False):
                q, least, homes = Block(r), np.frombuffer(r.least), np.frombuffer(r.homes, np.int64)
                name, norms = np.frombuffer(r.blocks, np.int64), np.frombuffer(r.norms)
                low, high = (np.frombuffer(x).reshape(len(name), -1) for x in (r.low, r.high))
                may = [name[n] for n in range(len(name)) if ((highest(q.norms, q.pivots, norms[n], low[n], high[n]) >= least) & (homes != name[n])).any()]
                yield pd.DataFrame({"block": np.full(len(may), r.block), "other": np.array(may, np.int64)})

    # The stated queries against all rows, in blocks: first by what bounds the blocks, then those that may hold an answer.
    pairs = asked.crossJoin(shapes).mapInPandas(reach, "block long, other long")
    theirs = held.select(*(F.col(c).alias(f"v_{c}") for c in held.columns))
    met = pairs.join(asked, "block").join(theirs, F.col("other") == F.col("v_block"))

    def meet(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in chunks:
            own = df[[c for c in df.columns if c.startswith("v_")]].rename(columns=lambda c: c[2:])
            for r, x in zip(df.itertuples(index=False), own.itertuples(index=False)):
                q, v = Block(r), Block(x)
                other = np.frombuffer(r.homes, np.int64) != v.block  # those at home here have met it
                yield _found(q.only(other), v, k, np.frombuffer(r.least)[other])

    def unpack(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in chunks:
            v, score = ([np.frombuffer(b, np.int64) for b in df[c]] for c in ("best", "scores"))
            n = [len(x) for x in v]
            if sum(n):
                first = np.concatenate([np.arange(x) == 0 for x in n])
                yield df[["place", "query_id"]].loc[df.index.repeat(n)].assign(vec_id=np.concatenate(v), score=np.concatenate(score), evaluated=np.where(first, np.repeat(df["evaluated"].to_numpy(), n), 0))

    return queries.mapInPandas(unpack, FOUND).unionByName(met.mapInPandas(meet, FOUND))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, **options) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``is_query`` holds for (see ``candidates``)."""
    best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    found = candidates(vectors, is_query, k, **options)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.nullif("query_id", F.lit(MISSING)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(MISSING)).alias("vec_id"), "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.r <> c.r)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p) WHERE rank <= 10
"""
