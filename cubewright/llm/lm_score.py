"""Stupid-backoff language-model scores, each document scored by the counts of all the others.

The corpus is packed into blocks. Every block sends its distinct n-grams with counts to count tables that are
partitioned by n-gram hash; a table adds them up and returns to each block the totals of the n-grams that other blocks
hold too. A block then joins totals to its documents' n-grams, takes each document's own counts off, and sums by document.
A frequent n-gram is one row per block, so no key is hot, and a task holds one block or one slice of hashes.

A block sends ``2**bits`` slices at most, whatever the number of blocks. Where there are more blocks than that, counts go up a tree:
a table adds up as many blocks for one slice, cuts it into as many finer slices and sends these on in turn, until one table
holds a slice of all blocks; totals come back the same way. So the rows sent grow with the blocks, not with their square.

With ``c`` the counts without the document itself, ``N`` its words likewise, and ``n`` the order:
``S(w | ctx) = c(ctx w) / c(ctx)`` if ``c(ctx w) > 0``, else ``backoff * S(w | shorter ctx)``; the empty context gives
``c(w) / N``, and ``backoff / (N + 1)`` for a word that no other document has. The score is the sum of ``ln S``.

Edge cases: null and empty texts have no words and score 0 (mean null); repeated rows count as other documents; a single
document scores every word as unseen; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_space, joined_bytes, mix, small_batches, text_or_empty, written
from .common import word_hashes as hashes_at

ALL = np.uint64(1)  # stands for "any word": its count is N


def word_hashes(raw: list[bytes], step: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and how many each text has."""
    out, sizes, a = [np.zeros(0, np.uint64)], [], 0
    while a < len(raw):
        b, total = a, 0
        while b < len(raw) and (b == a or total + len(raw[b]) <= step):
            total += len(raw[b]) + 1
            b += 1
        data, ends = joined_bytes([t + b" " for t in raw[a:b]])
        gap = is_space(data)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        out.append(hashes_at(data, starts, stops))
        sizes.append(np.diff(np.searchsorted(starts, ends)))
        a = b
    return np.concatenate(out), np.concatenate([np.zeros(0, np.int64), *sizes])


def ngrams(words: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; 0 where the document starts too late for it."""
    levels = [words | np.uint64(2)]
    for k in range(1, order):
        h = np.zeros(len(words), np.uint64)
        if len(words) > k:
            same = doc[k:] == doc[:-k]
            h[k:] = np.where(same, mix(levels[-1][k - 1 : -1] * np.uint64(0x9E3779B97F4A7C15) + words[k:]) | np.uint64(2), np.uint64(0))
        levels.append(h)
    return levels


def _columns(a: np.ndarray) -> bytes:
    """Numbers of 64 bits byte by byte, which compresses well."""
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes, kind: type, rows: int = 1) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8).reshape(rows, 8, -1)
    return np.ascontiguousarray(a.transpose(0, 2, 1)).view(kind).reshape(rows, -1)


def _pack(z: zstandard.ZstdCompressor, h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes as differences, then counts."""
    return z.compress(_columns(np.diff(h, prepend=np.uint64(0))) + _columns(n.astype(np.uint64)))


def _unpack(z: zstandard.ZstdDecompressor, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, n = _numbers(z.decompress(blob), np.uint64, 2)
    return np.cumsum(d, dtype=np.uint64), n.view(np.int64)


def _cuts(grams: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where each slice of sorted hashes starts, and the end: by the ``bits`` of a hash after ``level * bits`` others, in which all agree."""
    digit = (grams >> np.uint64(64 - (level + 1) * bits)) & np.uint64((1 << bits) - 1)
    return np.searchsorted(digit, np.arange((1 << bits) + 1))


def _added(blobs: Iterable[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of some tables: (counts of each, all hashes, their totals, each table's places in these)."""
    z = zstandard.ZstdDecompressor()
    got = [_unpack(z, x) for x in blobs]
    grams, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, at, np.concatenate([x[1] for x in got]))
    ends = np.cumsum([len(x[0]) for x in got])[:-1]
    return [x[1] for x in got], grams, total, np.split(at, ends)


def _told(df: pd.DataFrame, counts: list[np.ndarray], total: np.ndarray, places: list[np.ndarray]) -> pd.DataFrame:
    """To each sender, for its n-grams of the slice in order: which of them others hold too, and their totals."""
    c, out = zstandard.ZstdCompressor(level=1), []
    for node, digit, own, i in zip(df["node"], df["digit"], counts, places):
        more = total[i] != own
        if more.any():
            out.append((node, digit, c.compress(np.packbits(more).tobytes()), c.compress(_columns(total[i][more]))))
    return pd.DataFrame(out, columns=["node", "digit", "which", "totals"])


def _overlaid(total: np.ndarray, cut: np.ndarray, told: pd.DataFrame) -> None:
    """Totals that came back, into a sender's own counts."""
    z = zstandard.ZstdDecompressor()
    for k, which, blob in zip(told["digit"], told["which"], told["totals"]):
        more = np.unpackbits(np.frombuffer(z.decompress(which), np.uint8), count=cut[k + 1] - cut[k]).astype(bool)
        total[cut[k] : cut[k + 1]][more] = _numbers(z.decompress(blob), np.int64)[0]


SENT, TOLD = "node string, digit int, path string, grams binary", "node string, digit int, which binary, totals binary"


def exchange(sent: DataFrame, senders: int, bits: int, level: int = 0) -> DataFrame:
    """``node, digit, which, totals`` for the tables ``node, digit, path, grams`` that ``senders`` groups of nodes send for each path (the digits so far)."""
    groups = -(-senders // (1 << bits))
    keyed = sent.withColumn("key", F.concat_ws("/", F.pmod(F.xxhash64(F.element_at(F.split("node", "@"), 1)), F.lit(groups)).cast("string"), "path"))
    if groups == 1:

        def add(df: pd.DataFrame) -> pd.DataFrame:
            counts, _, total, places = _added(df["grams"])
            return _told(df, counts, total, places)

        return keyed.groupBy("key").applyInPandas(add, TOLD)
    keyed = written(keyed, "sent")  # read on the way up and on the way back

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        _, grams, total, _ = _added(df["grams"])
        z, cut, key = zstandard.ZstdCompressor(level=1), _cuts(grams, level + 1, bits), df["key"].iloc[0]
        group, path = key.split("/", 1)
        rows = [(f"{group}@{path}", k, f"{path}.{k}", _pack(z, grams[cut[k] : cut[k + 1]], total[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()]
        return pd.DataFrame(rows, columns=["node", "digit", "path", "grams"])

    up = exchange(keyed.groupBy("key").applyInPandas(merge, SENT), groups, bits, level + 1)

    def back(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["node", "digit", "which", "totals"])
        counts, grams, total, places = _added(left["grams"])
        _overlaid(total, _cuts(grams, level + 1, bits), right)
        return _told(left, counts, total, places)

    return keyed.groupBy("key").cogroup(up.withColumn("key", F.replace("node", F.lit("@"), F.lit("/"))).groupBy("key")).applyInPandas(back, TOLD)


def _counts(raw: list[bytes], order: int):
    words, sizes = word_hashes(raw)
    doc = np.repeat(np.arange(len(raw)), sizes)
    levels = ngrams(words, doc, order)
    flat = np.concatenate([*levels, np.full(len(words), ALL)])
    grams, n = np.unique(flat[flat > 0], return_counts=True)
    return doc, sizes, levels, grams, n


def stupid_backoff(docs: DataFrame, order: int = 2, backoff: float = 0.4, block_bytes: int = 8 << 20, bits: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, log_score, mean_log_score``.

    ``bits``: a block sends ``2**bits`` slices of its counts; by default as many as ``order`` times the blocks over two, so that a slice holds the n-grams
    of about two blocks, at least four a shuffle partition, and 512 at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, raw, total, made = [], [], 0, 0

        def block():
            name = f"{TaskContext.get().partitionId()}-{made}-{hash(tuple(map(len, raw)))}"
            return pd.DataFrame({"block": [name], "ids": [list(ids)], "sizes": [np.array(list(map(len, raw)), np.int64).tobytes()], "z": [zstandard.ZstdCompressor(level=3).compress(b"".join(raw))]})

        for df in parts:
            for i, t in zip(df["doc_id"].astype(object).where(df["doc_id"].notna(), None), df["text"]):
                ids.append(i)
                raw.append(t.encode())
                total += len(raw[-1])
                if total >= block_bytes:
                    yield block()
                    ids, raw, total, made = [], [], 0, made + 1
        if ids:
            yield block()

    def texts(row) -> list[bytes]:
        data, sizes = zstandard.ZstdDecompressor().decompress(row["z"]), np.frombuffer(row["sizes"], np.int64)
        ends = np.cumsum(np.concatenate([[0], sizes])).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for df in parts:
            for _, row in df.iterrows():
                _, _, _, grams, n = _counts(texts(row), order)
                cut = _cuts(grams, 0, bits)
                rows = [(row["block"], k, str(k), _pack(z, grams[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()]
                yield pd.DataFrame(rows, columns=["node", "digit", "path", "grams"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            doc, sizes, levels, grams, total = _counts(texts(row), order)
            _overlaid(total, _cuts(grams, 0, bits), right)
            words = (total[grams == ALL].sum() - sizes)[doc].astype(np.float64)  # N without the own document
            rest = []
            for h in levels:
                g = np.searchsorted(grams, h)
                g[h == 0] = 0
                _, at, own = np.unique(doc * np.int64(len(grams) + 1) + g, return_inverse=True, return_counts=True)
                rest.append(np.where(h > 0, total[g] - own[at], 0) if len(g) else g)
            first = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(sizes)])[:-1][doc]
            s = np.log(np.where(rest[0] > 0, rest[0] / np.maximum(words, 1), backoff / (words + 1)))
            for k in range(1, order):
                context = np.concatenate([[1], rest[k - 1][:-1]]) if len(doc) else rest[0]
                seen = np.log(np.maximum(rest[k], 1) / np.maximum(context, 1))
                s = np.where(first < k, s, np.where(rest[k] > 0, seen, np.log(backoff) + s))
            sums = np.bincount(doc, s, minlength=len(sizes)) if len(doc) else np.zeros(len(sizes))
            out.append(pd.DataFrame({"doc_id": pd.Series(row["ids"], dtype="Int64" if kind in ("bigint", "int") else object), "n_words": sizes, "log_score": sums}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_words": [], "log_score": []})

    # Written, so that a block has the same documents and name wherever it is read again.
    blocks = written(docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(pack, f"block string, ids array<{kind}>, sizes binary, z binary"), "blocks")
    n = blocks.count()
    bits = bits or min(9, max(2, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), order * n // 2) - 1).bit_length())
    totals = exchange(blocks.mapInPandas(send, SENT), max(n, 1), bits).withColumnRenamed("node", "block")
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, f"doc_id {kind}, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.expr("try_divide(log_score, n_words)"))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    out = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
b AS (SELECT a.r, a.i, a.w, p.w AS p FROM t a LEFT JOIN t p ON p.r = a.r AND p.i = a.i - 1),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), o1 AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
c2 AS (SELECT p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY p, w), o2 AS (SELECT r, p, w, count(*) AS c FROM b WHERE p IS NOT NULL GROUP BY r, p, w),
j AS (
  SELECT b.r, b.p, c1.c - o1.c AS u, n.n - len(d.ws) AS n, coalesce(c2.c - o2.c, 0) AS bi, coalesce(k.c - ok.c, 0) AS ctx
  FROM b JOIN d ON d.r = b.r CROSS JOIN n JOIN c1 ON c1.w = b.w JOIN o1 ON o1.r = b.r AND o1.w = b.w
  LEFT JOIN c2 ON c2.p = b.p AND c2.w = b.w LEFT JOIN o2 ON o2.r = b.r AND o2.p = b.p AND o2.w = b.w
  LEFT JOIN c1 k ON k.w = b.p LEFT JOIN o1 ok ON ok.r = b.r AND ok.w = b.p),
s AS (SELECT r, sum(CASE WHEN bi > 0 THEN ln(bi / ctx) ELSE CASE WHEN p IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + CASE WHEN u > 0 THEN ln(u / n) ELSE ln(0.4::DOUBLE / (n + 1)) END END) AS s FROM j GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(coalesce(s.s, 0), 3) AS log_score, round(CASE WHEN len(d.ws) > 0 THEN coalesce(s.s, 0) / len(d.ws) END, 6) AS mean_log_score
FROM d LEFT JOIN s ON s.r = d.r
"""
