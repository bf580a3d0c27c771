"""Conversation prefixes as a trie: what conversations share from their first turn on, and what that saves.

Turns travel as 20-byte records (16 bytes of a SHA-256 of role and text, the text's size); texts stay where they are read.
Distinct conversations are sorted as byte strings and dealt by range, so that each shard of some ``SHARD`` turns holds
neighbours. In a shard, turns get dense ids in order of first appearance by depth; BASE and CHECK arrays are packed over them
(nodes of several children by first fit, those of one child into the holes), and all conversations walk the arrays
at once, a depth at a time, counting members. Only nodes on the paths of a shard's first and last conversation can be in
other shards too: these upper nodes are merged by the digest of their prefix, some shards in a row at a time, until one group
holds all of them. A prefix that a third of all conversations share is so spread over many shards.

Member lists are hashed in pieces: ids of equal conversations are dealt by range, joined ``IDS`` at a time, and the joined pieces
of one list go through one hash in order, as SHA-256 needs.

One conversation's records are one value of 20 bytes a turn, the only thing here that grows with the length of a conversation.

Edge cases: rows without ``conv_id`` belong to no conversation and count nowhere; a null role or text is empty; turns without a
number come first, equal numbers (repeated rows among them) by the digest of role and text; a missing or short first
conversation of a group of five lends what it has; ``conv_id % 5`` keeps the sign of ``conv_id``, as in SQL; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

RECORD, KEY = 20, 16
#: Turns in a shard at most, but for a longer conversation; ids joined at a time; partitions, later groups of shards merged at a time, as a power of two.
SHARD, IDS, FAN = 1 << 17, 4096, 5
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "shard long, key binary, up binary, first boolean, last boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string"
ROOM = np.iinfo(np.int64).min


def key_of(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()[:KEY]


def record(role: str = "role", text: str = "text") -> Column:
    """What stands for a turn: equal only for equal role and text."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 2 * KEY), F.lpad(F.hex(F.octet_length(t)), 2 * (RECORD - KEY), "0")))


def rebuilt(conversations: DataFrame, lent: Column, together: Column) -> DataFrame:
    """``conv_id, seq``: the records of each conversation, the first ``lent`` (8 at most) replaced by those of conversation ``together``.

    Conversations of one group meet in one partition, sorted, and pass by in a stream.
    """
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), record().alias("rec"))
    rows = named.select(together.cast("long").alias("base"), lent.cast("int").alias("lent"), "conv_id", "turn", "rec").repartition("base")
    rows = rows.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "rec").select("base", "lent", "conv_id", "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, lender = None, [], (None, b"")

        def close() -> tuple[int, bytes]:
            nonlocal lender
            base, n, conv = now
            own = b"".join(pieces)
            if conv == base:
                lender = (base, own[: 8 * RECORD])
            first = lender[1] if lender[0] == base else b""
            return conv, first[: n * RECORD] + own[n * RECORD :]

        for b in batches:
            base, n, conv = (b.column(k).to_numpy() for k in range(3))
            data, out = b"".join(b.column(3).to_pylist()), []
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else []
            for s, e in zip(starts, [*starts[1:], len(conv)]):
                this = (int(base[s]), int(n[s]), int(conv[s]))
                if this != now:
                    if now:
                        out.append(close())
                    now, pieces = this, []
                pieces.append(data[s * RECORD : e * RECORD])
            yield from _sequences(out)
        if now:
            yield from _sequences([close()])

    return rows.mapInArrow(run, "conv_id long, seq binary")


def _sequences(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["conv_id", "seq"])


def distinct(seqs: DataFrame) -> DataFrame:
    """``seq, n, conv_id, ends``: each different conversation once, how many are so, their smallest id and the hash of all their ids."""
    named = seqs.select(F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * KEY)).alias("key"), "conv_id", "seq")
    named = named.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for key, g in b.groupby("key", sort=False):
                ids = g["conv_id"].tolist()
                for k in range(0, len(ids), IDS):
                    part = ids[k : k + IDS]
                    out.append((key, part[0], len(part), ",".join(map(str, part)), g["seq"].iloc[0] if key != last else None))
                    last = key
            yield pd.DataFrame(out, columns=["key", "conv_id", "n", "ids", "seq"])

    pieces = named.mapInPandas(join, "key binary, conv_id long, n long, ids string, seq binary").repartition("key").sortWithinPartitions("key", "conv_id")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, n, conv, sha = None, None, 0, 0, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.key != now:
                    if now is not None:
                        out.append((seq, n, conv, sha.hexdigest()))
                    now, seq, n, conv, sha = r.key, r.seq, r.n, r.conv_id, hashlib.sha256(r.ids.encode())
                else:
                    sha.update(b"," + r.ids.encode())
                    n += r.n
            yield pd.DataFrame(out, columns=["seq", "n", "conv_id", "ends"])
        if now is not None:
            yield pd.DataFrame([(seq, n, conv, sha.hexdigest())], columns=["seq", "n", "conv_id", "ends"])

    return pieces.mapInPandas(whole, "seq binary, n long, conv_id long, ends string")


class DoubleArray:
    """BASE and CHECK over dense turn ids: the child of slot ``s`` by turn ``c`` is ``t = base[s] + c``, if ``check[t] == s``. Slot 0 is the root."""

    def __init__(self, parent: np.ndarray, code: np.ndarray):
        """Node ``i + 1`` is the child of ``parent[i]`` by ``code[i]``; nodes in order of depth, children of a node in a row."""
        n = len(parent) + 1
        starts = np.searchsorted(parent, np.arange(n + 1))
        many = np.diff(starts)
        slot, base = np.zeros(n, np.int64), np.full(n, ROOM)
        free = np.ones(n + int(code.max(initial=0)) + 2, bool)
        free[0], at = False, 1
        for p in np.flatnonzero(many > 1).tolist():
            c = np.sort(code[starts[p] : starts[p + 1]])
            span, step, most = int(c[-1] - c[0]), 64, max(64, (1 << 18) // len(c))
            while True:  # first fit; what is passed over is left for single children
                if len(free) < at + step + span + 1:
                    free = np.concatenate([free, np.ones(at + step + span + 1, bool)])
                tries = np.flatnonzero(free[at : at + step]) + at
                fits = free[tries[:, None] + (c - c[0])].all(axis=1)
                if fits.any():
                    break
                at, step = at + step, min(2 * step, most)
            base[p] = tries[np.argmax(fits)] - c[0]
            free[base[p] + c] = False
            slot[1 + starts[p] : 1 + starts[p + 1]] = base[p] + code[starts[p] : starts[p + 1]]
        lone = np.flatnonzero(many == 1)
        holes = np.flatnonzero(free[1:]) + 1
        if len(holes) < len(lone):
            holes = np.concatenate([holes, np.arange(len(free), len(free) + len(lone) - len(holes))])
        slot[1 + starts[lone]] = holes[: len(lone)]
        base[lone] = holes[: len(lone)] - code[starts[lone]]  # may be below 0
        size = int(slot.max()) + 1
        self.base, self.check = np.full(size, ROOM), np.full(size, -1)
        self.base[slot], self.check[slot[1:]] = base, slot[parent]

    def step(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where each walker gets to by its turn; -1 where there is no such child."""
        to = self.base[at] + code
        there = (self.base[at] != ROOM) & (to >= 0) & (to < len(self.check))
        there[there] = self.check[to[there]] == at[there]
        return np.where(there, to, -1)


def levels(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, code) of the nodes of sorted sequences, the root left out, by depth and then by sequence."""
    node, live, parents, codes, n = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), [], [], 1
    for d in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > d]
        c, p = code[starts[live] + d], node[live]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
        node[live] = n - 1 + np.cumsum(new)
        parents.append(p[new])
        codes.append(c[new])
        n += int(new.sum())
    return (np.concatenate(parents), np.concatenate(codes)) if parents else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def finish(nodes: pd.DataFrame, parent: np.ndarray, still: np.ndarray) -> None:
    """Adds the aggregates of all nodes that are not ``still`` open to their parents', from the deepest up, in place."""
    children, leaves, saved = (nodes[c].to_numpy().copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    own, depth = (nodes["n_convs"].to_numpy() - 1) * nodes["size"].to_numpy(), nodes["depth"].to_numpy()
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        done = level[~still[level]]
        leaves[done] += children[done] == 0
        saved[done] += own[done]
        done = done[parent[done] >= 0]
        up = parent[done]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[done])
        np.add.at(saved, up, saved[done])
    nodes["n_children"], nodes["n_leaves"], nodes["saved_tokens"] = children, leaves, saved


def shard_nodes(shard: int, seqs: list[bytes], n: np.ndarray, conv: np.ndarray, ends: list[str]) -> pd.DataFrame:
    """The nodes of some sorted conversations; those that other shards may hold too are open and have a ``key``."""
    sizes = np.array([len(s) // RECORD for s in seqs])
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(seqs), f"V{RECORD}")
    by_depth = np.argsort(np.arange(len(raw)) - np.repeat(starts, sizes), kind="stable")
    code = np.empty(len(raw), np.int64)
    code[by_depth] = pd.factorize(np.array(raw[by_depth].tolist(), object))[0] if len(raw) else 0
    size_of = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, RECORD)[:, KEY:]).view(">u4").ravel()
    trie = DoubleArray(*levels(code, starts, sizes))
    m = len(trie.check)
    count, least, depth, size = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.full(m, -1), np.zeros(m, np.int64)
    first, last, end = np.zeros(m, bool), np.zeros(m, bool), np.full(m, None, object)
    key: dict[int, bytes] = {}
    at, live, d = np.zeros(len(seqs), np.int64), np.arange(len(seqs)), 0
    edge = [(0, hashlib.sha256()), (len(seqs) - 1, hashlib.sha256())]
    while len(live):
        here = at[live]
        np.add.at(count, here, n[live])
        np.minimum.at(least, here, conv[live])
        depth[here] = d
        for (row, sha), flag in zip(edge, (first, last)):
            if sizes[row] >= d:
                flag[at[row]] = True
                key[int(at[row])] = sha.digest()[:KEY]
                sha.update(seqs[row][d * RECORD : (d + 1) * RECORD])
        over = live[sizes[live] == d]
        end[at[over]] = [ends[i] for i in over]
        live = live[sizes[live] > d]
        turn = starts[live] + d
        at[live] = trie.step(at[live], code[turn])
        size[at[live]] = size_of[turn]
        d += 1
    used = np.flatnonzero(depth >= 0)
    place = np.full(m, -1)
    place[used] = np.arange(len(used))
    parent = np.where(used == 0, -1, place[trie.check[used]])
    still = (first | last)[used]
    zero = np.zeros(len(used), np.int64)
    out = pd.DataFrame({"shard": shard, "first": first[used], "last": last[used], "conv_id": least[used], "depth": depth[used], "n_convs": count[used], "n_children": zero, "n_leaves": zero, "saved_tokens": zero, "size": size[used], "ends": end[used]})
    finish(out, parent, still)
    keys = np.array([key.get(int(s)) for s in used], object)
    up = np.where(parent >= 0, keys[parent], None)
    out["key"], out["up"] = keys, up
    known = (parent >= 0) & pd.isna(up)
    out["parent_conv_id"] = pd.Series(np.where(known, out["conv_id"].to_numpy()[parent], 0)).astype("Int64").where(known)
    return out[[c.split()[0] for c in NODE.split(", ")]]


def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, turns, k = [], 0, TaskContext.get().partitionId() << 32
    for b in batches:
        for r in b.itertuples(index=False):
            held.append(r)
            turns += len(r.seq) // RECORD + 1
            if turns >= SHARD:
                yield _shard(k, held)
                held, turns, k = [], 0, k + 1
    if held:
        yield _shard(k, held)


def _shard(k: int, held: list) -> pd.DataFrame:
    seqs, n, conv, ends = zip(*held)
    return shard_nodes(k, list(seqs), np.array(n), np.array(conv), list(ends))


def merged(bits: int, whole: bool, nodes: pd.DataFrame) -> pd.DataFrame:
    """Open nodes of shards in a row (their numbers but for the last ``bits`` are equal), each once; what only the shards before and after may hold too stays open, nothing if these are the ``whole``."""
    low, high = nodes["shard"].min(), nodes["shard"].max()
    nodes = nodes.copy()
    nodes["first"] &= nodes["shard"] == low
    nodes["last"] &= nodes["shard"] == high
    how = {"up": "first", "first": "max", "last": "max", "conv_id": "min", "depth": "first", "n_convs": "sum", "n_children": "sum", "n_leaves": "sum", "saved_tokens": "sum", "size": "max", "ends": "first"}
    out = nodes.groupby("key", sort=False, as_index=False).agg(how)
    place = {k: i for i, k in enumerate(out["key"])}
    parent = np.array([place.get(u, -1) for u in out["up"]], np.int64)
    still = np.zeros(len(out), bool) if whole else (out["first"] | out["last"]).to_numpy(bool)
    finish(out, parent, still)
    out = out.assign(shard=int(low) >> bits, parent_conv_id=pd.Series(pd.NA, index=out.index, dtype="Int64"), still=still)
    return out[[c.split()[0] for c in NODE.split(", ")] + ["still"]]


def _merge(bits: int, whole: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda nodes: merged(bits, whole, nodes)


def upper_nodes(nodes: DataFrame) -> DataFrame:
    """The open nodes of all shards, merged."""
    done, bits = [], 32 + FAN
    while True:
        top = nodes.agg(F.max("shard")).first()[0]
        whole = top is None or top >> bits == 0
        once = written(nodes.groupBy(F.shiftright("shard", bits)).applyInPandas(_merge(bits, whole), f"{NODE}, still boolean"), "upper-nodes")
        done.append(once.where(~F.col("still")).drop("still"))
        if whole:
            break
        nodes, bits = once.where("still").drop("still"), FAN
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def prefix_trie(seqs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """A row for each node of the conversations' trie, from ``conv_id, seq``."""
    once = written(distinct(seqs), "conversations")
    nodes = written(once.repartitionByRange("seq").sortWithinPartitions("seq").mapInPandas(shards, NODE), "nodes")
    upper = written(upper_nodes(nodes.where("key is not null")), "upper")
    rows = nodes.where("key is null").unionByName(upper)
    parents = bounded(upper.select(F.col("key").alias("up"), F.col("conv_id").alias("above")), broadcast_rows)
    linked = rows.where("up is not null").join(parents, "up", "left")
    every = rows.where("up is null").withColumn("above", F.col("parent_conv_id")).unionByName(linked)
    return every.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    lent = F.crc32(conv.cast("string").cast("binary")) % 9
    seqs = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), lent, conv - conv % 5)
    return prefix_trie(seqs)


ORACLE = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, th) - 1 AS pos
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS th, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
ids AS MATERIALIZED (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
s AS (SELECT c, 0 AS part, pos, th, size FROM ids JOIN t ON t.conv_id = b AND pos < h UNION ALL SELECT c, 1, pos, th, size FROM ids JOIN t ON t.conv_id = c AND pos >= h),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, count(*) OVER (PARTITION BY c) AS ends FROM s),
p AS MATERIALIZED (SELECT c, d, ends, size, sha256(array_to_string(list(th) OVER (PARTITION BY c ORDER BY d), '')) AS k FROM n
  UNION ALL SELECT c, 0, coalesce(ends, 0), 0, 'root' FROM ids LEFT JOIN (SELECT c, max(ends) AS ends FROM n GROUP BY c) USING (c)),
x AS MATERIALIZED (SELECT k, d, min(c) AS c, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE d = ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
u AS MATERIALIZED (SELECT x.*, p.k AS up FROM x LEFT JOIN p ON p.c = x.c AND p.d = x.d - 1),
f AS MATERIALIZED (SELECT u.*, coalesce(n, 0) AS n_children FROM u LEFT JOIN (SELECT up, count(*) AS n FROM u GROUP BY up) v ON v.up = u.k),
a AS (SELECT p.k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * f.size) AS saved FROM f JOIN p ON p.c = f.c AND p.d <= f.d GROUP BY p.k)
SELECT f.c AS conv_id, f.d AS depth, w.c AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (k) LEFT JOIN x w ON w.k = f.up
"""
