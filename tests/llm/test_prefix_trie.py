"""The trie of conversation prefixes against one of dictionaries, over many small shards, and its double array by itself."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from cubewright.llm import prefix_trie as p
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, seq string, key int, base int, n int"
EXTRA = ("s", 1, 2, 3)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            th = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn), th, (role, text)))
    convs = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    members = {}
    whole = {}
    for c, own in convs.items():
        base, h = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], set()).add(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up():
    r = random.Random(11)
    rows = []
    for c in [*range(-7, 60), *range(100, 400, 3), 9_000_000_001]:
        turns = [("user" if k % 2 == 0 else "assistant", r.choice(["yes", "no", "é", "", None]) if r.random() < 0.8 else f"t{r.random()}") for k in range(r.choice([1, 2, 5, 9, 12]))]
        rows += [(c, k if r.random() < 0.9 else None, role if r.random() < 0.9 else None, text) for k, (role, text) in enumerate(turns)]
    rows += [(1000 + c, k, "user", f"same {k}") for c in range(90) for k in range(10)]  # copies
    rows += [(5000, k, "user", f"long {k % 7}") for k in range(700)] + [(5001, k, "user", f"long {k % 7}") for k in range(500)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, None, "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*row, *EXTRA) for row in made_up()], SCHEMA)


def result(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted((tuple(r) for r in p.op11_prefix_trie(spark, f"{tmp_path}/{name}").collect()), key=repr)


@pytest.mark.parametrize("shard,fan,ids", [(1 << 17, 5, 4096), (40, 1, 7)])
def test_all_nodes(spark, table, tmp_path, monkeypatch, shard, fan, ids):
    monkeypatch.setattr(p, "SHARD", shard)
    monkeypatch.setattr(p, "FAN", fan)
    monkeypatch.setattr(p, "IDS", ids)
    assert result(spark, table, tmp_path, "t") == brute(made_up())


def test_sql_on_odd_rows(table, tmp_path):
    table.drop("seq", "key", "base", "n").where("conv_id <> 5000 and conv_id <> 5001").coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c.parquet/*.parquet'")
    assert sorted(con.execute(p.ORACLE).fetchall(), key=repr) == brute([r for r in made_up() if r[0] not in (5000, 5001)])


def test_empty_and_turnless(spark, table, tmp_path):
    assert result(spark, table.limit(0), tmp_path, "none") == []
    c = next(c for c in range(5, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    alone = [(c, None, None, None)]  # nothing is lent, and its own first turns go
    assert result(spark, spark.createDataFrame([(*alone[0], *EXTRA)], SCHEMA), tmp_path, "one") == brute(alone) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array():
    r = np.random.default_rng(3)
    for codes, n in ((3, 200), (50, 300), (5000, 2000)):
        seqs = sorted({tuple(r.integers(0, codes, r.integers(0, 6)).tolist()) for _ in range(n)})
        sizes = np.array([len(s) for s in seqs])
        code = np.array([x for s in seqs for x in s], np.int64)
        trie = p.DoubleArray(*p.levels(code, np.cumsum(sizes) - sizes, sizes))
        prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        at = {(): 0}
        for s in sorted(prefixes, key=len):
            nxt = trie.step(np.full(codes, at[s]), np.arange(codes))
            assert {c for c in range(codes) if nxt[c] >= 0} == {x[-1] for x in prefixes if len(x) == len(s) + 1 and x[:-1] == s}
            at |= {(*s, c): int(nxt[c]) for c in range(codes) if nxt[c] >= 0}
        assert len(set(at.values())) == len(prefixes) == int((trie.check >= 0).sum()) + 1


def test_many_shards_share_a_prefix(spark, monkeypatch):
    """A first turn that all share is in all shards; what goes to the merge are paths, not conversations."""
    monkeypatch.setattr(p, "SHARD", 100)
    rec = lambda k: hashlib.sha256(str(k).encode()).digest()[:16] + (5).to_bytes(4, "big")
    seqs = spark.createDataFrame([(c, bytearray(rec("hot") + rec(c) + rec(-c - 1))) for c in range(5000)], "conv_id long, seq binary")
    nodes = p.distinct(seqs).repartitionByRange(4, "seq").sortWithinPartitions("seq").mapInPandas(p.shards, p.NODE).persist()
    assert nodes.where("key is not null").count() < 8 * nodes.select("shard").distinct().count() < nodes.count() / 10
    nodes.unpersist()
    got = {r.depth: r for r in p.prefix_trie(seqs).groupBy("depth").agg(F.count("*").alias("n"), F.sum("n_children").alias("children"), F.max("n_leaves").alias("leaves"), F.max("saved_tokens").alias("saved")).collect()}
    assert [(got[d].n, got[d].children, got[d].leaves, got[d].saved) for d in range(4)] == [(1, 1, 5000, 4999 * 5), (1, 5000, 5000, 4999 * 5), (5000, 5000, 1, 0), (5000, 0, 1, 0)]
