"""Periodic runs against all periods of all stretches, and the registered query against its definition in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from cubewright.llm import runs
from pyspark.sql import functions as F


def brute(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            s, n = i - p, j - i + p
            if j > i and n >= max(6, 4 * p) and not any(all(w[k] == w[k - q] for k in range(s + q, s + n)) for q in range(1, p)):
                out.append((s, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_up(r, longest=120):
    w = []
    while len(w) < r.choice([3, 30, longest]):
        if r.random() < 0.5:
            base = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 9, 12, 20]))]
            w += [base[i % len(base)] for i in range(r.randint(1, 6 * len(base) + 6))]
        else:
            w += [r.choice("abcdefgh") for _ in range(r.randint(1, 6))]
    return w


@pytest.mark.parametrize("together", [1, 300, 1 << 19])
def test_all_runs(monkeypatch, together):
    monkeypatch.setattr(runs, "TOGETHER", together)
    r = random.Random(3)
    texts = [made_up(r) for _ in range(600)]
    got = runs._detect(runs.pa.array([" \n".join(t) for t in texts])).to_pylist()
    for t, g in zip(texts, got, strict=True):
        found = [(x["start"], x["length"], x["period"]) for x in g["runs"]]
        assert found == brute(t) and g["collapsed"] == kept(t, found)


def test_long_texts_of_few_words():
    one, two = [b"a"] * 200_000, [b"a", b"b"] * 100_000
    found, texts, counts = runs._batch([one, two, one])
    assert found.tolist() == [[0, 200_000, 1], [0, 200_000, 2], [0, 200_000, 1]] and texts == [b"a", b"a b", b"a"] and counts.tolist() == [1, 1, 1]


def digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (None,) * 4
    for s, m, p in found:
        if best[0] is None or m * best[2] > best[1] * p:
            best = (s, m, p, 1000 * m // p)
    return (doc_id, len(found), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(kept(w, found)))


def test_query(spark, sf):
    got = {r.doc_id: tuple(r) for r in runs.op13_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 20000").collect()
    assert sum(got[r.doc_id][1] > 0 for r in rows) > 10
    for r in rows:
        assert got[r.doc_id] == digest(r.doc_id, r.text)


def test_odd_rows(spark, tmp_path):
    texts = [(1, "la " * 9), (1, "la " * 9), (None, "a b a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n"), (18, "x\x0by " * 40), (5, "é é " * 7), (60, "one"), (61, " u v" * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("start", "period", "periodic", "runs", "g", "w")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((digest(*t) for t in texts), key=repr)
    assert sorted((tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()), key=repr) == want
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert runs.op13_runs(spark, str(tmp_path)).count() == 0
    through = runs.periodic_runs(df.drop("periodic"))
    assert through.columns == [c for c in df.columns if c != "periodic"] + ["periodic"] and through.count() == len(texts)
