"""Missing, repeated and equal ids, and tables that fill up."""

import random
import time

import duckdb
import numpy as np
import pytest
from cubewright.llm import packing, suffix_dedup, topk
from pyspark.sql import functions as F


def test_topk_with_missing_ids_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(None if k % 7 == 3 else k if k % 5 else 100 * (k % 3), rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(400)] + [(None, None), (5, [1.0, None]), (300, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(topk.ORACLE).fetchall(), key=repr)
    for block in (4096, 16):
        got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, pivots=4, block=block, query_block=8).collect()), key=repr)
        assert got == want
    assert any(r[2] is None for r in want)
    three = spark.createDataFrame([(0, [2.0]), (None, [2.5]), (7, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(three, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, None, 5242880), (0, 2, 7, 2097152)]


def test_encoder_with_a_table_that_is_too_small(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.Encoder, "BITS", 5)
    path = packing.default_tokenizer()
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(400)) for _ in range(5)]
    enc, plain = packing.Encoder(path, 1 << 20), Tokenizer.from_file(path)
    for got, t in zip(enc.encode(texts), texts):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids
    assert 2 * enc.full <= len(enc.keys) > 1 << 5
    enc.clear()
    assert len(enc.keys) == 1 << 5 and next(iter(enc.encode(["a"]))).tolist() == plain.encode("a", add_special_tokens=False).ids


def test_packing_deals_out_equal_rows(spark, monkeypatch):
    """Pieces of equal ids and texts don't meet in one window."""
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("row"))
    out = packing.pack(df, packing.default_tokenizer())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    n = rows[0].length
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000 and len({r.sequence_id for r in rows}) == -(-3000 // (2048 // n))
    row = [c for c in out._jdf.queryExecution().optimizedPlan().toString().split("xxhash64(")[1:]]
    assert row and all(c.startswith("__") for c in row)


@pytest.mark.parametrize("copies", [60])
def test_suffix_dedup_of_repeated_rows(spark, copies):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    shared = " ".join(word() for _ in range(80))
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    copy = own[0] + " " + shared + " " + own[1]
    texts = [(None, copy)] * copies + [(3, copy)] * 2 + [(4, own[2] + " " + shared + " " + own[3]), (None, own[4]), (5, own[5])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(df, 400).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "n_removed", "n_spans").collect())
    brute = suffix_dedup.brute_force([t.encode() for _, t in texts], 400)
    assert got == sorted((-1 if d is None else d, n, s) for (d, _), (n, s, _) in zip(texts, brute))


def test_many_equal_rows_cost_no_more(spark):
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(600))
    near = text[:2000] + "x" + text[2000:]

    def took(ids):
        df = spark.range(3000).select(ids.alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(-5, near)], "doc_id long, text string"))
        began = time.time()
        got = {(x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(df, 400).collect()}
        assert len(got) == 2
        return time.time() - began

    took(F.col("id"))
    assert took(F.lit(None).cast("long")) < 4 * took(F.col("id")) + 5
