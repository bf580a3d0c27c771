"""Counts of many blocks go up a tree: same scores, and rows that grow with the blocks."""

import random

import pytest
from cubewright.llm import lm_score
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(9)
    words = ["w" + str(min(int(r.paretovariate(0.7)), 5000)) for _ in range(20000)]
    rows, at = [], 0
    for k in range(400):
        n = r.choice([1, 5, 40, 90])
        rows.append((k, " ".join(words[at : at + n])))
        at += n
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()


def scores(df):
    return {r.doc_id: (r.n_words, r.s) for r in df.select("doc_id", "n_words", F.round("log_score", 6).alias("s")).collect()}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_levels_give_the_same_scores(docs, bits):
    whole = scores(lm_score.stupid_backoff(docs, 3, bits=9))
    assert len(whole) == 400 and scores(lm_score.stupid_backoff(docs, 3, block_bytes=600, bits=bits)) == whole


def test_rows_grow_with_the_blocks(spark, docs, monkeypatch):
    made = lm_score.written
    seen = []

    def counted(df, tag):
        out = made(df, tag)
        seen.append((tag, out.count(), out.groupBy("key").count().agg(F.max("count")).first()[0] if tag == "sent" else None))
        return out

    monkeypatch.setattr(lm_score, "written", counted)
    rows = {}
    for times in (1, 4, 16):
        seen.clear()
        df = docs.limit(100).crossJoin(spark.range(times)).select(F.col("doc_id") * 100 + F.col("id"), "text").toDF("doc_id", "text")
        assert lm_score.stupid_backoff(df.repartition(4), 2, block_bytes=1500, bits=2).count() == 100 * times
        blocks = next(n for tag, n, _ in seen if tag == "blocks")
        sent = [n for tag, n, _ in seen if tag == "sent"]
        assert all(n <= 8 * blocks + 64 for n in sent)
        rows[times] = (blocks, sum(sent))
    assert rows[16][0] > 10 * rows[1][0] and rows[16][1] / rows[16][0] < 2.5 * rows[4][1] / rows[4][0]
