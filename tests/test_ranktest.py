"""Ranks and rank tests against all pairs of rows."""

import random

import pandas as pd
import pytest
from cubewright.operators import ranktest


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(f"g{r.randrange(12)}", r.choice([round(r.random(), 2), 0.5, 0.5])) for _ in range(3000)]
    return [*out, ("g1", None), ("g2", float("nan")), ("only null", None), (None, 1.0), ("inf", float("inf"))]


def test_all_pairs(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "g string, v double")
    for cells, batch in ((1 << 21, "10000"), (500, "7")):
        monkeypatch.setattr(ranktest, "CELLS", cells)
        old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {(r.a, r.b): (r.n_a, r.n_b, r.u) for r in ranktest.mann_whitney(df, "v", "g").collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        values = {}
        for g, v in rows:
            if g is not None:
                values.setdefault(g, []).extend([v] if v is not None and v == v else [])
        names = sorted(values)
        want = {(a, b): (len(values[a]), len(values[b]), sum((x > y) + (x == y) / 2 for x in values[a] for y in values[b])) for i, a in enumerate(names) for b in names[i + 1 :]}
        assert got == want


def test_chosen_groups(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranktest.mann_whitney(df, "v", "g", ["g3", "g1", "none such"]).collect()
    assert [(r.a, r.b) for r in got] == [("g3", "g1")]
    assert ranktest.mann_whitney(df, "v", "g", []).count() == 0 and ranktest.mann_whitney(df.limit(0), "v", "g").count() == 0


def test_average_ranks(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.value: r.rank for r in ranktest.average_ranks(df, "v").collect()}
    want = pd.Series([v for _, v in rows]).dropna()
    assert got == pytest.approx(dict(zip(want, want.rank())))
    assert ranktest.average_ranks(df.limit(0), "v").count() == 0
