"""Exact and sketched quantiles, and distinct counts of many columns."""

import bisect

import numpy as np
import pandas as pd
import pytest
from cubewright.operators import quantiles
from cubewright.operators import report as R
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def values(spark):
    """A group of 60,000 skewed values, one of few different values, small ones, and one without a value."""
    rng = np.random.default_rng(3)
    groups = {"large": rng.lognormal(0, 4, 60_000), "ties": rng.choice([1.0, 2.0, 3.0, 3.5], 50_000, p=[0.2499, 0.0002, 0.2499, 0.5]), "two": np.array([1.0, 2.0]), "one": np.array([7.0]), "signs": np.array([-0.0, 0.0, -5, 5, 1e300, -1e300])}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()] + [pd.DataFrame({"g": ["none", "two"], "v": [None, None]})])
    return groups, spark.createDataFrame(pdf.sample(frac=1, random_state=1).astype({"v": "Float64"}).astype(object).where(lambda d: d.notna(), None), "g string, v double").persist()


@pytest.mark.parametrize("small", [20_000, 0])
def test_exact(values, monkeypatch, small):
    groups, df = values
    monkeypatch.setattr(quantiles, "SMALL", small)
    if not small:
        df = df.where("g in ('large', 'ties')")
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", {"top": F.max("v")}).collect()}
    assert set(got) == {k for k in groups if small or k in ("large", "ties")}
    for k, r in got.items():
        assert r.n == len(groups[k]) and r.top == groups[k].max() and list(r.q) == pytest.approx(np.quantile(groups[k], [0.25, 0.5, 0.75]), rel=1e-12)


def test_few_values_are_put_in_order(values):
    _, df = values
    plan = quantiles.exact_quantiles(df.where("g = 'large'"), ["g"], "v")
    plan.collect()
    cells = [n for n in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in n]
    assert cells and "percentile(" not in plan._jdf.queryExecution().toString()


def test_box_stats_has_no_switch(values):
    groups, df = values
    got = {r.grp: r for r in R.distribution(df, ["v"], "g").collect()}
    assert got["large"].q50 == pytest.approx(np.median(groups["large"])) and got["two"].q25 == 1.25 and got["large"].mode == "box"


def test_merged_sketches(spark, values, tmp_path):
    groups, df = values
    for k in range(3):
        quantiles.sketches(df.where(F.abs(F.xxhash64("v")) % 3 == k), ["g"], "v").write.parquet(f"{tmp_path}/{k}")
    stored = spark.read.parquet(*(f"{tmp_path}/{k}" for k in range(3)))
    for r in quantiles.sketched_quantiles(quantiles.merged_sketches(stored, ["g"]), ["g"]).collect():
        v = sorted(groups[r.g])
        assert r.n == len(v) and r.max == v[-1]
        for p, q in zip((0.25, 0.5, 0.75), r.q):
            assert bisect.bisect_left(v, q) / len(v) - 0.02 <= p <= bisect.bisect_right(v, q) / len(v) + 0.02 or len(v) < 10


def test_distinct_counts(spark):
    rows = [(1, 0.0, "a", [1, 2], b"\xff\x00"), (1, -0.0, "b", [12], b"\xff"), (2, float("nan"), None, [1, 2], None), (None, float("nan"), "a", None, b"\xff")]
    df = spark.createDataFrame(rows, "i int, d double, `s.t` string, l array<int>, b binary")
    got = {r.column: r.n_distinct for r in R.distinct_counts(df, df.columns).collect()}
    assert got == {"i": 2, "d": 2, "s.t": 2, "l": 2, "b": 2}
    assert R.inconsistencies(df.select("i").where("i is null"), ["i"]).collect()[0].n_distinct == 0


def test_many_columns_without_expand(spark):
    df = spark.range(1000).select(*(F.pmod(F.col("id") * (k + 1), F.lit(k + 1)).alias(f"c{k}") if k % 2 else F.pmod("id", F.lit(k + 1)).alias(f"c{k}") for k in range(200)))
    out = R.column_profile(df)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.column: r.n_distinct for r in out.collect()}
    assert len(got) == 200 and got["c199"] == 1 and got["c198"] == 199


def test_default_group_counts_exactly(spark):
    for n in (12, 13):
        df = spark.range(500).select(F.pmod("id", F.lit(n)).cast("string").alias("a"), F.pmod("id", F.lit(3)).cast("string").alias("b"))
        assert R.default_group(df).first()[0] == ("a" if n == 12 else "b")
