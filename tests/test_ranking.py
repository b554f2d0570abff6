import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gustline.operators import aggregates, diffusion, ranking


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
@pytest.mark.parametrize("shape", ["normal", "ties", "outlier"])
def test_percentiles_are_exact(spark, shape, accuracy):
    rng = np.random.default_rng(2)
    v = {"normal": rng.normal(size=1500), "ties": rng.integers(0, 4, 1500).astype(float), "outlier": np.append(rng.random(1499), 1e12)}[shape]
    p = pd.DataFrame({"k": np.where(np.arange(1500) % 3 == 0, "a", "b"), "v": v, "w": -v})
    df, probs = spark.createDataFrame(p), [0.0, 0.01, 0.5, 0.99, 1.0]
    for r in ranking.exact_percentiles(df, ["k"], ["v", "w"], probs, accuracy).collect():
        for c in ("v", "w"):
            np.testing.assert_allclose(r[f"{c}__q"], p[p.k == r.k][c].quantile(probs), rtol=1e-12)
    np.testing.assert_allclose(ranking.exact_percentiles(df, [], ["v"], probs, accuracy).first()[0], p.v.quantile(probs), rtol=1e-12)


def test_percentiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "v double, w double")
    r = ranking.exact_percentiles(df, [], ["v", "w"], [0.5]).first()
    assert r["v__q"] == [2.0] and r["w__q"] == [None]


def test_split_counts_and_order(spark):
    """Most rows share one time: the cut falls inside it."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 900, "2024-01-02").otherwise("2024-01-01").cast("timestamp").alias("ts"))
    out = ranking.chronological_split(df, "ts", "k").toPandas()
    assert out.split.value_counts().to_dict() == {"train": 700, "val": 150, "test": 150}
    assert (out[out.ts == "2024-01-01"].split == "train").all()


@pytest.mark.parametrize("n,rate,count", [(100, 0.10, 10), (7, 0.5, 4), (5, 0.5, 2), (10, 0.0, 0)])
def test_sample_is_exact_and_repeatable(spark, n, rate, count):
    df = spark.range(n)
    a = diffusion.inject_missing(df, [rate], 3, ["id"]).collect()
    assert len(a) == count and sorted(a) == sorted(diffusion.inject_missing(df, [rate], 3, ["id"]).collect())


def test_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 1.5), ("m", 3.0, 2.5), ("m", None, 1.0), ("m", float("nan"), 1.0),
                                ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 1.0), ("none", None, 1.0)],
                               "model string, y double, p double")
    got = {r.model: r for r in aggregates.regression_metrics(df, ["model"]).collect()}
    assert (got["m"].r2, got["m"].mae, got["m"].mse, got["m"].rmse) == (0.75, 0.5, 0.25, 0.5)
    assert got["flat"].r2 == 1.0 and got["off"].r2 == 0.0
    assert (got["none"].r2, got["none"].mae) == (0.0, 0.0)


def test_first_trial_wins_a_tie(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.4)], "horizon int, trial int, val_r2 double")
    assert aggregates.best_trial(df, ["horizon"]).first().trial == 0
