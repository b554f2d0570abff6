from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.operators import clean, series
from gustline.plans import frames, models, recipes
from gustline.session import scratch


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    t0, rows = datetime(2024, 1, 1), []
    for s in ("a", "b"):
        level = 20.0
        for i in range(250):
            level = max(1.0, level + rng.normal())
            rows.append((s, t0 + timedelta(hours=i), float(level), *[float(x) for x in rng.normal(size=12)]))
    names = [c for c in recipes.BASE if c != "pm25"] + list(recipes.DIFFUSION) + list(recipes.GASES)
    schema = "station_id string, timestamp timestamp, pm25 double, " + ", ".join(f"`{c}` double" for c in names)
    return frames.prepare_training(spark.createDataFrame(rows, schema)).cache()


@pytest.mark.parametrize("alpha", [0.0, 5.0, 60.0])
def test_ridge_equals_the_closed_form(spark, frame, alpha):
    cols = list(recipes.BASE)
    matrix, _ = models.design(frame, cols, 2)
    train = matrix.filter("split = 'train'")
    m = models.fit_ridge(train, alpha)
    p = train.select("y", *cols).toPandas()
    x, y = p[cols].to_numpy(), p["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(cols)), xc.T @ yc)
    np.testing.assert_allclose(m.coefficients.toArray(), w, rtol=1e-6, atol=1e-9)
    assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


def test_design_is_scaled_on_the_training_part(frame):
    m = frames.design_matrix(frame, ["pm25", "no"], 1)
    assert m.count() == 2 * 249
    q = m.filter("split = 'train'").toPandas()[["pm25", "no"]].quantile([0.25, 0.5, 0.75])
    np.testing.assert_allclose(q.loc[0.5], 0.0, atol=1e-9)
    np.testing.assert_allclose(q.loc[0.75] - q.loc[0.25], 1.0)


def test_horizons_keep_their_own_features(spark, frame):
    b, scored = models.per_horizon(frame, "lr", recipes.parse_map("1=base6,2=diffusion9"))
    assert {h: len(f) for h, f in b.features.items()} == {1: 6, 2: 9}
    assert b.model_type == "per_horizon:lr" and models.evaluate(scored).count() == 6
    with pytest.raises(ValueError):
        recipes.parse_map("1=nothing")


def records(frame):
    names = recipes.BASE + recipes.DIFFUSION + recipes.GASES
    f = frame.withColumn("features", clean.feature_map(names)).select("station_id", "timestamp", "features")
    return series.history(f, ["station_id"], "timestamp", F.col("features"), 24)


def test_serving_equals_training(spark, frame):
    """A record with its history scores like the training row it came from.

    Rolling means are left out: serving averages the logs, training takes the log of the average.
    """
    cols = [*recipes.BASE, *recipes.GASES, *recipes.TIME, "pm25_lag1", "pm25_lag3"]
    bundles, scored = models.train(frame, ["ha", "lr"], [1, 2], cols)
    out = models.forecast(records(frame), bundles["lr"]).select("station_id", "timestamp", F.explode("forecasts").alias("h", "v"))
    late = scored.filter("model = 'Linear Regression'").filter(F.col("timestamp") >= "2024-01-03").withColumn("h", F.concat(F.lit("h"), "horizon"))
    both = late.join(out, ["station_id", "timestamp", "h"]).select(F.abs(F.greatest("p", F.lit(0.0)) - F.col("v")).alias("d")).toPandas()
    assert len(both) > 700 and both.d.max() < 1e-6

    path = scratch(spark, "bundle")
    bundles["lr"].save(path, spark)
    again = models.forecast(records(frame), models.Bundle.load(path, spark))
    first = models.forecast(records(frame), bundles["lr"])
    assert first.join(again.withColumnRenamed("forecast_pm25", "f2"), ["station_id", "timestamp"]).filter("abs(forecast_pm25 - f2) > 1e-9").count() == 0

    mixed = models.composite(bundles, {1: "ha", 2: "lr"})
    r = models.forecast_and_alert(records(frame), mixed).first()
    assert mixed.model_type == "composite:h1=ha,h2=lr" and r.forecast_pm25 == pytest.approx(bundles["ha"].models[1].value)
    assert r.level in ("normal", "warning", "critical")
    with pytest.raises(FileNotFoundError):
        models.composite(bundles, {3: "lr"})


def test_missing_features_are_zero_and_forecasts_not_negative(spark):
    b = models.Bundle("ha", {2: models.Mean(-5.0)}, {2: ["pm25"]}, {2: {"pm25": (0.0, 1.0)}})
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), {"no": 1.0}, [{"no": 1.0}])],
                               "station_id string, timestamp timestamp, features map<string,double>, history array<map<string,double>>")
    r = models.forecast(df, b).first()
    assert r.forecasts == {"h2": 0.0} and r.forecast_pm25 == 0.0 and r.current_pm25 is None


def test_trials_start_with_the_default_and_repeat(spark):
    for learner, n in (("boosted", 18), ("forest", 12)):
        t = models.tree_trials(3, learner)
        assert len(t) == n and t == models.tree_trials(3, learner)
        assert t[0] == (models.BOOSTED if learner == "boosted" else models.FOREST)[3]
        assert len({tuple(sorted(x.items())) for x in t}) == n


def test_registry_switch(spark):
    r = models.registry_table(spark, {1: "stgnn", 2: "stgnn"})
    assert {tuple(x) for x in models.set_active(r, "lr", [2]).collect()} == {(1, "stgnn"), (2, "lr")}
    with pytest.raises(ValueError):
        models.set_active(r, "other")


def test_feature_lists():
    assert len(recipes.RECIPES["with_lags_pollutants"]) == 24 and len(recipes.features_for("rf", 1)) == 24
    assert recipes.features_for("ha", 3) == ["pm25"] and "wind_alignment" not in recipes.features_for("lr", 1)
    with pytest.raises(ValueError):
        recipes.family("other")
    assert clean.select_features(["b", "z", "a"], ["a", "b"], []) == ["b", "a"]


def test_search_from_moments_equals_fits(spark, frame):
    found = {(r["recipe"], r["alpha"]): r["val_r2"] for r in models.search_ridge(frame, [2], ["base6", "diffusion9"], [0.0, 5.0]).collect()}
    assert len(found) == 4
    for recipe, alpha in found:
        cols = list(recipes.RECIPES[recipe])
        matrix, _ = models.design(frame, cols, 2)
        scored = models.fit_ridge(matrix.filter("split = 'train'"), alpha).transform(matrix.filter("split = 'val'"))
        r2 = models.evaluate(scored.select("split", "y", "p", F.lit("x").alias("model"), F.lit(2).alias("horizon"))).first()["r2"]
        assert found[recipe, alpha] == pytest.approx(r2, abs=1e-6)


def test_tuning_refits_the_best_and_merges(spark, frame):
    old = spark.createDataFrame([("Linear Regression", 1, "val", 0.0, 1.0, 1.0, 1.0), ("Other", 1, "val", 0.5, 1.0, 1.0, 1.0)], "model string, horizon int, split string, r2 double, mae double, mse double, rmse double")
    bundle, metrics = models.tune_ridge(frame, old.select(*[c for c in ("model", "horizon", "split", "r2", "mae", "mse", "rmse")]), [1], ["base6"], [0.0, 5.0])
    got = {(r["model"], r["split"]) for r in metrics.collect()}
    assert bundle.horizons == [1] and ("Other", "val") in got and ("Linear Regression", "test") in got


def test_saving_one_horizon_keeps_the_others(spark, frame):
    path = scratch(spark, "bundle")
    one = models.train(frame, ["ha", "lr"], [1], ["pm25"], log_target=True)[0]
    two = models.train(frame, ["lr"], [2], ["pm25", "no"])[0]
    one["lr"].save(path, spark)
    two["lr"].save(path, spark)
    both = models.Bundle.load(path, spark)
    assert both.horizons == [1, 2] and both.features[2] == ["pm25", "no"] and both.log_target == {1: True, 2: False}
    out = models.forecast(records(frame), both)
    row = out.first()
    assert row["forecasts"]["h1"] >= 0 and abs(row["forecasts"]["h1"] - row["current_pm25"]) < 15


def test_a_nan_feature_counts_as_missing(spark, frame):
    bundle = models.train(frame, ["lr"], [1], ["pm25", "no"])[0]["lr"]
    r = records(frame).limit(1)
    holes = lambda v: r.withColumn("features", F.map_concat(F.map_filter("features", lambda k, _: k != "no"), F.create_map(F.lit("no"), F.lit(v))))
    a, b = (models.forecast(holes(v), bundle).first()["forecast_pm25"] for v in (float("nan"), 0.0))
    assert a == pytest.approx(b)


def test_stored_registry(spark):
    path = scratch(spark, "registry")
    assert {r["horizon"]: r["model"] for r in models.read_registry(spark, path, {1: "ha", 2: "ha"}).collect()} == {1: "ha", 2: "ha"}
    models.write_registry(models.registry_table(spark, {1: "lr", 3: "rf"}), path, 0)
    models.write_registry(models.set_active(models.read_registry(spark, path, {1: "ha", 2: "ha"}), "rf", [1]), path, 1)
    assert {r["horizon"]: r["model"] for r in models.read_registry(spark, path, {2: "lr"}).collect()} == {1: "rf", 2: "ha", 3: "rf"}


def test_every_recipe_keeps_its_own_complete_rows(spark, frame):
    own = [c for c in recipes.RECIPES["diffusion9"] if c not in recipes.RECIPES["base6"]][0]
    holes = frame.withColumn(own, F.when(F.xxhash64("timestamp") % 3 != 0, F.col(own)))
    cols = {n: list(recipes.RECIPES[n]) for n in ("base6", "diffusion9")}
    assert models.same_rows(frame, cols) == [["base6", "diffusion9"]] and models.same_rows(holes, cols) == [["diffusion9"], ["base6"]]
    found = lambda *names: sorted(tuple(r) for r in models.search_ridge(holes, [2], names, [5.0]).filter("alpha = 5.0").select("recipe", "alpha", F.round("val_r2", 9)).collect())
    assert found("base6", "diffusion9") == sorted(found("base6") + found("diffusion9"))
    shown = lambda *names: sorted(tuple(r) for r in models.ablation(holes, names, ["lr"], [2]).select("feature_set", "split", F.round("r2", 9), F.round("mae", 9)).collect())
    assert shown("base6", "diffusion9") == sorted(shown("base6") + shown("diffusion9"))


def test_families_that_keep_the_same_rows_share_a_design_matrix(spark, frame, monkeypatch):
    """One matrix a horizon for both families, with each family's own features and scaling; holes give them their own again."""
    made, whole = [], frames.design_matrix
    monkeypatch.setattr(frames, "design_matrix", lambda frame, features, h, *a, **k: made.append(h) or whole(frame, features, h, *a, **k))
    holes = frame.withColumn("no", F.when(F.col("station_id") == "a", F.col("no")).otherwise(F.lit(float("nan"))))
    rows = lambda scored, name: sorted((r["horizon"], r["station_id"], r["timestamp"], r["split"], r["y"], round(r["p"], 9)) for r in scored.filter(F.col("model") == name).collect())
    bundles, scored = models.train(frame, ["ha", "lr"], [1])
    assert made == [1]
    for f in ("ha", "lr"):
        alone, by_itself = models.train(frame, [f], [1])
        assert alone[f].features == bundles[f].features and alone[f].scaling == bundles[f].scaling
        assert rows(scored, models.NAMES[f]) == rows(by_itself, models.NAMES[f])
    made.clear()
    kept = models.train(holes, ["ha", "lr"], [1])[1].groupBy("model").count().collect()
    assert made == [1, 1] and {r["model"]: r["count"] for r in kept} == {models.NAMES["ha"]: 498, models.NAMES["lr"]: 249}
