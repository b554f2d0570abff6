"""Model queries. Fits have no SQL form; means, selections and alerts do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, series
from ..plans import frames, models, recipes
from ..session import materialize, scratch
from ..sources import tables as src
from .registry import query
from .timeseries import prepared

_YS = f"""(SELECT *, CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y FROM
  (SELECT station_id, hour, {', '.join(f'lead(pm25, {h}) OVER (PARTITION BY station_id ORDER BY hour) AS y{h}' for h in (1, 2, 3))} FROM pm)
  CROSS JOIN (SELECT unnest([1, 2, 3]) AS h))"""
_YSPLIT = f"""(SELECT *, CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * 0.85e0) THEN 'val' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY h ORDER BY hour, md5(station_id), station_id) AS rn, count(*) OVER (PARTITION BY h) AS n
   FROM {_YS} WHERE y IS NOT NULL))"""


@query("f2_historical_average", f"""SELECT s.station_id, s.hour AS timestamp, 'Historical Average' AS model, s.h AS horizon, s.split, s.y, m.p
FROM {_YSPLIT} s JOIN (SELECT h, avg(y) AS p FROM {_YSPLIT} WHERE split = 'train' GROUP BY 1) m ON s.h = m.h""", "y|p")
def f2_historical_average(spark, d):
    return models.train(prepared(spark, d), ["ha"])[1]


@query("f3_linear")
def f3_linear(spark, d):
    return models.train(prepared(spark, d), ["lr"])[1]


@query("f4_boosted_trees")
def f4_boosted_trees(spark, d):
    """The full settings of the first horizon: 250 trees, one after the other."""
    return models.train(prepared(spark, d), ["rf"], [1])[1]


@query("f5_random_forest")
def f5_random_forest(spark, d):
    """The full settings of every horizon."""
    return models.train(prepared(spark, d), ["rf"], learner="forest")[1]


@query("f6_evaluation")
def f6_evaluation(spark, d):
    scored = models.train(prepared(spark, d), ["ha", "lr"])[1]
    return models.head_to_head(models.evaluate(scored))


def _bundle(spark, d, families=("lr",)):
    frame = prepared(spark, d)
    return frame, models.train(frame, families)[0]


def _records(frame):
    """Feature records of the prepared frame with their history."""
    names = recipes.BASE + recipes.DIFFUSION + recipes.GASES
    f = frame.withColumn("features", clean.feature_map(names)).select("station_id", "timestamp", "features")
    return series.history(f, ["station_id"], "timestamp", F.col("features"), 24)


@query("f7_multi_horizon_forecast")
def f7_multi_horizon_forecast(spark, d):
    frame, b = _bundle(spark, d)
    p = models.forecast(_records(frame), b["lr"])
    return p.select("station_id", "timestamp", "forecast_pm25", "current_pm25", "model_type", F.explode("forecasts").alias("horizon", "forecast"))


@query("f8_per_horizon_features")
def f8_per_horizon_features(spark, d):
    _, scored = models.per_horizon(prepared(spark, d), "lr", recipes.parse_map("1=base6,2=diffusion9,3=with_pollutants"))
    return models.evaluate(scored)


@query("f9_composite_forecast")
def f9_composite_forecast(spark, d):
    """Saved, loaded and combined: the mean at +1 h, linear beyond."""
    frame, b = _bundle(spark, d, ("ha", "lr"))
    path = scratch(spark, "models")
    for name, bundle in b.items():
        bundle.save(f"{path}/{name}", spark)
    loaded = {name: models.Bundle.load(f"{path}/{name}", spark) for name in b}
    mixed = models.composite(loaded, {1: "ha", 2: "lr", 3: "lr"})
    p = models.forecast(_records(frame), mixed)
    return p.select("station_id", "timestamp", "forecast_pm25", "model_type", F.explode("forecasts").alias("horizon", "forecast"))


@query("f10_ablation")
def f10_ablation(spark, d):
    """Every recipe and horizon with the linear model."""
    return models.ablation(prepared(spark, d), list(recipes.RECIPES), ["lr"])


@query("f11_ridge_search")
def f11_ridge_search(spark, d):
    """Every recipe, horizon and penalty."""
    from ..operators.aggregates import best_trial
    return best_trial(models.search_ridge(prepared(spark, d)), ["horizon", "recipe"])


@query("f12_tree_search")
def f12_tree_search(spark, d):
    """All forest settings of the +3 h search with the base recipe."""
    from ..operators.aggregates import best_trial
    return best_trial(models.search_trees(prepared(spark, d), 3, "base6", learner="forest"), ["horizon", "recipe"])


@query("f13_scoring")
def f13_scoring(spark, d):
    frame, b = _bundle(spark, d)
    return models.forecast(_records(frame), b["lr"]).select("station_id", "timestamp", "forecast_pm25", "current_pm25", "model_type")


@query("f14_forecast_and_alert")
def f14_forecast_and_alert(spark, d):
    frame, b = _bundle(spark, d)
    return models.forecast_and_alert(_records(frame), b["lr"]).drop("forecasts")


# With one feature the penalized fit has a short SQL form, so fit, evaluation, composition, scoring and
# alerts can be checked in full.

_ONE = ["pm25"]
_ALPHA = " ".join(f"WHEN {h} THEN {a}e0" for h, a in models.RIDGE_ALPHA.items())
_XY = f"(SELECT *, ln(1 + greatest(x0, 0)) AS lx FROM (SELECT s.*, p.pm25 AS x0 FROM {_YSPLIT} s JOIN pm p ON s.station_id = p.station_id AND s.hour = p.hour))"
_SCALE = f"""(SELECT h, median(lx) AS c, quantile_cont(lx, 0.75) - quantile_cont(lx, 0.25) AS r, avg(y) AS mean_y
  FROM {_XY} WHERE split = 'train' GROUP BY 1)"""
_COEF = f"""(SELECT h, any_value(c) AS c, any_value(r) AS r, any_value(my) AS my, any_value(mx) AS mx,
  sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + CASE h {_ALPHA} END) AS slope FROM
  (SELECT *, avg(x) OVER (PARTITION BY h) AS mx, avg(y) OVER (PARTITION BY h) AS my FROM
    (SELECT t.h, t.y, (t.lx - q.c) / q.r AS x, q.c, q.r FROM {_XY} t JOIN {_SCALE} q ON t.h = q.h WHERE t.split = 'train')) GROUP BY 1)"""
_FIT = "k.my + k.slope * ((ln(1 + greatest({0}, 0)) - k.c) / k.r - k.mx)"
_LINEAR = f"""(SELECT t.station_id, t.hour AS timestamp, 'Linear Regression' AS model, t.h AS horizon, t.split, t.y, {_FIT.format('t.x0')} AS p
  FROM {_XY} t JOIN {_COEF} k ON t.h = k.h)"""
_MEAN = f"""(SELECT t.station_id, t.hour AS timestamp, 'Historical Average' AS model, t.h AS horizon, t.split, t.y, q.mean_y AS p
  FROM {_XY} t JOIN {_SCALE} q ON t.h = q.h)"""
_AHEAD = f"""(SELECT p.station_id, p.hour AS timestamp, p.pm25 AS current_pm25,
  max(CASE WHEN k.h = 1 THEN greatest({_FIT.format('p.pm25')}, 0) END) AS h1, max(CASE WHEN k.h = 2 THEN greatest({_FIT.format('p.pm25')}, 0) END) AS h2,
  max(CASE WHEN k.h = 3 THEN greatest({_FIT.format('p.pm25')}, 0) END) AS h3 FROM pm p CROSS JOIN {_COEF} k GROUP BY 1, 2, 3)"""


def _one_frame(spark, d):
    return materialize(frames.prepare_training(src.pm(spark, d).withColumnRenamed("hour", "timestamp")))


@query("f3_ridge_one_feature", f"SELECT * FROM {_LINEAR}", "y|p")
def f3_ridge_one_feature(spark, d):
    return models.train(_one_frame(spark, d), ["lr"], features=_ONE)[1]


@query("f6_evaluation_one_feature", f"""SELECT model, horizon, split, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) AS r2, avg(abs(y-p)) AS mae,
  avg((y-p)*(y-p)) AS mse, sqrt(avg((y-p)*(y-p))) AS rmse FROM (SELECT * FROM {_LINEAR} UNION ALL SELECT * FROM {_MEAN}) GROUP BY 1, 2, 3""",
       "r2|mae|mse|rmse")
def f6_evaluation_one_feature(spark, d):
    return models.evaluate(models.train(_one_frame(spark, d), ["ha", "lr"], features=_ONE)[1])


@query("f7_forecast_one_feature", f"SELECT station_id, timestamp, current_pm25, h1 AS forecast_pm25, h1, h2, h3 FROM {_AHEAD}",
       "current_pm25|forecast_pm25|h1|h2|h3")
def f7_forecast_one_feature(spark, d):
    frame = _one_frame(spark, d)
    bundle = models.train(frame, ["lr"], features=_ONE)[0]["lr"]
    return models.forecast(_one_records(frame), bundle).select(
        "station_id", "timestamp", "current_pm25", "forecast_pm25", *[F.col("forecasts")[h].alias(h) for h in ("h1", "h2", "h3")])


@query("f13_scoring_one_feature", f"SELECT station_id, timestamp, h1 AS forecast_pm25, current_pm25, 'lr' AS model_type FROM {_AHEAD}", "current_pm25|forecast_pm25")
def f13_scoring_one_feature(spark, d):
    """Every record of the table scored with a bundle that was stored and read again."""
    frame, path = _one_frame(spark, d), scratch(spark, "models")
    models.train(frame, ["lr"], features=_ONE)[0]["lr"].save(path, spark)
    return models.forecast(_one_records(frame), models.Bundle.load(path, spark)).select("station_id", "timestamp", "forecast_pm25", "current_pm25", "model_type")


def _one_records(frame):
    f = frame.withColumn("features", clean.feature_map(_ONE)).select("station_id", "timestamp", "features")
    return series.history(f, ["station_id"], "timestamp", F.col("features"), 24)


@query("f9_composite_one_feature", f"""SELECT a.station_id, a.timestamp, m.mean_y AS forecast_pm25, a.h2, a.h3,
  'composite:h1=ha,h2=lr,h3=lr' AS model_type FROM {_AHEAD} a JOIN {_SCALE} m ON m.h = 1""", "forecast_pm25|h2|h3")
def f9_composite_one_feature(spark, d):
    """Mean at +1 h, linear beyond, after saving and loading both families."""
    frame = _one_frame(spark, d)
    bundles, path = models.train(frame, ["ha", "lr"], features=_ONE)[0], scratch(spark, "models")
    for name, b in bundles.items():
        b.save(f"{path}/{name}", spark)
    loaded = {name: models.Bundle.load(f"{path}/{name}", spark) for name in bundles}
    mixed = models.composite(loaded, {1: "ha", 2: "lr", 3: "lr"})
    return models.forecast(_one_records(frame), mixed).select(
        "station_id", "timestamp", "forecast_pm25", F.col("forecasts")["h2"].alias("h2"), F.col("forecasts")["h3"].alias("h3"), "model_type")


@query("f14_alert_one_feature", f"""SELECT station_id, timestamp, current_pm25, h1 AS forecast_pm25, CASE WHEN greatest(h1, current_pm25) >= 125.5e0 THEN 'critical'
  WHEN greatest(h1, current_pm25) >= 35.5e0 THEN 'warning' ELSE 'normal' END AS level, greatest(h1, current_pm25) >= 35.5e0 AS alert FROM {_AHEAD}""",
       "current_pm25|forecast_pm25")
def f14_alert_one_feature(spark, d):
    frame = _one_frame(spark, d)
    bundle = models.train(frame, ["lr"], [1], features=_ONE)[0]["lr"]
    return models.forecast_and_alert(_one_records(frame), bundle).select(
        "station_id", "timestamp", "current_pm25", "forecast_pm25", "level", "alert")


_OWN = {"own": _ONE}
_METRICS = """1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) AS r2, avg(abs(y-p)) AS mae, avg((y-p)*(y-p)) AS mse, sqrt(avg((y-p)*(y-p))) AS rmse"""


@query("f8_per_horizon_one_feature", f"SELECT model, horizon, split, {_METRICS} FROM {_LINEAR} GROUP BY 1, 2, 3", "r2|mae|mse|rmse")
def f8_per_horizon_one_feature(spark, d):
    return models.evaluate(models.per_horizon(_one_frame(spark, d), "lr", {1: "own", 2: "own", 3: "own"}, _OWN)[1])


@query("f10_ablation_one_feature", f"SELECT 'own' AS feature_set, model, horizon, split, {_METRICS} FROM {_LINEAR} GROUP BY 1, 2, 3, 4", "r2|mae|mse|rmse")
def f10_ablation_one_feature(spark, d):
    return models.ablation(_one_frame(spark, d), ["own"], ["lr"], table=_OWN)


_TRIED = ", ".join(f"{a}e0" for a in models.SEARCH_ALPHAS)


@query("f11_ridge_search_one_feature", f"""SELECT CAST(h AS INT) AS horizon, 'own' AS recipe, alpha, CAST(trial AS INT) AS trial,
  1 - sum((y - my - slope * (x - mx)) * (y - my - slope * (x - mx))) / (var_pop(y) * count(y)) AS val_r2 FROM
  (SELECT v.h, v.y, (v.lx - q.c) / q.r AS x, k.my, k.mx, k.sxy / (k.sxx + a.alpha) AS slope, a.alpha, a.trial FROM {_XY} v JOIN {_SCALE} q ON v.h = q.h
   JOIN (SELECT h, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM
     (SELECT t.h, t.y, (t.lx - q.c) / q.r AS x FROM {_XY} t JOIN {_SCALE} q ON t.h = q.h WHERE t.split = 'train') GROUP BY 1) k ON v.h = k.h
   CROSS JOIN (SELECT unnest([{_TRIED}]) AS alpha, unnest(range(11)) AS trial) a WHERE v.split = 'val') GROUP BY 1, 2, 3, 4""", "alpha|val_r2")
def f11_ridge_search_one_feature(spark, d):
    """Every penalty at every horizon from one set of cross products."""
    return models.search_ridge(_one_frame(spark, d), names=["own"], table=_OWN)


_STUMP = f"""(SELECT s.station_id, s.hour AS timestamp, s.split, s.y, CASE WHEN hour(s.hour) <= b.cut THEN b.low ELSE b.high END AS p FROM {_YSPLIT} s,
  (SELECT cut, low, high FROM (SELECT cut, avg(y) FILTER (WHERE x <= cut) AS low, avg(y) FILTER (WHERE x > cut) AS high,
     sum(y) FILTER (WHERE x <= cut) ** 2 / count(y) FILTER (WHERE x <= cut) + sum(y) FILTER (WHERE x > cut) ** 2 / count(y) FILTER (WHERE x > cut) AS gain
   FROM (SELECT hour(hour) AS x, y FROM {_YSPLIT} WHERE h = 1 AND split = 'train') CROSS JOIN (SELECT unnest(range(23)) AS cut) GROUP BY 1)
   ORDER BY gain DESC LIMIT 1) b WHERE s.h = 1)"""


def _stump(spark, d, learner, **setting):
    frame = _one_frame(spark, d).withColumn("hod", F.hour("timestamp").cast("double"))
    return models.train(frame, ["rf"], [1], ["hod"], learner, {"rf": setting})[1].select("station_id", "timestamp", "split", "y", "p")


@query("f4_boosted_one_cut", f"SELECT * FROM {_STUMP}", "y|p")
def f4_boosted_one_cut(spark, d):
    """One unsampled tree with one cut of the hour of day, which SQL can find."""
    return _stump(spark, d, "boosted", trees=1, depth=1, share=1.0)


@query("f5_forest_one_cut", f"SELECT * FROM {_STUMP}", "y|p")
def f5_forest_one_cut(spark, d):
    return _stump(spark, d, "forest", trees=1, depth=1, leaf=1, bootstrap=False)


# One penalized tree with one cut of the hour of day. {r}, {a}, {l}: rate and penalties.
_PULL = "greatest(abs({0}) - {a}, 0)"
_LEAF = "m + {r} * sign({0}) * greatest(abs({0}) - {a}, 0) / ({1} + {l})"
_CELLS_BY_HOUR = f"""(SELECT cut, any_value(m) AS m, sum(y - m) FILTER (WHERE x <= cut) AS sl, count(*) FILTER (WHERE x <= cut) AS nl,
  sum(y - m) FILTER (WHERE x > cut) AS sh, count(*) FILTER (WHERE x > cut) AS nh
  FROM (SELECT hour(hour) AS x, y, avg(y) OVER () AS m FROM {_YSPLIT} WHERE h = 1 AND split = 'train') CROSS JOIN (SELECT unnest(range(23)) AS cut) GROUP BY 1)"""
_TRIALS = [{"rate": r, "l2": l2, "l1": l1} for r in (0.1, 0.5, 1.0) for l2 in (0.0, 15.0) for l1 in (0.0, 2.0)]
_ONE_CUT = {"trees": 1, "depth": 1, "columns": 1.0, "least": 1}


def _penalized(name, at, r, a, l):
    """Rows of one horizon scored by the best cut of each ``at``; ``r``, ``a``, ``l`` are numbers or columns of ``name``."""
    pull, leaf = (lambda s: _PULL.format(s, a=a)), (lambda s, n: _LEAF.format(s, n, r=r, a=a, l=l))
    return f"""(SELECT s.station_id, s.hour AS timestamp, s.split, s.y, b.trial, CASE WHEN hour(s.hour) <= b.cut THEN b.low ELSE b.high END AS p FROM {_YSPLIT} s,
  (SELECT trial, cut, {leaf('sl', 'nl')} AS low, {leaf('sh', 'nh')} AS high,
     row_number() OVER (PARTITION BY trial ORDER BY {pull('sl')} ** 2 / (nl + {l}) + {pull('sh')} ** 2 / (nh + {l}) DESC, cut) AS best
   FROM {_CELLS_BY_HOUR} CROSS JOIN {at} {name} WHERE nl > 0 AND nh > 0) b WHERE s.h = 1 AND b.best = 1)"""


@query("f4_penalized_one_cut", f"SELECT station_id, timestamp, split, y, p FROM {_penalized('o', '(SELECT 0 AS trial)', '0.3e0', '20e0', '50e0')}", "y|p")
def f4_penalized_one_cut(spark, d):
    """One tree of one cut with a rate and both leaf penalties, which SQL can find."""
    return _stump(spark, d, "penalized", rate=0.3, l1=20.0, l2=50.0, **_ONE_CUT)


_TRIAL_ROWS = ", ".join(f"({i}, {t['rate']}e0, {t['l1']}e0, {t['l2']}e0)" for i, t in enumerate(_TRIALS))


@query("f12_penalized_search_one_cut", f"""SELECT 1 AS horizon, 'hour' AS recipe, trial, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) AS val_r2
  FROM {_penalized('o', f'(SELECT * FROM (VALUES {_TRIAL_ROWS}) AS v(trial, rate, l1, l2))', 'rate', 'l1', 'l2')} WHERE split = 'val' GROUP BY trial""", "val_r2")
def f12_penalized_search_one_cut(spark, d):
    """Twelve rates and penalties, all grown in the same job."""
    frame = _one_frame(spark, d).withColumn("hod", F.hour("timestamp").cast("double"))
    found = models.search_trees(frame, 1, "hour", "penalized", [_ONE_CUT | t for t in _TRIALS], table={"hour": ["hod"]})
    return found.select("horizon", "recipe", "trial", "val_r2")


_LINE = f"""(SELECT s.split, s.y, k.i + k.s * hour(s.hour) AS p FROM {_YSPLIT} s, (SELECT regr_intercept(y, hour(hour)) AS i,
  regr_slope(y, hour(hour)) AS s FROM {_YSPLIT} WHERE h = 1 AND split = 'train') k WHERE s.h = 1)"""


@query("f10_ablation_both_families", f"""SELECT 'hour' AS feature_set, model, 1 AS horizon, split, {_METRICS} FROM
  (SELECT 'Linear Regression' AS model, split, y, p FROM {_LINE} UNION ALL
   SELECT 'Gradient Boosting/RF', split, y, p FROM {_penalized('o', '(SELECT 0 AS trial)', '0.3e0', '2e0', '15e0')}) GROUP BY model, split""", "r2|mae|mse|rmse")
def f10_ablation_both_families(spark, d):
    """The hour of day alone, in a linear model and in a penalized tree of one cut."""
    frame = _one_frame(spark, d).withColumn("hod", F.hour("timestamp").cast("double"))
    return models.ablation(frame, ["hour"], ["lr", "rf"], [1], "penalized", {"rf": _ONE_CUT | {"rate": 0.3, "l1": 2.0, "l2": 15.0}}, {"hour": ["hod"]})
