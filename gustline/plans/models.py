"""Forecasting models on MLlib and penalized boosted trees: fit, score, evaluate, search, persist, select."""

from __future__ import annotations

import functools
import itertools
import json
import operator
import random
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import alerts, scalar
from ..operators import aggregates, clean
from ..session import materialize
from ..sources import sinks
from . import boosting, frames, recipes

# Settings per horizon.
RIDGE_ALPHA = {1: 0.0, 2: 5.0, 3: 15.0}
BOOSTED = {
    1: {"trees": 250, "rate": 0.04, "depth": 6},
    2: {"trees": 250, "rate": 0.04, "depth": 6},
    3: {"trees": 200, "rate": 0.03, "depth": 5},
}
PENALIZED = {
    1: {"trees": 250, "rate": 0.04, "depth": 6, "l2": 0.0, "l1": 0.0},
    2: {"trees": 250, "rate": 0.04, "depth": 6, "l2": 1.0, "l1": 0.0},
    3: {"trees": 200, "rate": 0.03, "depth": 5, "l2": 2.0, "l1": 0.1},
}
FOREST = {
    1: {"trees": 40, "depth": 12, "leaf": 1},
    2: {"trees": 60, "depth": 8, "leaf": 4},
    3: {"trees": 80, "depth": 6, "leaf": 8},
}
# Search spaces.
SEARCH_ALPHAS = (0.0, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 25.0, 40.0, 60.0)
SEARCH_BOOSTED = {"rate": (0.01, 0.02, 0.03, 0.04), "depth": (3, 4, 5, 6), "trees": (150, 200, 250, 300, 450)}
SEARCH_PENALTIES = {"l2": (0.0, 1.0, 2.0, 5.0, 10.0, 15.0), "l1": (0.0, 0.1, 0.5, 1.0, 2.0)}
BOOSTED_TRIALS, FOREST_TRIALS = 18, 12
NAMES = {"ha": "Historical Average", "lr": "Linear Regression", "rf": "Gradient Boosting/RF"}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="error").transform(df)


def fit_ridge(train: DataFrame, alpha: float):
    """Least squares with penalty ``alpha`` on the coefficients, intercept free, in closed form.

    The solver minimizes the mean of the squared errors over the label's deviation, hence the factor
    on the penalty. It needs one pass for the moments of the features.
    """
    reg = 0.0
    if alpha:
        n, sd = train.agg(F.count("y"), F.stddev_pop("y")).first()
        reg = alpha / n * sd if n else 0.0
    return LinearRegression(featuresCol="x", labelCol="y", predictionCol="p", solver="normal", standardization=False,
                            regParam=reg, elasticNetParam=0.0).fit(train)


ROWS_A_TASK = 200_000


def fit_boosted(train: DataFrame, trees: int, rate: float, depth: int, seed: int = 42, share: float = 0.8):
    """Boosting runs a few jobs a tree, one tree after the other, so a small frame goes into few tasks."""
    train = train.coalesce(max(1, -(-train.count() // ROWS_A_TASK)))
    return GBTRegressor(featuresCol="x", labelCol="y", predictionCol="p", maxIter=trees, stepSize=rate, maxDepth=depth,
                        subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed).fit(train)


def fit_forest(train: DataFrame, trees: int, depth: int, leaf: int, seed: int = 42, bootstrap: bool = True):
    return RandomForestRegressor(featuresCol="x", labelCol="y", predictionCol="p", numTrees=trees, maxDepth=depth, bootstrap=bootstrap,
                                 minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed).fit(train)


def moments(matrix: DataFrame, features: Sequence[str]) -> dict[str, np.ndarray]:
    """Per split the cross products of (1, features, y): one pass, one small matrix a batch, summed in Spark.

    With these every least-squares fit and its errors on any subset of the features follow without another pass.
    """
    cols, width = [f"c{i}" for i in range(len(features))], len(features) + 2
    rows = matrix.select("split", *[clean.named(f).cast("double").alias(c) for f, c in zip(features, cols)], F.col("y").cast("double").alias("y"))

    def cross(batches):
        for b in batches:
            split = np.asarray(b.column("split").to_pylist(), dtype=object)
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False) for c in (*cols, "y")]])
            for s in sorted(set(split)):
                part = x[split == s]
                g = (part.T @ part).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(g), pa.string()), pa.array(range(len(g)), pa.int32()), pa.array(g)], ["split", "at", "v"])
    total = rows.mapInArrow(cross, "split string, at int, v double").groupBy("split", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in total:
        out.setdefault(r["split"], np.zeros(width * width))[r["at"]] = r["v"]
    return {s: g.reshape(width, width) for s, g in out.items()}


def ridge_from_moments(g: np.ndarray, at: Sequence[int], alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the features at positions ``at``; the intercept is not penalized."""
    i, n = [a + 1 for a in at], g[0, 0]
    mean, mean_y = g[0, i] / n, g[0, -1] / n
    a = g[np.ix_(i, i)] - n * np.outer(mean, mean) + alpha * np.eye(len(i))
    w = np.linalg.lstsq(a, g[i, -1] - n * mean * mean_y, rcond=None)[0]
    return float(mean_y - mean @ w), w


def r2_from_moments(g: np.ndarray, at: Sequence[int], intercept: float, w: np.ndarray) -> float:
    """R2 of a linear model on the rows behind ``g``; 1 or 0 for a constant label, as in ``regression_metrics``."""
    i, beta = [0, *[a + 1 for a in at]], np.array([intercept, *w])
    sse = g[-1, -1] - 2 * beta @ g[i, -1] + beta @ g[np.ix_(i, i)] @ beta
    sst = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    return float(1 - sse / sst) if sst > 0 else float(sse <= 0)


@dataclass
class Mean:
    """Predicts the training mean."""

    value: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.lit(self.value))


def fit_mean(train: DataFrame) -> Mean:
    return Mean(float(train.agg(F.avg(F.nanvl("y", F.lit(None)))).first()[0] or 0.0))


def fit(family: str, train: DataFrame, horizon: int, learner: str = "boosted", **overrides):
    """Fit a family with its settings for the horizon."""
    if family == "ha":
        return fit_mean(train)
    if family == "lr":
        return fit_ridge(train, overrides.get("alpha", RIDGE_ALPHA[horizon]))
    if family == "rf" and learner == "boosted":
        return fit_boosted(train, **(BOOSTED[horizon] | overrides))
    if family == "rf" and learner == "penalized":
        return boosting.fit(train, **({"columns": 0.8} | PENALIZED[horizon] | overrides))
    if family == "rf":
        return fit_forest(train, **(FOREST[horizon] | overrides))
    raise ValueError(f"Unsupported model family: {family}")


def nonnegative(df: DataFrame, col: str = "p") -> DataFrame:
    return df.withColumn(col, F.greatest(F.col(col), F.lit(0.0)))


@dataclass
class Bundle:
    """One fitted model per horizon with the features and the scaling it was trained with."""

    model_type: str
    models: dict[int, object] = field(default_factory=dict)
    features: dict[int, list[str]] = field(default_factory=dict)
    scaling: dict[int, dict[str, tuple[float, float]]] = field(default_factory=dict)
    target: str = "pm25"
    lookback: int = frames.LOOKBACK

    #: the label was the log of the target, so forecasts are taken back from it
    log_target: dict[int, bool] = field(default_factory=dict)

    @property
    def horizons(self) -> list[int]:
        return sorted(self.models)

    def add(self, other: Bundle, horizon: int) -> None:
        """Take over one horizon of another bundle."""
        for mine, theirs in ((self.models, other.models), (self.features, other.features), (self.scaling, other.scaling), (self.log_target, other.log_target)):
            if horizon in theirs:
                mine[horizon] = theirs[horizon]

    def save(self, path: str, spark: SparkSession) -> None:
        """Each horizon on its own: the model through MLlib, the rest as one JSON row. Other horizons stored there stay."""
        for h, m in self.models.items():
            if isinstance(m, boosting.Boosted):
                spark.createDataFrame(m.to_rows(), boosting.ROWS).write.mode("overwrite").parquet(f"{path}/h{h}")
            elif not isinstance(m, Mean):
                PipelineModel([m]).write().overwrite().save(f"{path}/h{h}")
            meta = {"model_type": self.model_type, "target": self.target, "lookback": self.lookback, "features": self.features[h],
                    "scaling": self.scaling.get(h, {}), "mean": m.value if isinstance(m, Mean) else None, "binned": isinstance(m, boosting.Boosted), "log_target": self.log_target.get(h, False)}
            spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta/horizon={h}")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Bundle:
        out = None
        for row in spark.read.schema("meta string, horizon int").parquet(f"{path}/meta").orderBy("horizon").collect():  # one row a horizon
            h, meta = row["horizon"], json.loads(row["meta"])
            out = out or cls(meta["model_type"], target=meta["target"], lookback=meta["lookback"])
            if meta["mean"] is not None:
                out.models[h] = Mean(meta["mean"])
            elif meta.get("binned"):
                nodes = spark.read.schema(boosting.ROWS).parquet(f"{path}/h{h}")
                out.models[h] = boosting.Boosted.from_rows([tuple(r) for r in nodes.collect()])  # bounded by the setting
            else:
                out.models[h] = PipelineModel.load(f"{path}/h{h}").stages[0]
            out.features[h], out.log_target[h] = meta["features"], meta["log_target"]
            out.scaling[h] = {f: tuple(v) for f, v in meta["scaling"].items()}
        return out


def composite(bundles: Mapping[str, Bundle], horizon_families: Mapping[int, str]) -> Bundle:
    """A different family per horizon. A family without a model for its horizon fails."""
    label = "composite:" + ",".join(f"h{h}={f}" for h, f in sorted(horizon_families.items()))
    out = Bundle(label)
    for h, f in sorted(horizon_families.items()):
        if f not in bundles or h not in bundles[f].models:
            raise FileNotFoundError(f"no trained model for {f} at +{h}h")
        out.add(bundles[f], h)
    return out


def scaling_of(frame: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = aggregates.robust_scale_params(frame, features).first()
    return {f: (row[f]["center"], row[f]["scale"]) for f in features}


def apply_scaling(df: DataFrame, scaling: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: F.expr(f"(`{f}` - {c!r}D) / {s!r}D") for f, (c, s) in scaling.items()})


def design(frame: DataFrame, features: Sequence[str], horizon: int, keys: Sequence[str] = frames.KEYS):
    """(assembled and stored design matrix, scaling). Stored once: fits and scores pass over it often."""
    raw = frames.design_matrix(frame, features, horizon, keys, scale=False)
    scaling = scaling_of(raw.filter("split = 'train'"), features)
    return assemble(apply_scaling(raw, scaling), features), scaling


def train(frame: DataFrame, families: Iterable[str] = ("ha", "lr", "rf"), horizons: Iterable[int] = recipes.HORIZONS,
          features: Sequence[str] | None = None, learner: str = "boosted",
          overrides: Mapping[str, dict] = {}, log_target: bool = False) -> tuple[dict[str, Bundle], DataFrame]:
    """Fit families at horizons. Returns bundles and the scored rows (model, horizon, split, y, p).

    With ``log_target`` the label is log1p of the target, and predictions are taken back and never negative. Families whose features keep the same rows share one design matrix per horizon.
    """
    bundles, horizons, scored = {f: Bundle(f) for f in families}, list(horizons), []
    cols = {(h, f): clean.select_features(features, frame.columns, []) if features else recipes.features_for(f, h) for h in horizons for f in bundles}
    several = any(len({tuple(cols[h, f]) for f in bundles}) > 1 for h in horizons)
    groups = same_rows(frame, cols) if several else [list(cols)]
    for h in horizons:
        made: dict[str, tuple[DataFrame, dict]] = {}
        for group in groups:
            alike = {f: cols[h, f] for at, f in group if at == h}
            if alike:
                every = list(dict.fromkeys(c for cs in alike.values() for c in cs))
                raw = frames.design_matrix(frame, every, h, scale=False)
                scaling = scaling_of(raw.filter("split = 'train'"), every)
                made.update({f: (assemble(apply_scaling(raw, scaling), cs), {c: scaling[c] for c in cs}) for f, cs in alike.items()})
        for f in bundles:
            matrix, scaling = made[f]
            label = scalar.log_clip(F.col("y")) if log_target else F.col("y")
            model = fit(f, matrix.filter("split = 'train'").withColumn("y", label), h, learner, **overrides.get(f, {}))
            bundles[f].models[h], bundles[f].features[h], bundles[f].scaling[h] = model, cols[h, f], scaling
            bundles[f].log_target[h] = log_target
            predicted = model.transform(matrix)
            if log_target:
                predicted = predicted.withColumn("p", scalar.exp_clip(F.col("p")))
            scored.append(predicted.select(
                "station_id", "timestamp", F.lit(NAMES.get(f, f)).alias("model"), F.lit(h).alias("horizon"), "split", "y", "p"))
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return bundles, out


def evaluate(scored: DataFrame) -> DataFrame:
    """Metrics per model, horizon and split, of the raw predictions."""
    return aggregates.regression_metrics(scored, ["model", "horizon", "split"])


def head_to_head(metrics: DataFrame) -> DataFrame:
    """One row per model and horizon, splits side by side."""
    splits = ["train", "val", "test"]
    return metrics.groupBy("horizon", "model").pivot("split", splits).agg(
        F.first("r2").alias("r2"), F.first("mae").alias("mae"), F.first("rmse").alias("rmse"))


def per_horizon(frame: DataFrame, family: str, horizon_recipes: Mapping[int, str],
                table: Mapping[str, Sequence[str]] = recipes.RECIPES, **kw) -> tuple[Bundle, DataFrame]:
    """A bundle whose horizons use their own feature lists, named in ``table``."""
    out, scored = Bundle(f"per_horizon:{family}"), None
    for h, name in sorted(horizon_recipes.items()):
        bundles, s = train(frame, [family], [h], table[name], **kw)
        b = bundles[family]
        out.add(b, h)
        scored = s if scored is None else scored.unionByName(s)
    return out, scored


def same_rows[K](frame: DataFrame, cols: Mapping[K, Sequence[str]]) -> list[list[K]]:
    """Recipes in groups that keep the same rows when incomplete ones are dropped.

    Rows complete in the columns of all recipes are complete in those of each, so a recipe that keeps as many keeps the same. These share a design matrix, any
    other recipe has its own. One pass counts for all.
    """
    complete = lambda cs: functools.reduce(operator.and_, [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in cs], F.lit(True))
    every = list(dict.fromkeys(c for cs in cols.values() for c in cs))
    kept = frame.agg(F.count_if(complete(every)), *[F.count_if(complete(cs)) for cs in cols.values()]).first()  # one row
    shared = [name for name, n in zip(cols, kept[1:], strict=True) if n == kept[0]]
    return ([shared] if shared else []) + [[name] for name in cols if name not in shared]


def ablation(frame: DataFrame, names: Iterable[str], families: Iterable[str] = ("lr", "rf"), horizons: Iterable[int] = recipes.HORIZONS,
             learner: str = "boosted", overrides: Mapping[str, dict] = {}, table: Mapping[str, Sequence[str]] = recipes.RECIPES) -> DataFrame:
    """Metrics of every feature recipe: (feature_set, model, horizon, split, r2, mae, mse, rmse).

    Every recipe keeps the rows that are complete in its own features, as if it were trained alone. Recipes that keep the same rows share one
    design matrix a horizon.
    """
    cols, out = {name: clean.select_features(table[name], frame.columns, []) for name in names}, None
    for h, group in itertools.product(horizons, same_rows(frame, cols)):
        every = list(dict.fromkeys(c for name in group for c in cols[name]))
        raw = frames.design_matrix(frame, every, h, scale=False)
        scaled = materialize(apply_scaling(raw, scaling_of(raw.filter("split = 'train'"), every)))
        for name in group:
            matrix = assemble(scaled, cols[name])
            for f in families:
                model = fit(f, matrix.filter("split = 'train'"), h, learner, **overrides.get(f, {}))
                s = model.transform(matrix).select(F.lit(name).alias("feature_set"), F.lit(NAMES.get(f, f)).alias("model"), F.lit(h).alias("horizon"), "split", "y", "p")
                out = s if out is None else out.unionByName(s)
    return aggregates.regression_metrics(out, ["feature_set", "model", "horizon", "split"]).select(
        "feature_set", "model", "horizon", "split", "r2", "mae", "mse", "rmse")


def search_ridge(frame: DataFrame, horizons: Iterable[int] = recipes.HORIZONS, names: Iterable[str] = tuple(recipes.RECIPES),
                 alphas: Iterable[float] = SEARCH_ALPHAS, table: Mapping[str, Sequence[str]] = recipes.RECIPES) -> DataFrame:
    """Validation r2 of every penalty and recipe: (horizon, recipe, alpha, trial, val_r2).

    Every recipe keeps the rows that are complete in its own features. One pass a horizon for the recipes that keep the same rows: the cross
    products of their features answer every recipe and penalty.
    """
    cols, rows = {name: clean.select_features(table[name], frame.columns, []) for name in names}, []
    for h, group in itertools.product(horizons, same_rows(frame, cols)):
        every = list(dict.fromkeys(c for name in group for c in cols[name]))
        raw = frames.design_matrix(frame, every, h, scale=False)
        g = moments(apply_scaling(raw, scaling_of(raw.filter("split = 'train'"), every)), every)
        for name in group:
            at = [every.index(c) for c in cols[name]]
            for i, a in enumerate(sorted({*alphas, RIDGE_ALPHA[h]})):
                r2 = r2_from_moments(g["val"], at, *ridge_from_moments(g["train"], at, a)) if {"train", "val"} <= g.keys() else None
                rows.append((int(h), name, float(a), i, r2))
    return frame.sparkSession.createDataFrame(rows, "horizon int, recipe string, alpha double, trial int, val_r2 double")


def tune_ridge(frame: DataFrame, stored: DataFrame | None = None, horizons: Iterable[int] = recipes.HORIZONS, names: Iterable[str] = tuple(recipes.RECIPES),
               alphas: Iterable[float] = SEARCH_ALPHAS, table: Mapping[str, Sequence[str]] = recipes.RECIPES) -> tuple[Bundle, DataFrame]:
    """Best recipe and penalty per horizon, refitted: (bundle, metrics merged over ``stored`` ones by horizon and model)."""
    best = aggregates.best_trial(search_ridge(frame, horizons, names, alphas, table), ["horizon"]).collect()  # one row a horizon
    out, scored = Bundle("tuned:lr"), None
    for r in sorted(best, key=lambda r: r["horizon"]):
        bundles, s = train(frame, ["lr"], [r["horizon"]], table[r["recipe"]], overrides={"lr": {"alpha": r["alpha"]}})
        out.add(bundles["lr"], r["horizon"])
        scored = s if scored is None else scored.unionByName(s)
    metrics = evaluate(scored)
    return out, metrics if stored is None else aggregates.merge_metrics(stored, metrics)


def tree_trials(horizon: int, learner: str = "boosted", n: int | None = None, seed: int = 42) -> list[dict]:
    """Settings to try: the horizon's own first, then a seeded draw from the grid around it."""
    if learner == "boosted":
        base, n = BOOSTED[horizon], n or BOOSTED_TRIALS
        space = {k: sorted({*v, base[k]}) for k, v in SEARCH_BOOSTED.items()}
    elif learner == "penalized":
        base, n = PENALIZED[horizon] | {"l1": 0.0}, n or BOOSTED_TRIALS
        space = {k: sorted({*v, base[k]}) for k, v in (SEARCH_BOOSTED | SEARCH_PENALTIES).items()}
    else:
        base, n = FOREST[horizon], n or FOREST_TRIALS
        near = lambda v, low, *steps: sorted({max(low, v + s) for s in steps})
        space = {"depth": near(base["depth"], 2, -2, 0, 2, 4), "trees": near(base["trees"], 10, -20, 0, 20, 40),
                 "leaf": near(base["leaf"], 1, -2, 0, 2, 4)}
    grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    random.Random(seed).shuffle(grid)
    return [base, *[g for g in grid if g != base]][:n]


def search_trees(frame: DataFrame, horizon: int, name: str, learner: str = "boosted", trials: Sequence[dict] | None = None,
                 seed: int = 42, table: Mapping[str, Sequence[str]] = recipes.RECIPES) -> DataFrame:
    """Validation r2 per tree setting: (horizon, recipe, setting, trial, val_r2).

    Penalized trees of all settings grow in the same jobs; the other learners fit one setting after the other.
    """
    cols = clean.select_features(table[name], frame.columns, [])
    matrix, _ = design(frame, cols, horizon)
    train_rows, val = matrix.filter("split = 'train'"), matrix.filter("split = 'val'")
    trials = trials or tree_trials(horizon, learner, seed=seed)
    if learner == "penalized":
        fitted = iter(boosting.fit_many(train_rows, [boosting.Setting(**({"columns": 0.7} | t)) for t in trials], seed))
    elif learner == "boosted":
        fitted = (fit_boosted(train_rows, seed=seed, share=0.7, **t) for t in trials)
    else:
        fitted = (fit_forest(train_rows, seed=seed, **t) for t in trials)
    out = None
    for i, (t, model) in enumerate(zip(trials, fitted)):
        s = model.transform(val).select(F.lit(json.dumps(t)).alias("setting"), F.lit(i).alias("trial"), "y", "p")
        out = s if out is None else out.unionByName(s)
    m = aggregates.regression_metrics(out, ["setting", "trial"])
    return m.select(F.lit(horizon).alias("horizon"), F.lit(name).alias("recipe"), "setting", "trial", F.col("r2").alias("val_r2"))


def forecast(records: DataFrame, bundle: Bundle, include_current: bool = True) -> DataFrame:
    """Feature records (station_id, timestamp, features, history) to prediction records.

    A projection and the models' own transform per horizon: no shuffle, so it runs on a stream too.
    Missing features are 0, negative forecasts become 0, the primary forecast is that of +1 h or else
    of the first horizon.
    """
    out = records
    for h in bundle.horizons:
        cols = bundle.features[h]
        made = frames.serving_columns(cols, F.col("timestamp"), include_current=include_current)
        names = [f"_f{i}" for i in range(len(cols))]
        center = bundle.scaling.get(h, {})
        scaled = {n: (made[c] - F.lit(center.get(c, (0.0, 1.0))[0])) / F.lit(center.get(c, (0.0, 1.0))[1]) for n, c in zip(names, cols)}
        out = bundle.models[h].transform(assemble(out.withColumns(scaled), names)).withColumn(
            f"_p{h}", scalar.exp_clip(F.col("p")) if bundle.log_target.get(h) else F.greatest(F.col("p"), F.lit(0.0))).drop("x", "p", *names)
    pairs = F.array(*[F.struct(F.lit(f"h{h}").alias("key"), F.col(f"_p{h}").alias("value")) for h in bundle.horizons])
    primary = 1 if 1 in bundle.models else bundle.horizons[0]
    return out.select(
        "station_id", "timestamp", F.map_from_entries(pairs).alias("forecasts"), F.col(f"_p{primary}").alias("forecast_pm25"),
        F.try_element_at("features", F.lit("pm25")).alias("current_pm25"), F.lit(bundle.model_type).alias("model_type"))


def forecast_and_alert(records: DataFrame, bundle: Bundle, include_current: bool = True) -> DataFrame:
    """Forecasts and alert level of each record in one pass."""
    p = forecast(records, bundle, include_current)
    return alerts.evaluate(p, current=("current_pm25",)).select(
        *p.columns, "level", "alert", "recommendation")


def registry_table(spark: SparkSession, active: Mapping[int, str]) -> DataFrame:
    """(horizon, model): which family answers for which horizon."""
    return spark.createDataFrame([(int(h), m) for h, m in sorted(active.items())], "horizon int, model string")


def write_registry(registry: DataFrame, path: str, version: int) -> None:
    """Store a registry as a new version; readers keep the one before until it is complete."""
    sinks.write_state(registry, path, "models", version)


def read_registry(spark: SparkSession, path: str, fallback: Mapping[int, str]) -> DataFrame:
    """The stored registry; horizons it does not name answer with ``fallback``."""
    stored = sinks.read_state(spark, path, "models", T.StructType.fromDDL("horizon int, model string"))
    default = registry_table(spark, fallback).withColumnRenamed("model", "_default")
    return stored.join(default, "horizon", "full_outer").select("horizon", F.coalesce("model", "_default").alias("model"))


def set_active(registry: DataFrame, model: str, horizons: Iterable[int] | None = None,
               known: Iterable[str] = tuple(recipes.FAMILIES)) -> DataFrame:
    """Registry with ``model`` active for the given horizons, or for all."""
    if model not in known:
        raise ValueError(f"Unknown model key: {model}")
    hit = F.lit(True) if horizons is None else F.col("horizon").isin(list(horizons))
    return registry.withColumn("model", F.when(hit, F.lit(model)).otherwise(F.col("model")))


def select_active(predictions: DataFrame, registry: DataFrame) -> DataFrame:
    """Predictions (long form) of the active family of each horizon."""
    return predictions.join(registry, ["horizon", "model"])
