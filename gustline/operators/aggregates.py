"""Grouped summaries: means, pivots, evaluation metrics, latency, tuning results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar
from . import ranking, series


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def widen(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide for a fixed list of names, so no pass over the data is spent to find them."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value))


def resample_hourly(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], hour: str = "hour") -> DataFrame:
    """Hourly means on a gapless spine; hours without rows hold nulls."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias(hour)).agg(*[F.avg(c).alias(c) for c in cols])
    return series.hourly_spine(hourly, keys, hour)


def regression_metrics(df: DataFrame, by: Sequence[str], truth: str = "y", predicted: str = "p") -> DataFrame:
    """r2, mae, mse, rmse per group over pairs that are both finite; zeros for an empty group.

    One aggregation of mergeable moments. A constant truth gives r2 = 1 if met exactly, else 0.
    """
    y, p = F.col(truth), F.col(predicted)
    ok = scalar.is_finite(y) & scalar.is_finite(p)
    yy, err = F.when(ok, y), F.when(ok, y - p)
    sums = df.groupBy(*by).agg(
        F.count(err).alias("_n"), F.sum(err * err).alias("_sse"), F.avg(F.abs(err)).alias("_mae"),
        (F.var_pop(yy) * F.count(yy)).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.try_divide(F.col("_sse"), F.col("_sst"))).otherwise(
        F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
    mse = F.try_divide(F.col("_sse"), F.col("_n"))
    some = lambda c: F.when(F.col("_n") > 0, c).otherwise(0.0)
    return sums.select(*by, some(r2).alias("r2"), some(F.col("_mae")).alias("mae"), some(mse).alias("mse"),
                       some(F.sqrt(mse)).alias("rmse"))


def latency_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, median, p95 (linear interpolation), min, max."""
    q = ranking.exact_percentiles(df, by, [value], [0.5, 0.95])
    plain = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = q.select(*by, F.col(f"{value}__q")[0].alias("median"), F.col(f"{value}__q")[1].alias("p95"))
    if by:
        return plain.join(q, list(by))
    return plain.withColumn("_q", q.select(F.struct("*")).scalar()).select("mean", "min", "max", "_q.*")


def robust_scale_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: struct(center, scale) per column, from exact quartiles; a zero range scales by 1."""
    q = ranking.exact_percentiles(df, [], cols, [0.25, 0.5, 0.75])
    quartiles = lambda c: f"`{c}__q`[0], `{c}__q`[1], `{c}__q`[2]"
    return q.select(*[F.expr(f"""transform(array(struct({quartiles(c)})), q -> named_struct(
        'center', coalesce(q.col2, 0D), 'scale', coalesce(nullif(q.col3 - q.col1, 0D), 1D)))[0]""").alias(c) for c in cols])


def robust_scale(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(x − median) / IQR with both taken from the rows where ``fit_on`` holds."""
    params = robust_scale_params(df if fit_on is None else df.filter(fit_on), cols)
    out = df.withColumn("_s", params.select(F.struct("*")).scalar())
    return out.withColumns({
        c: F.expr(f"(`{c}` - _s.`{c}`.center) / _s.`{c}`.scale") for c in cols}).drop("_s")


def best_trial(trials: DataFrame, by: Sequence[str], score: str = "val_r2", trial: str = "trial") -> DataFrame:
    """The setting with the best score; the earlier trial wins a tie."""
    rest = [c for c in trials.columns if c not in by]
    return trials.groupBy(*by).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(trial))).alias("_b")).select(*by, "_b.*")


def leaderboard(metrics: DataFrame, top: int | None = None) -> DataFrame:
    """Horizon ascending, r2 descending; ``top`` models per horizon if given."""
    ordered = [F.col("r2").desc(), F.col("model")]
    out = metrics if top is None else ranking.top_per_group(metrics, ["horizon"], ordered, top)
    return out.orderBy("horizon", *ordered)


def merge_metrics(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("horizon", "model")) -> DataFrame:
    """New rows replace existing ones of the same key."""
    return existing.join(new, list(keys), "left_anti").unionByName(new)
