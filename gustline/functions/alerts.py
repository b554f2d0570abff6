"""Alert classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalar import truthy_or

# Thresholds in µg/m³ and the advice texts.
WARNING = 35.5
CRITICAL = 125.5
RISING_BY = 10
ADVICE = {
    "critical": "Activate emergency ventilation and restrict outdoor industrial activity immediately.",
    "warning": "Increase monitoring frequency and prepare proactive emission controls before the forecast peak.",
    "rising": "Trend rising — schedule preventive checks within the next hour.",
    "normal": "Conditions normal — continue standard monitoring.",
}


def level(current: Column, forecast: Column, warning: float = WARNING) -> Column:
    worst = F.greatest(current, forecast)
    return F.when(worst >= CRITICAL, "critical").when(worst >= warning, "warning").otherwise("normal")


def advice(lvl: Column, current: Column, forecast: Column) -> Column:
    return (
        F.when(lvl == "critical", ADVICE["critical"])
        .when(lvl == "warning", ADVICE["warning"])
        .when(forecast > current + RISING_BY, ADVICE["rising"])
        .otherwise(ADVICE["normal"])
    )


def evaluate(df: DataFrame, current=("pm25", "pm2", "current_pm25"), forecast: str | None = "forecast_pm25",
             warning: float = WARNING) -> DataFrame:
    """Append the resolved values, level, flag and advice.

    The first usable of ``current`` counts, where 0 is as good as missing; a forecast of 0 or null
    falls back to the current value. NaN counts as missing: as a number it would be above every threshold.
    """
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    present = [known(c) for c in current if c in df.columns]
    now = truthy_or(*present) if present else F.lit(0.0)
    ahead = now
    if forecast and forecast in df.columns:
        ahead = F.coalesce(F.nullif(known(forecast), F.lit(0.0)), now)
    lvl = level(F.col("_now"), F.col("_ahead"), warning)
    return (
        df.withColumns({"_now": now, "_ahead": ahead})
        .withColumn("level", lvl)
        .withColumns({
            "alert": F.greatest("_now", "_ahead") >= warning,
            "current_resolved": F.col("_now"),
            "forecast_resolved": F.col("_ahead"),
            "recommendation": advice(F.col("level"), F.col("_now"), F.col("_ahead")),
        })
        .drop("_now", "_ahead")
    )


def alert_records(predictions: DataFrame) -> DataFrame:
    """Predictions to alerts. ``current_pm25`` stays as it came in, the forecast is the resolved one."""
    return evaluate(predictions, current=("current_pm25",)).select(
        "station_id", "timestamp", "level", "alert", "current_pm25",
        F.col("forecast_resolved").alias("forecast_pm25"), "recommendation",
    )
