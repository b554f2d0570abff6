"""Feature lists of the forecasting models."""

from __future__ import annotations

# Model feature names and the lists built from them.
BASE = ("temp definition °c", "dew point definition °c", "rel hum definition %", "wind_u", "wind_v", "pm25")
DIFFUSION = ("upwind_pm25", "transport_potential", "wind_alignment")
GASES = ("no", "no2", "nox", "o3")
TIME = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")
LAGS = ("pm25_lag1", "pm25_lag2", "pm25_lag3", "pm25_lag6", "pm25_lag12", "pm25_roll3_mean", "pm25_roll6_mean")
RECIPES = {
    "base6": BASE,
    "diffusion9": BASE + DIFFUSION,
    "base+upwind": BASE + ("upwind_pm25",),
    "base+transport": BASE + ("transport_potential",),
    "base+alignment": BASE + ("wind_alignment",),
    "base+pollutants": BASE + GASES,
    "with_pollutants": BASE + DIFFUSION + GASES,
    "with_lags_pollutants": BASE + DIFFUSION + GASES + TIME + LAGS,
}
FAMILIES = {
    "ha": ("ha", "historical_average"),
    "lr": ("lr", "linear_regression"),
    "rf": ("rf", "gradient_boosting_rf", "tree_regressor", "gradient boosting/rf"),
    "lstm": ("lstm", "lstm sequential"),
    "stgnn": ("stgnn", "spatiotemporal graph", "graph_stgnn"),
}
LINEAR_LAGS = {
    1: ("pm25_lag1", "pm25_lag2", "pm25_roll3_mean"),
    2: ("pm25_lag2", "pm25_lag3", "pm25_roll3_mean"),
    3: ("pm25_lag3", "pm25_lag6", "pm25_roll6_mean"),
}
HORIZONS = (1, 2, 3)
ALL_FEATURES = BASE + DIFFUSION + GASES + TIME + LAGS


def family(model: str) -> str:
    """Family key of a model name."""
    for key, names in FAMILIES.items():
        if model.lower() in names:
            return key
    raise ValueError(f"Unsupported model name: {model}")


def features_for(model: str, horizon: int) -> list[str]:
    """Default features of a model at a horizon: a mean needs one, linear models the lags that are
    still informative that far ahead, the others everything."""
    key = family(model)
    if key == "ha":
        return ["pm25"]
    if key == "lr":
        near = () if horizon == 1 else DIFFUSION
        return [*BASE, *GASES, *TIME, *near, *LINEAR_LAGS[min(max(horizon, 1), 3)]]
    return [*BASE, *GASES, *TIME, *DIFFUSION, *LAGS]


def parse_map(text: str) -> dict[int, str]:
    """``"1=base6,2=diffusion9"`` to recipe names per horizon; an unknown name fails."""
    out = {}
    for part in text.split(","):
        horizon, _, name = part.strip().partition("=")
        if name.strip() not in RECIPES:
            raise ValueError(f"unknown recipe: {name.strip()}")
        out[int(horizon)] = name.strip()
    return out
