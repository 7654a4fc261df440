"""Forecasts per series: trend with seasons, trend with changes, and a short autoregression; backtests of all beside the naive one.

A series is a few hundred points of one area, so one (area, cut) is a task's unit of work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import series as se

LOOKBACK, SEASON_DAYS, INTERVAL = 4, 730, (0.1, 0.9)
#: Points of a stretch between two changes, at least; what a change costs, in noise variances times ln n.
STRETCH, CHANGE = 6, 3.0
#: Earlier ends from which a series is forecast again for its interval, and the normal 90 % quantile.
AGAIN, NINETY = 12, 1.2816


def design(days: np.ndarray, seasons: bool) -> np.ndarray:
    columns = [np.ones(len(days)), days / 365.25]
    if seasons:
        for k in (1, 2):
            columns += [np.sin(2 * np.pi * k * days / 365.25), np.cos(2 * np.pi * k * days / 365.25)]
    return np.stack(columns, axis=1)


def trend_seasons(days: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Forecast at the days ahead, and what to add for the interval's ends; yearly terms only over two years."""
    seasons = days[-1] - days[0] >= SEASON_DAYS
    x = design(days, seasons)
    ridge = 1e-3 * np.eye(x.shape[1])
    ridge[0, 0] = 0
    w = np.linalg.solve(x.T @ x + ridge, x.T @ y)
    low, high = np.quantile(y - x @ w, INTERVAL)
    return design(ahead, seasons) @ w, float(low), float(high)


def changes(days: np.ndarray, y: np.ndarray) -> list[int]:
    """Where the series' line changes: the cuts with the least sum of squared residuals of a line in each stretch, plus CHANGE for each."""
    n, t = len(y), (days - days[0]) / max(days[-1] - days[0], 1e-12)
    y = y - y.mean()
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (np.ones(n), t, y, t * t, t * y, y * y)]
    noise = np.median(np.abs(np.diff(y, 2))) / 0.6745 / np.sqrt(6) if n > 2 else 0.0  # of second differences, which a line does not move
    cost = CHANGE * max(noise, 1e-9) ** 2 * np.log(max(n, 2))
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -cost
    for j in range(1, n + 1):
        i = np.arange(0, max(1, j - STRETCH + 1))
        one, st, sy, stt, sty, syy = (v[j] - v[i] for v in sums)
        tt, ty, yy = stt - st * st / one, sty - st * sy / one, syy - sy * sy / one
        rest = yy - np.where(tt > 1e-12, ty * ty / np.maximum(tt, 1e-12), 0)
        total = best[i] + np.maximum(rest, 0) + cost
        k = int(total.argmin())
        best[j], came[j] = total[k], i[k]
    cuts, at = [], n
    while (at := int(came[at])) > 0:
        cuts.append(at)
    return cuts[::-1]


def trend_changes(days: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """The line of the last stretch carried on, with the yearly terms of the whole series if it is over two years long."""
    season, season_ahead = np.zeros(len(y)), np.zeros(len(ahead))
    if days[-1] - days[0] >= SEASON_DAYS:
        x = design(days, True)
        steps = [np.maximum(days - days[c], 0) / 365.25 for c in changes(days, y)] + [(days >= days[c]).astype(float) for c in changes(days, y)]
        full = np.stack([*x.T, *steps], axis=1)
        w = np.linalg.solve(full.T @ full + 1e-3 * np.eye(full.shape[1]), full.T @ (y - y.mean()))[2 : x.shape[1]]
        season, season_ahead = x[:, 2:] @ w, design(ahead, True)[:, 2:] @ w
    plain = y - season
    last = ([0, *changes(days, plain)])[-1]
    t, v = days[last:], plain[last:]
    middle = t.mean()
    slope = ((t - middle) @ (v - v.mean())) / max((t - middle) @ (t - middle), 1e-12)
    return v.mean() + slope * (ahead - middle) + season_ahead


def widening(days: np.ndarray, y: np.ndarray, h: int) -> np.ndarray:
    """Half the width of the 80 % interval at each step: from the errors of the same forecast at earlier ends, never less than at the step before."""
    ends = np.unique(np.linspace(max(2 * STRETCH, len(y) // 2), len(y) - h, AGAIN).astype(int)) if len(y) >= 2 * STRETCH + h else []
    errors = np.array([y[c : c + h] - trend_changes(days[:c], y[:c], days[c : c + h]) for c in ends]).reshape(-1, h)
    if not len(errors):
        return np.full(h, NINETY * y.std())
    return NINETY * np.maximum.accumulate(np.sqrt((errors**2).mean(axis=0)))


def autoregression(y: np.ndarray, h: int) -> np.ndarray:
    """Recursive steps of a ridge over the last values, scaled by the training range; short series repeat the last value."""
    if len(y) < 3 * LOOKBACK:
        return np.repeat(y[-1], h)
    low, span = y.min(), max(np.ptp(y), 1e-12)
    z = (y - low) / span
    x = np.stack([np.append(z[i : i + LOOKBACK], 1) for i in range(len(z) - LOOKBACK)])
    w = np.linalg.solve(x.T @ x + 0.1 * np.eye(LOOKBACK + 1), x.T @ z[LOOKBACK:])
    for _ in range(h):
        z = np.append(z, np.append(z[-LOOKBACK:], 1) @ w)
    return z[-h:] * span + low


def predict(model: str, days: np.ndarray, y: np.ndarray, ahead: np.ndarray, interval: bool = True) -> tuple[np.ndarray, float | np.ndarray, float | np.ndarray]:
    """The forecast, and what to add for its interval's ends, for all steps or each."""
    if model == "changes":
        width = widening(days, y, len(ahead)) if interval else 0.0
        return trend_changes(days, y, ahead), -width, width
    if model == "naive":
        return np.repeat(y[-1], len(ahead)), 0.0, 0.0
    if model == "trend":
        return trend_seasons(days, y, ahead)
    return autoregression(y, len(ahead)), 0.0, 0.0


MODELS = ("naive", "trend", "changes", "autoregression")


def days_of(ds: pd.Series) -> np.ndarray:
    return (pd.to_datetime(ds) - pd.Timestamp("2000-01-01")).dt.days.to_numpy(float)


def backtest(series: DataFrame, models: tuple[str, ...] = MODELS, h: int = 3, max_folds: int = 24) -> DataFrame:
    """area_code, model, cut, step, y, yhat: every fold of every model.

    A fold's rows are those up to its last test point, dealt to a task by (area, cut).
    """
    points, folds = se.numbered(series).select("area_code", "i", "ds", "price_m2"), se.cuts(series, h, max_folds)
    rows = points.join(folds, "area_code").where(F.col("i") <= F.col("cut") + h)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        area, cut = key
        pdf = pdf.sort_values("i")
        days, y = days_of(pdf["ds"]), pdf["price_m2"].to_numpy(float)
        out = []
        for m in models:
            yhat, _, _ = predict(m, days[:cut], y[:cut], days[cut:], interval=False)
            out += [(area, m, cut, s + 1, float(y[cut + s]), float(v)) for s, v in enumerate(yhat)]
        return pd.DataFrame(out, columns=["area_code", "model", "cut", "step", "y", "yhat"])

    return rows.groupBy("area_code", "cut").applyInPandas(run, "area_code string, model string, cut int, step int, y double, yhat double")


def forecast(series: DataFrame, models: tuple[str, ...] = MODELS, h: int = 3) -> DataFrame:
    """area_code, model, ds, yhat, low, high of the h periods after each series' end, refitted on all of it."""
    ahead = se.future_dates(series, h).select("area_code", "ds", F.lit(None).cast("double").alias("price_m2"))
    rows = series.select("area_code", "ds", "price_m2").unionByName(ahead)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        new = pdf["price_m2"].isna().to_numpy()
        days, y = days_of(pdf["ds"]), pdf["price_m2"].to_numpy(float)[~new]
        out = []
        for m in models if len(y) else ():
            yhat, low, high = predict(m, days[~new], y, days[new])
            low, high = np.broadcast_to(low, yhat.shape), np.broadcast_to(high, yhat.shape)
            out += [(pdf["area_code"].iloc[0], m, d, float(v), float(v + a), float(v + b)) for d, v, a, b in zip(pdf["ds"][new], yhat, low, high, strict=True)]
        return pd.DataFrame(out, columns=["area_code", "model", "ds", "yhat", "low", "high"])

    return rows.groupBy("area_code").applyInPandas(run, "area_code string, model string, ds date, yhat double, low double, high double")


def verdicts(tests: DataFrame) -> DataFrame:
    """area_code, model, mape_mean, beats_naive of each area's best model, from backtest()."""
    folds = se.errors(tests, ("area_code", "model", "cut"))
    return se.winners(se.backtest_summary(folds, ("area_code", "model")))


def wins(tests: DataFrame) -> DataFrame:
    best = verdicts(tests).groupBy("model").agg(F.count("*").alias("wins"))
    return best.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))  # one row per model
