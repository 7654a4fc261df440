"""A trend with changes: cuts against all cuts, one break over 24 folds, and how often the interval holds."""

from datetime import date

import numpy as np

from marlstone.operators import forecast as fc


def months(n):
    return [date(2012 + i // 12, i % 12 + 1, 1) for i in range(n)]


def days(n):
    return np.array([(d - date(2000, 1, 1)).days for d in months(n)], float)


def broken(n, at, seed, noise=1.0):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    return 100 + 0.5 * i + np.where(i > at, -2.5 * (i - at), 0) + rng.normal(0, noise, n)


def test_cuts_equal_the_best_of_all():
    rng = np.random.default_rng(3)
    for seed in range(6):
        n = 22
        y = broken(n, 11, seed, 0.4) + (rng.normal(0, 3) if seed % 2 else 0) * (np.arange(n) > 15)
        t = days(n)
        noise = np.median(np.abs(np.diff(y, 2))) / 0.6745 / np.sqrt(6)
        cost = fc.CHANGE * noise**2 * np.log(n)

        def rest(a, b):
            x = np.stack([np.ones(b - a), (t[a:b] - t[0]) / 1000], axis=1)
            return float(((y[a:b] - x @ np.linalg.lstsq(x, y[a:b], rcond=None)[0]) ** 2).sum())

        options = [[]] + [[a] for a in range(fc.STRETCH, n - fc.STRETCH + 1)] + [[a, b] for a in range(fc.STRETCH, n) for b in range(a + fc.STRETCH, n - fc.STRETCH + 1)]
        total = lambda cuts: sum(rest(a, b) for a, b in zip([0, *cuts], [*cuts, n], strict=True)) + cost * len(cuts)
        found = fc.changes(t, y)
        assert total(found) <= min(map(total, options)) + 1e-6, (found, min(options, key=total))


def test_one_break_is_followed(spark):
    n = 72
    y = broken(n, 30, 1)
    series = spark.createDataFrame([("a", d, float(v)) for d, v in zip(months(n), y, strict=True)], "area_code string, ds date, price_m2 double")
    tests = fc.backtest(series, h=3).toPandas()
    assert tests.groupby("model")["cut"].nunique().eq(24).all()
    mape = (tests.assign(e=(tests["yhat"] / tests["y"] - 1).abs()).groupby("model")["e"].mean()).to_dict()
    assert mape["changes"] < mape["trend"] and mape["changes"] < mape["naive"]
    ahead = fc.forecast(series).where("model = 'changes'").orderBy("ds").collect()
    width = [r.high - r.low for r in ahead]
    assert width == sorted(width) and all(r.low < r.yhat < r.high for r in ahead)


def test_the_interval_holds_four_of_five():
    held = total = 0
    for seed in range(120):
        n, h = 60, 3
        t, y = days(n + h), broken(n + h, 20, seed)
        yhat, low, high = fc.predict("changes", t[:n], y[:n], t[n:])
        held += int(((y[n:] >= yhat + low) & (y[n:] <= yhat + high)).sum())
        total += h
    assert 0.7 <= held / total <= 0.9


def test_short_and_flat_series():
    for y in ([5.0], [5.0, 5.0], [1.0, 2.0, 3.0], [4.0] * 40):
        yhat, low, high = fc.predict("changes", days(len(y)), np.array(y), days(len(y) + 3)[-3:])
        assert np.isfinite(yhat).all() and np.isfinite(low).all() and (np.array(high) >= 0).all()
    assert np.allclose(fc.predict("changes", days(40), np.full(40, 4.0), days(43)[-3:])[0], 4.0)
