"""Least squares on rows that stand for others: what it finds is what it finds on all rows."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from marlstone.fixtures import latest, listed, silver
from marlstone.operators import features as fe
from marlstone.operators import gold, learning
from marlstone.plans import learning_queries
from marlstone.session import settle


@pytest.fixture(scope="module")
def rows(spark):
    """Few values of a and b, some missing; y differs among most rows with the same, and the group of a = 7 has one row."""
    rng = np.random.default_rng(3)
    made = [(float(a) if a else None, float(b) if b != 2 else None, float(2 * a - b + rng.normal())) for a, b in rng.integers(0, 4, (600, 2))]
    made += [(7.0, 1.0, 9.0), (3.0, 8.0, 4.0), (3.0, 8.0, 4.0), (1.0, 1.0, None)]
    return spark.createDataFrame(made, "a double, b double, y double")


def test_alike_keeps_number_mean_and_deviation(rows):
    few = learning.alike(rows, ["a", "b"])
    assert few.count() <= 2 * rows.select("a", "b").distinct().count() and few.where("weight < 1").isEmpty()
    w, y = F.col("weight"), F.col("y")
    kept = {(r.a, r.b): (r.n, r.m, r.q) for r in few.groupBy("a", "b").agg(F.sum(w).alias("n"), F.sum(w * y).alias("m"), F.sum(w * y * y).alias("q")).collect()}
    all_rows = {(r.a, r.b): (r.n, r.m, r.q) for r in rows.where("y is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("y").alias("m"), F.sum(y * y).alias("q")).collect()}
    assert kept.keys() == all_rows.keys()
    for k, v in kept.items():
        assert v == pytest.approx(all_rows[k], rel=1e-9, abs=1e-9)
    assert few.where("a = 7 or b = 8").count() == 2  # rows of one y stay one row


def test_fit_of_alike_rows_is_the_fit_of_all(rows):
    whole = rows.where("y is not null")
    few = learning.alike(rows, ["a", "b"])
    a, b = (learning.fit(df, LinearRegression(regParam=1e-2), ["a", "b"], w) for df, w in ((whole, None), (few, "weight")))
    assert b.model.stages[-1].coefficients.toArray() == pytest.approx(a.model.stages[-1].coefficients.toArray(), rel=1e-8)
    assert b.model.stages[-1].intercept == pytest.approx(a.model.stages[-1].intercept, rel=1e-8)
    told = learning.medians(few, ["a", "b"], "weight").first()
    for name in ("a", "b"):
        values = sorted(r[0] for r in whole.select(name).collect() if r[0] is not None)
        assert told[name] == values[-(-len(values) // 2) - 1] == b.model.stages[0].surrogateDF.first()[name]
    with pytest.raises(ValueError):
        learning.fit(few, GBTRegressor(), ["a", "b"], "weight")


def test_area_price_of_counted_rows(spark, sf_dir):
    listings = silver(spark, sf_dir)
    counted = listings.groupBy("province_code", "district_code", "district", "price_per_m2").agg(F.count("*").alias("times"))
    got = gold.area_price(counted, 5, ["district"], ["median_price_m2"], "times").collect()
    want = gold.area_price(listings, 5, ["district"], ["median_price_m2"]).collect()
    assert len(got) == len(want) > 0
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:6] == w[:6] and g.mean_price_m2 == pytest.approx(w.mean_price_m2, abs=2e-6)


def test_score_prices_learns_from_alike_rows_what_it_learns_from_all(spark, sf_dir, monkeypatch):
    items, read = latest(spark, sf_dir), []
    for k in (1, 2, 3):  # other listings with the same values
        items = items.unionByName(latest(spark, sf_dir).withColumn("l_orderkey", F.col("l_orderkey") + 10_000_000 * k))
    monkeypatch.setattr(learning_queries, "latest", lambda *_: items)
    monkeypatch.setattr(learning, "fit", lambda df, *a, _f=learning.fit, **k: read.append(df) or _f(df, *a, **k))
    got = {r.listing_id: r for r in learning_queries.prices(spark, sf_dir).collect()}
    train, test = learning.split(settle(listed(items)))
    n, few = train.count(), read[0]
    assert few.agg(F.sum("weight")).first()[0] == n and few.count() < n
    encoded = learning.encode(train, test)
    fitted = learning.fit(encoded.train.select("y", *fe.FEATURES), LinearRegression(regParam=1e-3))
    want = learning.check_listings(learning.score_prices(test, fitted, encoded, gold.area_price(train, levels=["district"]))).collect()
    assert got.keys() == {r.listing_id for r in want} and len(got) == len(want)
    for w in want:
        g = got[w.listing_id]
        assert (g.price, g.note, g.flagged, g.severity) == (w.price, w.note, w.flagged, w.severity)
        assert (g.predicted, g.low, g.high, g.gap, g.vs_district_pct or 0) == pytest.approx((w.predicted, w.low, w.high, w.gap, w.vs_district_pct or 0), rel=1e-6, abs=1e-6)
