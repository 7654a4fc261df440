"""Train, choose, store, load in a session of its own, score, check, and feed the anomaly job."""

import random
from datetime import datetime

import pytest

from marlstone.operators import gold, learning
from marlstone.operators.boosting import HistogramBoosting
from marlstone.plans import jobs
from marlstone.plans import price_models as pm

NOW = datetime(2025, 3, 1)
SILVER = "listing_id string, province_code string, province string, district_code string, district string, ward_code string, ward string, area double, price double, price_per_m2 double, floors double, bedrooms double, access_road double, legal_status string"


def listings(spark, n=1500, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        d, area, floors = r.randrange(8), r.uniform(30, 150), r.choice([None, 1.0, 2.0, 3.0])
        road = None if r.random() < 0.3 else r.uniform(2, 12)
        unit = (40 + 25 * d) * (1 + 0.08 * (floors or 0)) * (1.2 if (road or 0) > 6 else 1.0) * r.lognormvariate(0, 0.08)
        if i == 7:
            unit *= 6
        rows.append((f"l{i}", "79", "P", f"{d:03d}", f"D{d}", f"{d:05d}", f"W{d}", area, unit * area / 1000, unit, floors, floors, road, r.choice(["Sổ đỏ", "Hợp đồng mua bán", None])))
    return spark.createDataFrame(rows, SILVER)


def test_from_training_to_anomalies(spark, tmp_path):
    path, rows = str(tmp_path), listings(spark)
    makers = {"linear": learning.BASELINES["linear"], "histogram": lambda: HistogramBoosting(trees=12)}
    told = pm.run_price_training(spark, rows, f"{path}/models", NOW, makers, folds=2)
    assert told["version"] == 1 and told["chosen"] == min(told["candidates"], key=lambda k: told["candidates"][k]["mape"])
    assert told["mape"] < 20
    jobs.write_serving(gold.area_price(rows, 5), path, "area_price")
    other = spark.newSession()
    model = pm.load_price_model(other, f"{path}/models")
    scored = model.score(other.createDataFrame(rows.collect(), SILVER), other.read.parquet(f"{path}/area_price"))
    mape = scored.selectExpr("percentile(abs(predicted / price - 1), 0.5) * 100").first()[0]
    assert mape < 15 and scored.where("low > predicted or high < predicted or note is not null").count() == 0
    checked = {r.listing_id: r for r in learning.check_listings(scored).collect()}
    assert checked["l7"].flagged and checked["l7"].severity == "cao" and sum(r.flagged for r in checked.values()) < 30
    found = jobs.run_anomalies(scored, path, ["area", "floors"], contamination=1 / 1500)
    assert found == {"rows_in": 1500, "rows_out": 1} and spark.read.parquet(f"{path}/anomaly").first().listing_id == "l7"


def test_versions_and_stacks(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/models", listings(spark, 400, 2)
    makers = {"linear": learning.BASELINES["linear"], "histogram": lambda: HistogramBoosting(trees=3, levels=2)}
    with pytest.raises(LookupError):
        pm.load_price_model(spark, path)
    first = pm.run_price_training(spark, rows, path, NOW, {"linear": makers["linear"]}, folds=2)
    monkeypatch.setattr(learning, "choose", lambda results: "stack" if "stack" in results else "linear")
    with monkeypatch.context() as m:  # a run that breaks off before its row is written leaves no version
        m.setattr(pm, "price_metrics", lambda df: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            pm.run_price_training(spark, rows, path, NOW, makers, folds=2)
    second = pm.run_price_training(spark, rows, path, NOW, makers, folds=2, stack=True)
    assert (first["version"], second["version"], second["chosen"]) == (1, 2, "stack")
    assert [(r.version, r.chosen) for r in pm.versions(spark, path).orderBy("version").collect()] == [(1, "linear"), (2, "stack")]
    areas = gold.area_price(rows, 5)
    newest, oldest = pm.load_price_model(spark, path), pm.load_price_model(spark, path, 1)
    assert (newest.version, oldest.version) == (2, 1)
    a, b = (m.score(rows, areas).orderBy("listing_id").select("predicted").collect() for m in (newest, oldest))
    assert len(a) == len(b) == 400 and a != b and all(r.predicted > 0 for r in a)
    unknown = rows.limit(1).withColumn("district_code", rows.ward_code)
    assert newest.score(unknown, areas).first().note == "district not seen in training"
