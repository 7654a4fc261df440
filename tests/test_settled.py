"""Settled rows: read by column, and listings written out after their latest version is chosen."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.fixtures import silver
from marlstone.operators import features as fe
from marlstone.operators import gold, learning
from marlstone.session import settle


def test_settled_rows_are_read_by_column(spark):
    rows = settle(spark.range(50).select("id", F.concat(F.lit("x"), "id").alias("name"), F.when(F.col("id") > 3, F.rand(1)).alias("v")))
    assert "ReadSchema: struct<v:double>" in rows.select("v")._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 50 and rows.where("v is null").count() == 4
    assert {r.name for r in rows.collect()} == {f"x{i}" for i in range(50)}


def test_listings_are_written_out_after_the_latest_version_is_chosen(spark, sf_dir):
    plan = silver(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Window [")  # the plan's last step comes first
    assert plan.count("concat_ws") == 1 and "lpad" not in plan[plan.index("Window [") :]


def test_encodings_of_counted_values_are_those_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"l{i}", str(d) if d else None, float(v)) for i, (d, v) in enumerate(zip(rng.integers(0, 5, 900), rng.integers(20, 60, 900), strict=True))]
    df = spark.createDataFrame(rows, "listing_id string, district_code string, price_per_m2 double").withColumns({"price": F.lit(1.0), "area": F.lit(50.0)})
    train, test = learning.split(df)
    read = []
    monkeypatch.setattr(fe, "group_percentile", lambda df, *a, _f=fe.group_percentile, **k: read.append(df.columns) or _f(df, *a, **k))
    encoded = learning.encode(train, test)
    assert read == [["district_code", "y", "_all", *(f"_own_{k}" for k in range(5))]]
    by, own = {}, train.collect()
    for r in own:
        by.setdefault(r.district_code, []).append(np.log(r.price_per_m2))
    assert {r.district_code: round(r.level, 9) for r in encoded.table.collect()} == {k: round(float(np.median(v)), 9) for k, v in by.items()}
    assert round(encoded.default, 9) == round(float(np.median([np.log(r.price_per_m2) for r in own])), 9)


def test_area_price_with_the_percentiles_that_are_asked_for(spark, sf_dir):
    rows = settle(silver(spark, sf_dir))
    some, whole = gold.area_price(rows, 5, ["district"], ["median_price_m2"]), gold.area_price(rows, 5, ["district"])
    assert some.columns == ["level", "code", "name", "parent_code", "n_listings", "median_price_m2", "mean_price_m2"]
    assert sorted(some.collect()) == sorted(whole.select(some.columns).collect())
