"""Queries that train models: no SQL gives the same rows, so tests hold them against bounds or brute force."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marlstone.fixtures import NUMBERS, columns, latest, listed, silver, table
from marlstone.operators import features, forecast, gold, learning, outliers
from marlstone.plans.model_queries import monthly
from marlstone.session import cut, settle


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def forest(spark, sf):
    rows = vectors(spark, sf)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    dims = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)]
    return outliers.isolation_forest(rows.select("id", *dims), [f"x{i}" for i in range(width)])


def prices(spark, sf):
    """Test rows with a linear model's prices and intervals."""
    marks = (features.fold_of("listing_id").alias("fold"), learning.held_out().alias("held_out"))
    named = ("n_nationkey", "r_regionkey", "n_name")
    told = ("l_tax", "l_returnflag", "l_linestatus", "area")
    made_of = ("district_code", "area", "access_road", "floors", "legal_status", "furniture_state")
    # a join of six tables; training rows are read twice, test rows once
    rows = settle(latest(spark, sf).withColumn("listing_id", columns()["listing_id"]).select(*NUMBERS, *named, *told, "price", "price_per_m2", *marks))
    train = rows.where("not held_out").withColumn("y", features.target())
    counted = features.fold_counts(train, named[0], more=(*named[1:], "price_per_m2"))
    counted = listed(counted, ("province_code", "district_code", "district", "price_per_m2"), [c for c in counted.columns if c == "y" or c.startswith("_")])
    few = settle(listed(learning.alike(train, [named[0], "fold", "l_linenumber", *told]), made_of, ("fold", "y", "weight")))
    encoded = learning.encode_alike(few, counted)
    fitted = learning.fit(settle(encoded.train.select("y", "weight", *features.FEATURES)), LinearRegression(regParam=1e-3), weight="weight")
    areas = gold.area_price(counted, levels=["district"], percentiles=["median_price_m2"], freq="_all")
    test = cut(rows.where("held_out").select(*NUMBERS, named[0], *told, "price"))  # read once, whole
    test = listed(test, ("listing_id", "price", *made_of))
    rows = learning.score_prices(test, fitted, encoded, areas)
    return learning.check_listings(rows).select("listing_id", "price", "predicted", "low", "high", "vs_district_pct", "note", "gap", "flagged", "severity")


def clusters(spark, sf):
    """Districts by price and kind: their cluster's label and place on two axes."""
    rows = learning.standardised(gold.district_features(silver(spark, sf)))
    _, _, out = learning.choose_k(rows)
    labels = learning.label_by_rank(learning.cluster_summary(out)).select("cluster", "label")
    placed, _ = learning.project_2d(out)
    return placed.join(labels, "cluster").select("district_code", "label", "median_price_m2", "x", "y")


QUERIES = {
    "lof": lambda s, d: outliers.lof(vectors(s, d)).select("id", F.round("lof", 6).alias("lof")),
    "neighbours": lambda s, d: outliers.neighbours(vectors(s, d), k=5).select("id", "other", F.round("distance", 6).alias("distance")),
    "isolation_forest": forest,
    "score_prices": prices,
    "area_clusters": clusters,
    "backtest_models": lambda s, d: forecast.backtest(monthly(s, d)),
    "forecast_models": lambda s, d: forecast.forecast(monthly(s, d)),
    "forecast_verdicts": lambda s, d: forecast.verdicts(forecast.backtest(monthly(s, d))),
}
#: All pairs in DuckDB: exact, and slow beyond a few thousand rows.
NEAR = """near AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) <= {k})"""
SQL = {
    "neighbours": f"WITH {NEAR.format(k=5)} SELECT id, other, round(distance, 6) AS distance FROM near",
    "lof": f"""WITH {NEAR.format(k=outliers.NEIGHBOURS)}, far AS (SELECT id AS other, max(distance) AS k_distance FROM near GROUP BY 1),
        density AS (SELECT id, 1 / (avg(greatest(distance, k_distance)) + 1e-10) AS density FROM near JOIN far USING (other) GROUP BY 1)
        SELECT near.id, round(avg(o.density) / any_value(d.density), 6) AS lof FROM near JOIN density o ON o.id = near.other JOIN density d ON d.id = near.id GROUP BY 1""",
}
