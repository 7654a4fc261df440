import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import features as fe
from marlstone.operators import forecast, gold, learning, outliers, scoring, series
from marlstone.plans import learning_queries


@pytest.fixture(scope="module")
def listings(spark):
    """Unit prices that follow district and road, with noise and gaps."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        d, road, area = i % 8, rng.choice([None, 2.0, 5.0, 9.0]), rng.uniform(30, 90)
        unit = math.exp(3 + 0.3 * d + 0.1 * ((road or 0) >= 4) + rng.gauss(0, 0.1))
        rows.append((f"l{i}", f"{d:03d}", f"D{d}", "79", area, unit * area / 1000, unit, road, float(rng.choice([1, 2, 3])), rng.choice(["Sổ đỏ", "Contract", None])))
    return spark.createDataFrame(rows, "listing_id string, district_code string, district string, province_code string, area double, price double, price_per_m2 double, access_road double, floors double, legal_status string").persist()


@pytest.fixture(scope="module")
def encoded(listings):
    return learning.encode(*learning.split(listings))


def test_features(spark):
    rows = [(50.0, 2.0, 2.0, 4.0, None, "Sổ đỏ", "Full", "Đông Nam", 4.0), (50.0, 0.0, None, None, 9.0, "??", None, "x", 4.0)]
    df = spark.createDataFrame(rows, "area double, bedrooms double, bathrooms double, frontage double, access_road double, legal_status string, furniture_state string, house_direction string, district_level double")
    made = fe.build_features(df)
    assert made.columns[-20:] == fe.FEATURES and len(fe.FEATURES) == 20
    a, b = made.collect()
    assert (a.area_per_bedroom, a.rooms_total, a.is_mat_tien, a.legal_rank, a.furniture_rank) == (25.0, 4.0, None, 4.0, 2.0)
    assert (b.area_per_bedroom, b.rooms_total, b.is_wide_road, b.legal_rank, b.house_dir_sin, b.floors) == (None, 0.0, 1.0, None, None, None)
    assert a.house_dir_sin == pytest.approx(math.sin(math.radians(135))) and a.level_x_log_area == pytest.approx(4 * math.log1p(50))
    dead = fe.dead_features(spark.createDataFrame([("abc",), ("abc",), ("",), (None,)], "legal_status string"), "legal_status", fe.LEGAL_RANKS).first()
    assert (dead.n_values, dead.n_hits, dead.dead, dead.top) == (2, 0, True, "abc")


def test_encoding_leaves_a_row_out(spark):
    rows = [(i, "d", float(i), i % 5) for i in range(10)] + [(10, "alone", 100.0, 0)]
    df = spark.createDataFrame(rows, "i int, district_code string, y double, fold int")
    got = {r.i: r.district_level for r in fe.oof_encoding(df).collect()}
    for i, _, _, fold in rows[:10]:
        assert got[i] == np.median([r[2] for r in rows[:10] if r[3] != fold])
    assert got[10] == np.median([r[2] for r in rows])


def test_models_beat_the_median(encoded):
    naive = scoring.price_metrics(encoded.test.withColumn("predicted", fe.inverse(F.lit(encoded.default), F.col("area")))).first().mape
    fast = {"linear": lambda: LinearRegression(regParam=1e-3), "boosted": lambda: GBTRegressor(maxIter=5, maxDepth=3, seed=1)}
    models = learning.fit_baselines(encoded.train, fast)
    for m in models.values():
        assert scoring.price_metrics(m.predict(encoded.test)).first().mape < 0.6 * naive
    assert scoring.price_metrics(learning.ensemble(models, encoded.test)).first().mape < 0.6 * naive
    stacked = learning.stack(encoded.train, fast, folds=2)
    assert scoring.price_metrics(stacked.predict(encoded.test)).first().mape < 0.6 * naive
    top = learning.importances(models["boosted"]).orderBy(F.desc("importance")).first()
    assert top.feature_group in ("location", "interaction")


def test_tuning_and_curves(listings, encoded):
    gbt = GBTRegressor(maxIter=3, seed=1)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [1, 3]).build()
    assert learning.tune(encoded.train, gbt, grid, folds=2).model.stages[-1].getMaxDepth() == 3
    make = lambda: LinearRegression(regParam=1e-3)
    holdout = learning.group_holdout(listings, make, 3).collect()
    assert len(holdout) >= 2 and all(r.mape > 0 for r in holdout)
    curve = learning.learning_curve(listings, make, (0.25, 1.0)).orderBy("fraction").collect()
    assert curve[0].n < curve[1].n
    assert [learning.verdict(x) for x in ([20, 19.9], [20, 19.7], [20, 19])] == ["flat", "nearly flat", "still falling"]
    fast, slow = {"mape": 20.0, "seconds": 1.0}, {"mape": 19.0, "seconds": 2.0}
    assert learning.choose({"a": fast, "stack": slow}) == "stack" and learning.choose({"a": fast, "stack": {**slow, "seconds": 9.0}}) == "a"


def test_scored_prices(listings, encoded):
    fitted = learning.fit(encoded.train, LinearRegression(regParam=1e-3))
    odd = listings.limit(3).withColumn("district_code", F.when(F.col("listing_id") == listings.first().listing_id, None).otherwise("999"))
    rows = learning.score_prices(odd, fitted, encoded, gold.area_price(listings.withColumns({c: F.lit("x") for c in ("province", "ward_code", "ward")}))).collect()
    assert sorted(r.note for r in rows) == ["district not seen in training"] * 2 + ["district unknown"]
    assert all(r.low < r.predicted < r.high for r in rows)


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{c}{i}", float(50 * (c + 1) + rng.normal()), float(20 * c + rng.normal()), 1.0) for c in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "code string, median_price_m2 double, mean_area double, same double")
    assert [r.used for r in learning.cv_screen(df, ["median_price_m2", "same"]).orderBy("feature").collect()] == [True, False]
    k, sweep, out = learning.choose_k(learning.standardised(df, ["median_price_m2", "mean_area"]))
    assert k == 3 and sweep.count() == 5
    best = sweep.orderBy(F.desc("calinski_harabasz")).first()
    assert best.k == 3
    labels = learning.label_by_rank(learning.cluster_summary(out)).orderBy("rank").collect()
    assert [r.label for r in labels] == ["Cao cấp", "Trung cấp", "Bình dân"] and labels[0].share == pytest.approx(1 / 3)
    assert learning.price_overlap(learning.cluster_summary(out)) == 0
    placed, shares = learning.project_2d(out)
    assert sum(shares) == pytest.approx(1) and {"x", "y"} <= set(placed.columns)
    assert learning.jitter(out).agg(F.max("y")).first()[0] == pytest.approx(7 * 0.35)
    with pytest.raises(ValueError):
        learning.choose_k(learning.standardised(df.limit(4), ["mean_area"]))


def planted(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 3)), [[9, 9, 9], [-9, 8, 9]]])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double"), x


def test_isolation_forest_finds_outliers(spark):
    df, _ = planted(spark)
    rows = outliers.isolation_forest(df, ["a", "b", "c"], trees=40, sample=64).orderBy(F.desc("score")).collect()
    assert {r.id for r in rows[:2]} == {300, 301} and all(0 < r.score < 1 for r in rows)


def test_lof_is_exact_in_one_block_and_near_beyond(spark):
    df, x = planted(spark)
    points = df.select("id", F.array("a", "b", "c").alias("x"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    reach = np.maximum(np.take_along_axis(d, near, 1), np.sort(d, axis=1)[:, 9][near])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    want = density[near].mean(axis=1) / density
    got = {r.id: r.lof for r in outliers.lof(points, 10).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-5)
    rough = outliers.neighbours(points, 10, block=60).select("id", "other").collect()
    found = {(r.id, r.other) for r in rough}
    recall = sum((i, int(j)) in found for i, row in enumerate(near) for j in row) / near.size
    assert recall >= 0.9


def test_neighbours_are_exact_over_many_blocks_of_64_dimensions(spark):
    x = np.random.default_rng(6).normal(size=(1500, 64))
    x[700:720] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = outliers.neighbours(df, 5, block=150).toPandas().sort_values(["id", "distance"])
    assert len(got) == 5 * len(x) and not got.duplicated(["id", "other"]).any()
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 5), np.sort(d, axis=1)[:, :5], atol=1e-6)


def test_registered_forest_sees_all_dimensions(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(300, 64))
    x[7, 8:] = 30
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert learning_queries.forest(spark, str(tmp_path)).orderBy(F.desc("score")).first().id == 7


def test_registered_clusters_sweep_up_to_six(spark, monkeypatch):
    rng = np.random.default_rng(1)
    columns = learning.CLUSTER_FEATURES
    rows = [(f"{c}{i}", *(float(50 * ((c * (j % 4 + 1)) % 5 + 1) + rng.normal()) for j in range(len(columns)))) for c in range(5) for i in range(8)]
    df = spark.createDataFrame(rows, ["district_code", *columns])
    monkeypatch.setattr(learning_queries, "silver", lambda s, d: None)
    monkeypatch.setattr(learning_queries.gold, "district_features", lambda d: df)
    assert learning_queries.clusters(spark, "").select("label").distinct().count() == 5


def ramp(spark):
    rows = [("a", f"2025-01-{d:02d}" if d < 29 else None, 100 + 0.8 * d) for d in range(1, 29)]
    weekly = [("w", str(np.datetime64("2025-01-06") + 7 * i), 100 + 0.8 * i + 2 * math.sin(i / 3)) for i in range(30)]
    return spark.createDataFrame(rows + weekly, "area_code string, ds string, price_m2 double").withColumn("ds", F.to_date("ds"))


def test_trend_beats_the_last_value(spark):
    tests = forecast.backtest(ramp(spark), h=3)
    assert {r.model for r in tests.select("model").distinct().collect()} == set(forecast.MODELS)
    best = {r.area_code: r for r in forecast.verdicts(tests).collect()}
    assert best["a"].model != "naive" and best["a"].beats_naive
    ahead = forecast.forecast(ramp(spark)).where("model = 'trend' and area_code = 'w'").orderBy("ds").collect()
    assert [str(r.ds) for r in ahead] == ["2025-08-04", "2025-08-11", "2025-08-18"] and all(r.low <= r.yhat <= r.high for r in ahead)
    assert forecast.wins(tests).agg(F.sum("wins")).first()[0] == 2
    naive = series.naive_backtest(ramp(spark)).count()
    assert tests.where("model = 'naive'").count() == naive


def test_ranks_and_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, v double")
    ranks = {r.i: r.pct_rank for r in scoring.pct_rank(df, "v").collect()}
    assert ranks == {0: 87.5, 1: 25.0, 2: 87.5, 3: None, 4: 50.0}
    rows = spark.createDataFrame([(10.0, 100.0, 9.0, 98.0), (200.0, 100.0, 1.0, 1.0), (100.0, 100.0, 0.0, 1.0)], "price double, predicted double, ratio double, forest_rank double")
    assert [r[0] for r in rows.select(scoring.reason(ranks={"forest_rank": "its neighbours"})).collect()] == ["price lower than predicted by 90 %; unusual by its neighbours", "price higher than predicted by 100 %", ""]
    assert scoring.flag(df.withColumnRenamed("v", "score").limit(0)).count() == 0


def test_clusters_read_their_rows_once(spark):
    """The models fitted to standardised rows read settled ones."""
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = spark.range(12).select("id", F.udf(counted, "double")(F.col("id").cast("double")).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    _, _, out = learning.choose_k(learning.standardised(df, ["a", "b"]), k_max=3)
    assert out.count() == 12 and seen.value <= 12


def test_names_as_the_table_has_them_are_normal(spark):
    names = [*fe.LEGAL_RANKS, *fe.FURNITURE_RANKS, *fe.DIRECTIONS]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.norm_text(F.col("n")).alias("normal")).collect()
    assert all(r.n == r.normal for r in rows)


def test_scored_prices_begin_at_settled_rows(spark, sf_dir):
    """The model's fit and the scores read settled listings, not the tables."""
    assert learning_queries.prices(spark, sf_dir).inputFiles() == []


def test_features_are_generated_as_a_method_that_the_jvm_compiles(spark):
    """The JVM leaves methods of over 8,000 bytes uncompiled; names that need normalising still get their rank."""
    names = ["Have certificate", "  SỔ HỒNG ", "Giấy tờ hợp lệ", "Sổ  đỏ", "none of these", "", None]
    rows = spark.range(len(names)).select("id", F.get(F.array(*(F.lit(n) for n in names)), F.col("id").cast("int")).alias("legal_status"), F.lit(50.0).alias("area"), F.lit(2.0).alias("district_level"), F.lit("Đầy-đủ").alias("furniture_state"))
    out = fe.build_features(rows)
    assert [r.legal_rank for r in out.orderBy("id").collect()] == [4, 4, 3, 4, None, None, None]
    assert {r.furniture_rank for r in out.collect()} == {2}
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(out._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    assert sizes and max(sizes) < 8000
