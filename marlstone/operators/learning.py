"""Models over listings: prices by regression, clusters of areas, and how good either is."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import features as fe
from marlstone.operators.boosting import BoostedModel, HistogramBoosting
from marlstone.operators.quantiles import discrete, group_values, sent
from marlstone.operators.scoring import price_metrics
from marlstone.session import cut, settle

SEED = 42
# What areas are clustered by.
CLUSTER_FEATURES = ("median_price_m2", "mean_area", "mean_floors", "pct_red_book", "pct_mat_tien")
# Names of clusters by their number, from the dearest to the cheapest.
CLUSTER_NAMES = {
    2: ["Cao cấp", "Phổ thông"], 3: ["Cao cấp", "Trung cấp", "Bình dân"], 4: ["Cao cấp", "Trung cấp", "Bình dân", "Vùng ven"],
    5: ["Siêu cao cấp", "Cao cấp", "Trung cấp", "Bình dân", "Vùng ven"],
}


def uniform(ident: str, seed: int = SEED):
    """A number in [0, 1) that depends on the id alone: the same after any repartitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 30)) / float(1 << 30)


def held_out(test: float = 0.2, ident: str = "listing_id", seed: int = SEED) -> Column:
    return uniform(ident, seed) < test


def split(df: DataFrame, test: float = 0.2, ident: str = "listing_id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    out = held_out(test, ident, seed)
    return df.where(~out), df.where(out)


@dataclass
class Encoded:
    """Rows ready for a regressor: y and the features; training rows have their level out of fold."""

    train: DataFrame
    test: DataFrame | None
    table: DataFrame = field(repr=False, default=None)
    default: float = 0.0


def encode(train: DataFrame, test: DataFrame) -> Encoded:
    """The split comes before the encoding: a test row's own price never reaches its features."""
    train = train.withColumns({"y": fe.target(), "fold": fe.fold_of("listing_id")})
    test = test.withColumn("y", fe.target())
    counted = fe.fold_counts(train)  # read by all three in place of the rows
    table, default = cut(fe.encoding_table(counted, freq="_all")), fe.overall(counted, freq="_all")
    return Encoded(fe.build_features(fe.oof_encoding(train, counted=counted, default=default)), fe.build_features(fe.apply_encoding(test, table, default)), table, default)


def encode_alike(few: DataFrame, counted: DataFrame) -> Encoded:
    """As encode, of training rows as alike has them, within folds; counted: the fold_counts of all. Of test rows there are none."""
    table, default = cut(fe.encoding_table(counted, freq="_all")), fe.overall(counted, freq="_all")
    return Encoded(fe.build_features(fe.oof_encoding(few, counted=counted, default=default)), None, table, default)


def alike(df: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """by, y and weight: rows with the same in by as one row, or two if their y differ; weight is how many rows it stands for.

    The number, mean and deviation of y stay what they are, and least squares depends on nothing else. Rows without y are left out.
    """
    n, mean, spread = F.col("_n"), F.col("_mean"), F.col("_spread")
    groups = df.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_spread"))
    above, below = F.ceil(n / 2), F.floor(n / 2)
    side = lambda value, weight: F.struct(value.alias(y), weight.cast("long").alias("weight"))
    two = F.array(side(mean + spread * F.sqrt(F.try_divide(below, above)), above), side(mean - spread * F.sqrt(F.try_divide(above, below)), below))
    return groups.select(*by, F.inline(F.when(spread > 0, two).otherwise(F.array(side(mean, n)))))


def used_features(df: DataFrame, names: Sequence[str] = fe.FEATURES) -> list[str]:
    """Features with any value: an imputer has no median for the others."""
    counts = df.agg(*(F.count(f).alias(f) for f in names)).first()
    return [f for f in names if counts[f]]


def medians(df: DataFrame, names: Sequence[str], weight: str) -> DataFrame:
    """One row: the median of each feature, one of its values, where a row stands for as many as weight says. Values are counted first, all features in one pass."""
    values = F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("value")) for f in names))
    counted = df.select(weight, F.inline(values)).where("value is not null and not isnan(value)").groupBy("name", "value").agg(F.sum(weight).alias("times"))
    found = {r.name: r.median for r in group_values(settle(counted), ["name"], {"median": ("value", discrete(0.5))}, freq="times").collect()}  # one row per feature
    return df.sparkSession.range(1).select(*(F.lit(found.get(f)).cast("double").alias(f) for f in names))


def pipeline(regressor, names: Sequence[str], fills: DataFrame | None = None) -> Pipeline:
    """Missing values become the median, with a flag beside each feature that says so. fills: a row of the medians, if they are not those of the rows to fit."""
    filled = [f"{f}_filled" for f in names]
    imputer = Imputer(strategy="median", inputCols=list(names), outputCols=filled)
    imputer = imputer if fills is None else imputer.fit(fills)
    assembler = VectorAssembler(inputCols=[*filled, *(f"{f}_missing" for f in names)], outputCol="features")
    return Pipeline(stages=[imputer, assembler, regressor.setLabelCol("y").setFeaturesCol("features").setPredictionCol("y_hat")])


def with_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in names})


BASELINES: dict[str, Callable] = {
    "linear": lambda: LinearRegression(regParam=1e-3),
    "forest": lambda: RandomForestRegressor(numTrees=30, maxDepth=8, seed=SEED),
    "boosted": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=SEED),
    "histogram": lambda: HistogramBoosting(trees=20),
}


@dataclass
class Fitted:
    model: Model | BoostedModel
    names: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with y_hat and predicted, the price in billion."""
        if isinstance(self.model, BoostedModel):
            return self.model.predict(df).withColumn("predicted", fe.inverse(F.col("y_hat"), F.col("area")))
        out = self.model.transform(with_flags(df, self.names))
        drop = ["features", *(f"{f}_{x}" for f in self.names for x in ("filled", "missing"))]
        return out.withColumn("predicted", fe.inverse(F.col("y_hat"), F.col("area"))).drop(*drop)


def fit(train: DataFrame, regressor, names: Sequence[str] | None = None, weight: str | None = None) -> Fitted:
    """A model of y: of MLlib's regressors with missing values filled in, of HistogramBoosting as they are.

    weight: how many rows a row stands for, as alike has it; for least squares.
    """
    names = list(names or used_features(train))
    if weight:
        if not isinstance(regressor, LinearRegression):
            raise ValueError("rows that stand for others are for least squares")
        return Fitted(pipeline(regressor.setWeightCol(weight), names, medians(train, names, weight)).fit(with_flags(train, names)), names)
    if isinstance(regressor, HistogramBoosting):
        return Fitted(regressor.fit(train, names), names)
    return Fitted(pipeline(regressor, names).fit(with_flags(train, names)), names)


def fit_baselines(train: DataFrame, makers: dict[str, Callable] | None = None) -> dict[str, Fitted]:
    return {name: fit(train, make()) for name, make in (makers or BASELINES).items()}


def members(models: dict[str, Fitted], df: DataFrame) -> DataFrame:
    """df with the logarithm that each member predicts, as columns of its own."""
    for name, m in models.items():
        df = m.predict(df).withColumnRenamed("y_hat", f"m_{name}").drop("predicted")
    return df


def ensemble(models: dict[str, Fitted], df: DataFrame) -> DataFrame:
    """The mean of the members' logarithms."""
    mean = sum(F.col(f"m_{n}") for n in models) / len(models)
    return members(models, df).withColumn("y_hat", mean).withColumn("predicted", fe.inverse(F.col("y_hat"), F.col("area")))


def tune(train: DataFrame, regressor=None, grid=None, folds: int = 3, parallelism: int = 2) -> Fitted:
    """The grid's best by cross-validated RMSE of the logarithm, on training rows alone."""
    regressor = regressor or GBTRegressor(seed=SEED)
    grid = grid or ParamGridBuilder().addGrid(regressor.maxDepth, [3, 5]).addGrid(regressor.maxIter, [10, 20]).build()
    names = used_features(train)
    judge = RegressionEvaluator(labelCol="y", predictionCol="y_hat", metricName="rmse")
    cv = CrossValidator(estimator=pipeline(regressor, names), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=SEED, parallelism=parallelism)
    return Fitted(cv.fit(with_flags(train, names)).bestModel, names)


@dataclass
class Stacked:
    models: dict[str, Fitted]
    head: Model

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.head.transform(_stack_input(members(self.models, df), self.models)).drop("_stack")
        return out.withColumn("predicted", fe.inverse(F.col("y_hat"), F.col("area")))


def _stack_input(df: DataFrame, models) -> DataFrame:
    return VectorAssembler(inputCols=[f"m_{n}" for n in models], outputCol="_stack").transform(df)


def stack(train: DataFrame, makers: dict[str, Callable] | None = None, folds: int = 5) -> Stacked:
    """A ridge over what members predict for folds that they have not seen."""
    makers = makers or BASELINES
    numbered = train.withColumn("_cv", fe.fold_of("listing_id", folds))
    out = None
    for k in range(folds):
        part = members(fit_baselines(numbered.where(F.col("_cv") != k), makers), numbered.where(F.col("_cv") == k))
        part = part.select("y", *(f"m_{n}" for n in makers))
        out = part if out is None else out.unionByName(part)
    head = LinearRegression(labelCol="y", featuresCol="_stack", predictionCol="y_hat", regParam=0.1, elasticNetParam=0.0)
    return Stacked(fit_baselines(train, makers), head.fit(_stack_input(out, makers)))


def choose(results: dict[str, dict]) -> str:
    """The best single model by cross-validated MAPE; the stack only if it gains over half a point at under three times the time."""
    single = min((n for n in results if n != "stack"), key=lambda n: results[n]["mape"])
    s = results.get("stack")
    if s and results[single]["mape"] - s["mape"] > 0.5 and s["seconds"] / max(results[single]["seconds"], 1e-9) < 3:
        return "stack"
    return single


def group_holdout(df: DataFrame, make: Callable, folds: int = 5) -> DataFrame:
    """fold, mape: each fold's districts are unseen, and encodings are learned again without them."""
    out, group = None, F.pmod(F.xxhash64("district_code"), F.lit(folds))
    for k in range(folds):
        train, test = df.where(group != k), df.where(group == k)
        if test.isEmpty() or train.isEmpty():
            continue
        e = encode(train, test)
        row = price_metrics(fit(e.train, make()).predict(e.test)).select(F.lit(k).alias("fold"), "mape")
        out = row if out is None else out.unionByName(row)
    return out


def importances(fitted: Fitted) -> DataFrame:
    """feature, feature_group, importance of a tree model; a feature's missing flag counts for it."""
    from pyspark.sql import SparkSession

    values = fitted.model.stages[-1].featureImportances.toArray()
    n, of = len(fitted.names), {f: g for g, fs in fe.GROUPS.items() for f in fs}
    rows = [(f, of.get(f, "other"), float(values[i] + values[n + i])) for i, f in enumerate(fitted.names)]
    return SparkSession.active().createDataFrame(rows, "feature string, feature_group string, importance double")


def learning_curve(df: DataFrame, make: Callable, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """fraction, n, mape on the same test rows; fractions are nested, and each learns its own encoding."""
    train, test = split(df)
    out = None
    for f in fractions:
        part = train.where(uniform("listing_id", SEED + 1) < f)
        e = encode(part, test)
        row = price_metrics(fit(e.train, make()).predict(e.test)).select(F.lit(float(f)).alias("fraction"), F.lit(part.count()).alias("n"), "mape")
        out = row if out is None else out.unionByName(row)
    return out


def verdict(mapes: Sequence[float]) -> str:
    gain = mapes[-2] - mapes[-1]
    return "flat" if gain < 0.15 else "nearly flat" if gain < 0.5 else "still falling"


def beside_district(df: DataFrame, areas: DataFrame, unit: Column) -> DataFrame:
    """df with district_median, and vs_district_pct: how far a unit price is from it."""
    medians = areas.where("level = 'district'").select(F.col("code").alias("district_code"), F.col("median_price_m2").alias("district_median"))
    return df.join(sent(medians), "district_code", "left").withColumn("vs_district_pct", (F.try_divide(unit, F.col("district_median")) - 1) * 100)


def score_prices(df: DataFrame, fitted: Fitted, encoding: Encoded, areas: DataFrame, mape: float = 19.6) -> DataFrame:
    """Predicted price with an interval, its distance from the district's median, and a note on unknown districts."""
    known = encoding.table.select("district_code", F.lit(True).alias("_seen"))
    rows = fitted.predict(fe.build_features(fe.apply_encoding(df, encoding.table, encoding.default)))
    rows = beside_district(rows, areas, F.col("predicted") * 1000 / F.col("area")).join(sent(known), "district_code", "left")
    note = F.when(F.col("district_code").isNull(), "district unknown").when(F.col("_seen").isNull(), "district not seen in training")
    return rows.withColumns({
        "low": F.col("predicted") * (1 - mape / 100), "high": F.col("predicted") * (1 + mape / 100), "note": note,
    }).drop("_seen")


def check_listings(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """gap |price - predicted| / predicted, flagged, severity."""
    gap = F.abs(F.col("price") - F.col("predicted")) / F.col("predicted")
    level = F.when(gap >= 1.0, "cao").when(gap >= 0.5, "trung bình").otherwise("thấp")
    return df.withColumns({"gap": gap, "flagged": gap >= limit, "severity": level})


# Clusters --------------------------------------------------------------------------------


def cv_screen(df: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES, least: float = 0.15) -> DataFrame:
    """feature, cv (sample deviation over mean), used."""
    one = df.agg(*(F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias(c) for c in columns))
    return one.unpivot([], list(columns), "feature", "cv").withColumn("used", F.coalesce(F.col("cv") >= least, F.lit(False)))


def standardised(df: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """df with z, the vector of its columns: missing values at the median, mean 0, deviation 1.

    Settled: the models fitted to it read it many times.
    """
    df = cut(df)
    filled = [f"_{c}" for c in columns]
    rows = Imputer(strategy="median", inputCols=list(columns), outputCols=filled).fit(df).transform(df)
    rows = VectorAssembler(inputCols=filled, outputCol="_v").transform(rows)
    return StandardScaler(inputCol="_v", outputCol="z", withMean=True, withStd=True).fit(rows).transform(rows).drop("_v", *filled)


def calinski_harabasz(df: DataFrame, k: int) -> float:
    """Of the column cluster over vectors z, by sums: between over within, each by its degrees of freedom."""
    parts = df.select("cluster", F.posexplode(vector_to_array("z")).alias("i", "x"))
    by = parts.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = by.groupBy("i").agg(F.sum("n").alias("total_n"), F.sum("s").alias("total_s"))
    r = by.join(total, "i").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("total_s") / F.col("total_n"), 2)).alias("b"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.max("total_n").alias("n")).first()
    return (r.b / (k - 1)) / (r.w / (r.n - k)) if r.w and r.n > k else float("nan")


def choose_k(df: DataFrame, k_min: int = 2, k_max: int = 6) -> tuple[int, DataFrame, DataFrame]:
    """The k with the largest silhouette, the sweep's table, and df (with z) with the column cluster of that k."""
    n, spark = df.count(), df.sparkSession
    if n < 6:
        raise ValueError("too few rows to cluster")
    judge = ClusteringEvaluator(featuresCol="z", predictionCol="cluster")
    rows, best = [], None
    for k in range(k_min, min(k_max, n - 1) + 1):
        model = KMeans(k=k, seed=SEED, featuresCol="z", predictionCol="cluster", initSteps=5, maxIter=50).fit(df)
        out = model.transform(df)
        rows.append((k, float(model.summary.trainingCost), float(judge.evaluate(out)), float(calinski_harabasz(out, k))))
        if best is None or rows[-1][2] > best[0]:
            best = (rows[-1][2], k, out)
    return best[1], spark.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double"), best[2]


def project_2d(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """df with x and y, and the share of variance of each; the sign is such that the largest loading is positive."""
    model = PCA(k=2, inputCol="z", outputCol="_p").fit(df)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, i]).argmax(), i] > 0 else -1.0 for i in range(loads.shape[1])]
    p = vector_to_array("_p")
    return model.transform(df).withColumns({"x": p[0] * signs[0], "y": p[1] * signs[1]}).drop("_p"), [float(v) for v in model.explainedVariance]


def cluster_summary(df: DataFrame, price: str = "median_price_m2") -> DataFrame:
    out = df.groupBy("cluster").agg(F.count("*").alias("n"), F.percentile(price, F.lit(0.5)).alias("median_price"), F.avg(price).alias("mean_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per cluster


def label_by_rank(summary: DataFrame, names: dict[int, list[str]] | None = None) -> DataFrame:
    """The summary with a label by the rank of the median price, the dearest first."""
    k = summary.count()
    known = (names or CLUSTER_NAMES).get(k) or [f"Nhóm {i + 1}" for i in range(k)]
    rank = F.row_number().over(Window.orderBy(F.desc("median_price"), "cluster"))
    return summary.withColumn("rank", rank).withColumn("label", F.element_at(F.array(*map(F.lit, known)), F.col("rank")))


def price_overlap(summary: DataFrame) -> float:
    """Mean overlap of the price ranges of neighbouring clusters, as a share of the whole range."""
    w = Window.orderBy(F.desc("median_price"), "cluster")
    pairs = summary.select("min_price", "max_price", F.lead("min_price").over(w).alias("lo"), F.lead("max_price").over(w).alias("hi"))
    span = summary.agg(F.max("max_price") - F.min("min_price")).first()[0]
    shared = F.greatest(F.lit(0.0), F.least("max_price", "hi") - F.greatest("min_price", "lo"))
    found = pairs.where("lo is not null").agg(F.avg(shared)).first()[0]
    return (found or 0.0) / span if span else 0.0


def jitter(df: DataFrame, step: float = 0.35, order: str = "code") -> DataFrame:
    """y for one-dimensional clusters: the number within the cluster times a step. df: one row per area."""
    return df.withColumn("y", (F.row_number().over(Window.partitionBy("cluster").orderBy(order)) - 1) * step)
