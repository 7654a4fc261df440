"""The price job: train, compare and choose models, store them with their encoding, and score with them later.

A version is a folder with its members, the stack's head if it is one, and the encoding of districts it was
trained with; its row in the registry is written last, so a version without a row is not there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import learning
from marlstone.operators.boosting import BoostedModel
from marlstone.operators.scoring import price_metrics
from marlstone.session import cut

REGISTRY = "version long, trained_at timestamp, chosen string, n_train long, n_test long, mape double, mae double, rmse double, r2 double, default_level double, candidates string, members string"


@dataclass
class PriceModel:
    """A stored version: what predicts, and the encoding that belongs to it."""

    version: int
    mape: float
    model: learning.Fitted | learning.Stacked
    encoding: learning.Encoded

    def score(self, rows: DataFrame, areas: DataFrame) -> DataFrame:
        """rows with predicted, its interval, distance from the district's median and a note."""
        return learning.score_prices(rows, self.model, self.encoding, areas, self.mape)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The registry: a row for each version, with its metrics, and the candidates' as JSON."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{path}/registry")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], REGISTRY)


def compared(train: DataFrame, makers: dict[str, Callable], folds: int, stack: bool) -> dict[str, dict]:
    """Each candidate's MAPE over folds of the training rows, encodings learned anew in each, and its time to predict."""
    # not the folds of encodings and stacks, which are of the same ids
    numbered = train.withColumn("_cv", F.floor(learning.uniform("listing_id", learning.SEED + 2) * folds))
    told: dict[str, list[tuple[float, float]]] = {}
    for k in range(folds):
        e = learning.encode(numbered.where(F.col("_cv") != k), numbered.where(F.col("_cv") == k))
        e = learning.Encoded(cut(e.train), cut(e.test), e.table, e.default)
        candidates = learning.fit_baselines(e.train, makers)
        if stack:
            candidates["stack"] = learning.stack(e.train, makers, folds)
        for name, fitted in candidates.items():
            began = time.perf_counter()
            mape = price_metrics(fitted.predict(e.test)).first().mape
            told.setdefault(name, []).append((mape, time.perf_counter() - began))
    return {name: {"mape": sum(m for m, _ in rows) / len(rows), "seconds": sum(s for _, s in rows)} for name, rows in told.items()}


def run_price_training(spark: SparkSession, rows: DataFrame, path: str, now: datetime, makers: dict[str, Callable] | None = None, folds: int = 3, stack: bool = False) -> dict:
    """Choose a model by cross-validation on the training rows, fit it on all of them, and store it as a new version.

    rows: silver listings. The test rows say how good the stored version is; they choose nothing.
    """
    makers = makers or learning.BASELINES
    rows = cut(rows.where("price > 0 and area > 0 and price_per_m2 > 0"))
    train, test = learning.split(rows)
    candidates = compared(train, makers, folds, stack)
    chosen = learning.choose(candidates)
    e = learning.encode(train, test)
    e = learning.Encoded(cut(e.train), cut(e.test), cut(e.table), e.default)
    model = learning.stack(e.train, makers, folds) if chosen == "stack" else learning.fit(e.train, makers[chosen]())
    metrics = price_metrics(model.predict(e.test)).first()
    version = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    members = store(spark, model, e, f"{path}/version={version}")
    row = (version, now, chosen, e.train.count(), e.test.count(), metrics.mape, metrics.mae, metrics.rmse, metrics.r2, e.default, json.dumps(candidates, sort_keys=True), json.dumps(members))
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(f"{path}/registry")
    return {"version": version, "chosen": chosen, "mape": metrics.mape, "candidates": candidates}


def store(spark: SparkSession, model: learning.Fitted | learning.Stacked, e: learning.Encoded, path: str) -> dict:
    """Write a model's parts; what a folder of a run that broke off holds is replaced. Gives each member's kind and features."""
    parts = model.models if isinstance(model, learning.Stacked) else {"": model}
    told = {}
    for name, fitted in parts.items():
        at, kind = f"{path}/member-{name}", "histogram" if isinstance(fitted.model, BoostedModel) else "pipeline"
        if kind == "histogram":
            spark.createDataFrame([(fitted.model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(at)
        else:
            fitted.model.write().overwrite().save(at)
        told[name] = {"kind": kind, "features": fitted.names}
    if isinstance(model, learning.Stacked):
        model.head.write().overwrite().save(f"{path}/head")
    e.table.write.mode("overwrite").parquet(f"{path}/encoding")
    return told


def load_price_model(spark: SparkSession, path: str, version: int | None = None) -> PriceModel:
    """A version of the registry, by default the newest."""
    known = versions(spark, path)
    row = (known.where(F.col("version") == version) if version else known).orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no such model in {path}: run_price_training stores one")
    at = f"{path}/version={row.version}"
    parts = {}
    for name, told in json.loads(row.members).items():
        member = f"{at}/member-{name}"
        model = BoostedModel.from_json(spark.read.parquet(member).first().model) if told["kind"] == "histogram" else PipelineModel.load(member)
        parts[name] = learning.Fitted(model, told["features"])
    model = learning.Stacked(parts, LinearRegressionModel.load(f"{at}/head")) if row.chosen == "stack" else parts[""]
    return PriceModel(row.version, row.mape, model, learning.Encoded(None, None, spark.read.parquet(f"{at}/encoding"), row.default_level))
