"""The jobs of the lake: events to bronze, bronze to silver, silver to gold, and what serving reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.functions import vector_to_array

from marlstone.operators import forecast, geo, gold, lake, learning, outliers, scoring
from marlstone.operators import series as se
from marlstone.session import cut
from marlstone.sources import listings as src
from marlstone.sources.ledger import Ledger

TIES = ("ingested_at", "kafka_timestamp", "partition", "offset")


def write_serving(df: DataFrame, path: str, name: str, mode: str = "overwrite", jdbc: dict | None = None) -> None:
    """A serving table: over JDBC if options are given (truncated, not dropped, when overwritten), else Parquet."""
    if jdbc:
        df.write.mode(mode).options(**jdbc, dbtable=name, truncate="true", batchsize="5000").format("jdbc").save()
    else:
        # a full refresh: no partition of an earlier run may stay
        df.write.mode(mode).option("partitionOverwriteMode", "static").parquet(f"{path}/{name}")


def read_serving(spark: SparkSession, path: str, name: str, jdbc: dict | None = None) -> DataFrame | None:
    """A serving table, over JDBC if options are given, else Parquet; None if it is not there."""
    if jdbc:
        try:
            return spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
        except Exception as e:
            if name.lower() in str(e).lower() and ("not exist" in str(e) or "NOT_FOUND" in str(e)):
                return None
            raise
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def run_bronze(spark: SparkSession, source: str, path: str, now: datetime, topic: str = "listings") -> dict:
    """The log's new records to the bronze table, a batch a run: records that were read, and good ones that were written.

    A batch begins where the ledger's last one ends. It is one partition of the table, said in the
    ledger before it is written and closed after, so a run after one that broke off writes the
    same offsets over the same partition.
    """
    ledger = Ledger(spark, path)
    batch = ledger.open_batch()
    if batch is None:
        start, end = src.new_offsets(src.read_log(spark, source, ledger.position(), topic=topic))
        if not end:
            return {"rows_in": 0, "rows_out": 0}
        batch = ledger.begin(start, end, now)
    seen, written = Observation(), Observation()
    rows = src.decoded(src.read_log(spark, source, *batch.range, topic=topic)).observe(seen, F.count("*").alias("rows_in"))
    good = src.stamp(src.good_events(rows), batch.now).withColumn("batch", F.lit(batch.number)).observe(written, F.count("*").alias("rows_out"))
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date", "batch").parquet(path)
    ledger.finish(batch)
    return {**seen.get, **written.get}


def run_silver(spark: SparkSession, bronze: DataFrame, path: str, dims: geo.Dimensions, bridge: DataFrame | None = None, full: bool = True) -> dict:
    """The latest version of each listing in the physical range, placed in the hierarchy, by province.

    What can drop rows comes before the places are resolved. full: no partition of an earlier
    run stays; otherwise only the provinces of this run are replaced.
    """
    counted, written = Observation(), Observation()
    order = [F.desc_nulls_last(c) for c in TIES if c in bronze.columns]
    rows = bronze.observe(counted, F.count("*").alias("rows_in"))
    rows = lake.physical_filter(lake.with_unit_price(lake.latest_per_key(rows, ["listing_id"], order)))
    placed = geo.resolve_addresses(lake.with_timestamps(rows), dims, bridge)
    rate = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    out = lake.silver_select(placed).observe(written, F.count("*").alias("rows_out"), *(rate(f"{n}_code").alias(f"{n}_rate") for n in ("province", "district", "ward")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "static" if full else "dynamic").partitionBy("province_code").parquet(path)
    return {**counted.get, **written.get}


def run_gold(silver: DataFrame, path: str, min_listings: int = gold.MIN_LISTINGS) -> dict:
    """area_price, district_features and market_summary; rows_out counts listings in areas that are kept."""
    areas = gold.area_price(silver, min_listings)
    write_serving(areas, path, "area_price")
    write_serving(gold.district_features(silver, min_listings), path, "district_features")
    write_serving(gold.market_summary(silver), path, "market_summary")
    kept = silver.sparkSession.read.parquet(f"{path}/area_price").where("level = 'province'").agg(F.sum("n_listings")).first()[0]
    return {"rows_in": silver.count(), "rows_out": kept or 0}


def run_clusters(districts: DataFrame, path: str, k_max: int = 6) -> dict:
    """area_cluster: each district's cluster, its name and its place on two axes, by the features that differ enough.

    With one such feature there is one axis, and the second only keeps districts apart.
    """
    districts = cut(districts)
    names = [r.feature for r in learning.cv_screen(districts).where("used").collect()]  # a few features
    if not names:
        raise ValueError("the districts do not differ in any feature")
    k, _, out = learning.choose_k(learning.standardised(districts, names), k_max=k_max)
    labels = learning.label_by_rank(learning.cluster_summary(out)).select("cluster", "label")
    if len(names) > 1:
        out, shares = learning.project_2d(out)
    else:
        out, shares = learning.jitter(out.withColumn("x", vector_to_array("z")[0]), order="district_code"), [1.0]
    write_serving(out.drop("z").join(labels, "cluster"), path, "area_cluster")
    return {"k": k, "features": names, "explained": sum(shares)}


#: The signals of an anomaly beside the residual, and what a reason calls them.
SIGNALS = {"forest": "isolation forest", "lof": "local density"}


def run_anomalies(rows: DataFrame, path: str, columns: list[str], weights: dict[str, float] = scoring.WEIGHTS, contamination: float = scoring.CONTAMINATION, also: Sequence[str] = ()) -> dict:
    """anomaly: the listings whose blended rank is in the upper share, with the reason.

    rows: listing_id, district_code, district, price, price_per_m2, predicted and the numeric
    columns. Ranks by residual, isolation forest and local outlier factor are blended by weights;
    a signal without weight is computed only if it is named in also, and its score is null else.
    """
    wanted = [k for k in SIGNALS if weights.get(k) or k in also]
    ranked = cut(scoring.residual_scores(rows).withColumnRenamed("score", "r_residual").withColumn("_id", F.xxhash64("listing_id")))
    if "forest" in wanted:
        forest = outliers.isolation_forest(ranked, columns, "listing_id").withColumnRenamed("score", "forest_score")
        ranked = ranked.join(scoring.pct_rank(forest, "forest_score", "r_forest"), "listing_id")
    if "lof" in wanted:
        vectors = learning.standardised(ranked.select("_id", *columns), columns).select(F.col("_id").alias("id"), vector_to_array("z").alias("x"))
        lof = scoring.pct_rank(outliers.lof(vectors).withColumnRenamed("lof", "lof_score"), "lof_score", "r_lof")
        ranked = ranked.join(lof.withColumnRenamed("id", "_id"), "_id", "left")
    ranked = ranked.withColumn("score", scoring.blend({f"r_{k}": w for k, w in weights.items() if k == "residual" or k in wanted}))
    flagged = scoring.flag(ranked, contamination).withColumn("reason", scoring.reason(ranks={f"r_{k}": SIGNALS[k] for k in wanted}))
    flagged = flagged.withColumns({f"{k}_score": F.lit(None).cast("double") for k in SIGNALS if k not in wanted})
    names = ("listing_id", "district_code", "district", "price", "price_per_m2", "predicted", "residual", "ratio", "forest_score", "lof_score", "score", "reason")
    written = Observation()
    write_serving(flagged.select(*names).observe(written, F.count("*").alias("rows_out")), path, "anomaly")
    return {"rows_in": rows.count(), **written.get}


def run_forecasts(history: DataFrame, path: str, h: int = 3) -> None:
    """price_history, forecast, and forecast_metrics by area and model with the verdict on each area's best one."""
    tests = cut(forecast.backtest(history, h=h))
    metrics = se.backtest_summary(se.errors(tests, ("area_code", "model", "cut")), ("area_code", "model"))
    best = forecast.verdicts(tests).select("area_code", F.col("model").alias("_best"), "beats_naive")
    metrics = metrics.join(best, "area_code", "left").withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")
    write_serving(history, path, "price_history")
    write_serving(forecast.forecast(history, h=h), path, "forecast")
    write_serving(metrics, path, "forecast_metrics")


# Serving ---------------------------------------------------------------------------------


def overview(spark: SparkSession, path: str, hot: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """KPIs, the ten dearest districts, clusters and the hot block; a block without a table is None."""
    areas, kpis, clusters = (read_serving(spark, path, n) for n in ("area_price", "market_summary", "area_cluster"))
    return {
        "summary": kpis, "top_districts": gold.top_districts(areas) if areas is not None else None,
        "clusters": clusters.orderBy("cluster", F.desc("median_price_m2")) if clusters is not None else None, "hot": gold.hottest(hot) if hot is not None else None,
    }


def forecast_bundle(history: DataFrame, forecasts: DataFrame, metrics: DataFrame, area: str | None = None) -> dict[str, DataFrame]:
    """History, forecast and metrics (the best model first) of an area, by default that with the longest series."""
    if area is None:
        first = gold.longest_series(history).first()
        area = first.area_code if first else ""
    of = lambda df: df.where(F.col("area_code") == area)
    return {"history": of(history).orderBy("ds"), "forecast": of(forecasts).orderBy("model", "ds"), "metrics": of(metrics).orderBy("mape_mean", "model")}


def last_runs(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("run_at"), "stage").limit(limit)
