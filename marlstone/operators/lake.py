"""Rows of the lake: latest versions, physical ranges, quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_UNIT_PRICE, MAX_UNIT_PRICE = 1.0, 5000.0
ID_COLUMNS = ("province_code", "district_code", "ward_code")
# The columns of the silver table.
SILVER_COLUMNS = (
    "listing_id", "source", "crawled_at", "posted_at", "url", "address_raw", "province", "district", "ward", "province_code", "district_code",
    "ward_code", "geo_match_score", "geo_source", "area", "frontage", "access_road", "house_direction", "balcony_direction", "floors",
    "bedrooms", "bathrooms", "legal_status", "furniture_state", "property_type", "price", "price_per_m2", "ingested_at",
)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given; the order should break ties."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_unit_price(df: DataFrame) -> DataFrame:
    """Fill price_per_m2 (million per m2) from price (billion) and area where it is missing."""
    return df.withColumn("price_per_m2", F.coalesce("price_per_m2", F.try_divide(F.col("price") * 1000.0, F.col("area"))))


def physical_filter(df: DataFrame, lo: float = MIN_UNIT_PRICE, hi: float = MAX_UNIT_PRICE) -> DataFrame:
    """Drop what cannot be: no area, no price, or a unit price out of range. Odd prices stay."""
    return df.where((F.col("area") > 0) & (F.col("price") > 0) & F.col("price_per_m2").between(lo, hi))


def with_timestamps(df: DataFrame, names: Sequence[str] = ("crawled_at", "posted_at")) -> DataFrame:
    return df.withColumns({n: F.try_to_timestamp(n) for n in names if dict(df.dtypes)[n] == "string"})


def silver_select(df: DataFrame) -> DataFrame:
    return df.select(*SILVER_COLUMNS)


def match_quality(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """One row: rates of rows with a province, district and ward code, mean score, and whether a rate is low."""
    rate = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    names = ("province_rate", "district_rate", "ward_rate")
    out = df.agg(F.count("*").alias("n_rows"), *(F.round(rate(c), 6).alias(n) for c, n in zip(ID_COLUMNS, names, strict=True)), F.round(F.avg("geo_match_score"), 6).alias("mean_score"))
    return out.withColumn("low", F.coalesce(F.least("province_rate", "district_rate") < threshold, F.lit(False)))


def source_breakdown(df: DataFrame, source: str = "geo_source") -> DataFrame:
    """Rows and share of each source; the window runs over one row per source."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def dq_row(spark, stage: str, metrics: dict, notes: str = "") -> DataFrame:
    """A row of the quality log from observed metrics (rows_in, rows_out and match rates)."""
    rows_in, rows_out = metrics.get("rows_in"), metrics.get("rows_out")
    dropped = None if rows_in is None or rows_out is None else rows_in - rows_out
    row = (stage, rows_in, rows_out, dropped, metrics.get("province_rate"), metrics.get("district_rate"), metrics.get("ward_rate"), notes)
    return spark.createDataFrame([row], "stage string, rows_in long, rows_out long, rows_dropped long, province_rate double, district_rate double, ward_rate double, notes string")
