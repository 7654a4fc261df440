"""Gold tables: robust statistics per area, market figures, rankings and classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.features import LEGAL_RANKS, rank_of
from marlstone.operators.quantiles import discrete, group_values
from marlstone.session import cut, settle

MIN_LISTINGS = 30
LEVELS = ("province", "district", "ward")
#: The rank of a full title.
FULL_TITLE, WIDE_ROAD = 4, 4


# The percentiles of an area's listings, each one of the values.
MEDIAN = ("price_per_m2", discrete(0.5))
PERCENTILES = {
    "median_price_m2": MEDIAN, "p25_price_m2": ("price_per_m2", discrete(0.25)), "p75_price_m2": ("price_per_m2", discrete(0.75)),
    "median_area": ("area", discrete(0.5)), "median_price": ("price", discrete(0.5)),
}


def area_price(df: DataFrame, min_listings: int = MIN_LISTINGS, levels: Sequence[str] = LEVELS, percentiles: Sequence[str] = tuple(PERCENTILES), freq: str | None = None) -> DataFrame:
    """Statistics of each area of the levels (province, district and ward) with enough listings, settled: a row for each area.

    Percentiles are exact in areas of any size. Rows are settled once and read by each level. freq: a column with how many listings a row stands for.
    """
    sets = [("province_code", "province"), ("district_code", "district", "province_code"), ("ward_code", "ward", "district_code")]
    used = sorted({k for level, keys in zip(LEVELS, sets, strict=True) if level in levels for k in keys})
    wanted = {name: PERCENTILES[name] for name in percentiles}
    rows, out = settle(df.select(*used, *([freq] if freq else []), *sorted({"price_per_m2", *(c for c, _ in wanted.values())}))), None
    number, mean = (F.sum(freq), F.sum(F.col(freq) * F.col("price_per_m2")) / F.sum(F.when(F.col("price_per_m2").isNotNull(), F.col(freq)))) if freq else (F.count("*"), F.avg("price_per_m2"))
    stats = [c for c in ("n_listings", "median_price_m2", "p25_price_m2", "p75_price_m2", "mean_price_m2", "median_area", "median_price") if c in (*wanted, "n_listings", "mean_price_m2")]
    for level, keys in zip(LEVELS, sets, strict=True):
        if level not in levels:
            continue
        sizes = [number.alias("n_listings"), F.round(mean, 6).alias("mean_price_m2")]
        found = group_values(rows.where(F.col(keys[0]).isNotNull()), keys, wanted, sizes, freq).where(F.col("n_listings") >= min_listings)
        parent = F.col(keys[2]) if len(keys) > 2 else F.lit(None).cast("string")
        found = found.select(F.lit(level).alias("level"), F.col(keys[0]).alias("code"), F.col(keys[1]).alias("name"), parent.alias("parent_code"), *stats)
        out = found if out is None else out.unionByName(found)
    return cut(out)


def red_book(column: str = "legal_status") -> Column:
    """1.0 for full title in any spelling, 0.0 for other states, null for none; the negated forms do not count."""
    full = F.coalesce(rank_of(F.col(column), LEGAL_RANKS) == FULL_TITLE, F.lit(False))
    return F.when(F.trim(column) != "", full.cast("double"))


def district_features(df: DataFrame, min_listings: int = MIN_LISTINGS) -> DataFrame:
    wide = F.when(F.col("access_road").isNotNull(), (F.col("access_road") >= WIDE_ROAD).cast("double"))
    rows = cut(df.where("district_code is not null").select("district_code", "district", "province_code", "price_per_m2", "area", "floors", red_book().alias("red"), wide.alias("wide")))
    means = {"mean_area": "area", "mean_floors": "floors", "pct_red_book": "red", "pct_mat_tien": "wide"}
    more = [F.count("*").alias("n_listings"), *(F.round(F.avg(c), 6).alias(name) for name, c in means.items())]
    out = group_values(rows, ["district_code", "district", "province_code"], {"median_price_m2": MEDIAN}, more).where(F.col("n_listings") >= min_listings)
    return cut(out.select("district_code", "district", "province_code", "n_listings", "median_price_m2", *means))


def market_summary(df: DataFrame) -> DataFrame:
    """Six figures in long form: key, value, text."""
    rows = cut(df.select("price_per_m2", "price", "area", "district_code", "province_code"))
    counts = rows.agg(F.count("*").cast("double").alias("total_listings"), F.countDistinct("district_code").cast("double").alias("n_districts"), F.countDistinct("province_code").cast("double").alias("n_provinces"))
    names = ("median_price_m2", "median_price", "median_area")
    medians = group_values(rows.withColumn("_one", F.lit(1)), ["_one"], {n: PERCENTILES[n] for n in names})
    one = counts.withColumn("_one", F.lit(1)).join(medians, "_one", "left").select("total_listings", *names, "n_districts", "n_provinces")
    long = one.unpivot([], one.columns, "key", "value")
    return long.select("key", F.round("value", 6).alias("value"), F.format_string("%.2f", "value").alias("text"))


def distinct_areas(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count("district_code").alias("n_districts"), count("province_code").alias("n_provinces"), count("ward_code").alias("n_wards"))


def top_districts(areas: DataFrame, limit: int = 10) -> DataFrame:
    return areas.where("level = 'district'").orderBy(F.desc("median_price_m2"), "code").limit(limit)


def with_details(top: DataFrame, areas: DataFrame, level: str = "district") -> DataFrame:
    """A ranking (its column code and others) with the name and median price of each area."""
    return top.join(areas.where(F.col("level") == level).select("code", "name", "median_price_m2"), "code")


def area_list(areas: DataFrame, level: str, parent: str | None = None) -> DataFrame:
    found = areas.where(F.col("level") == level)
    if parent is not None:
        found = found.where(F.col("parent_code") == parent)
    return found.orderBy(F.col("median_price_m2").desc_nulls_last(), "code")


def clamp(limit: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, limit))


def top_anomalies(scores: DataFrame, limit: int = 50) -> DataFrame:
    return scores.orderBy(F.desc("score"), "listing_id").limit(clamp(limit, 1, 500))


def hottest(velocity: DataFrame, limit: int = 10) -> DataFrame:
    return velocity.orderBy(F.desc("n"), "district").limit(clamp(limit, 1, 100))


def newest_alerts(alerts: DataFrame, limit: int = 200) -> DataFrame:
    return alerts.orderBy(F.desc("event_time"), "event_id").limit(limit)


def longest_series(series: DataFrame) -> DataFrame:
    return series.groupBy("area_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area_code").limit(1)


def class_breaks(df: DataFrame, column: str, n: int = 6) -> DataFrame:
    """idx 0..n and the value at position floor(idx / n * (count - 1)) of the sorted non-null values.

    Two aggregations over one row per area: the count, then exact percentiles at those positions.
    """
    count = df.agg(F.count(column)).first()[0]
    places = [math.floor(i / n * (count - 1)) / max(1, count - 1) if count else 0.0 for i in range(n + 1)]
    values = df.agg(F.percentile(column, F.array(*map(F.lit, places))).alias("v"))
    return values.select(F.posexplode("v").alias("idx", "value")).where("value is not null")


def assign_class(df: DataFrame, breaks: DataFrame, column: str) -> DataFrame:
    """class 1..n by the breaks that the value exceeds or equals; null: no data, class 0."""
    bounds = [r.value for r in breaks.orderBy("idx").collect()]  # n + 1 values
    found = F.lit(0)
    if bounds:
        found = sum((F.col(column) >= b).cast("int") for b in bounds[1:-1]) + F.lit(1)
    return df.withColumn("class", F.coalesce(found, F.lit(0)).cast("int"))


def reconcile_codes(ref: DataFrame, other: DataFrame, warn: float = 0.95) -> DataFrame:
    """One row: codes of either side, in both, the share of ref's that match, missing examples."""
    a, b = ref.select("code").distinct().withColumn("in_ref", F.lit(1)), other.select("code").distinct().withColumn("in_other", F.lit(1))
    both = a.join(b, "code", "full")
    missing = F.when(F.col("in_other").isNull(), F.col("code"))
    out = both.agg(F.count("in_ref").alias("n_ref"), F.count("in_other").alias("n_other"), F.count_if(F.expr("in_ref = 1 and in_other = 1")).alias("n_both"), F.min(missing).alias("first_missing"))
    return out.withColumn("match", F.round(F.try_divide("n_both", "n_ref"), 6)).withColumn("low", F.coalesce(F.col("match") < warn, F.lit(False)))
