"""The driver's star schema seen as listings, and the same view as SQL for oracles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.lake import latest_per_key, physical_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(column: str, width: int):
    return F.lpad(F.col(column).cast("string"), width, "0")


LEGAL = {"R": "No certificate", "A": "Have certificate", "N": "Sale contract"}
FURNITURE = {"O": "Full", "F": "Basic"}


def _named(column: str, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


#: Numbers that tell the versions of a listing from other listings, as listing_id does.
NUMBERS = ["l_orderkey", "l_linenumber"]


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its dimensions: what tells and ranks its versions, and the tables' columns that a listing is made of.

    The dimensions are the star schema's own; Spark broadcasts those that are small. Orders come
    last: rows then lie by order, as the versions of a listing must.
    """
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        *NUMBERS, "r_regionkey", "r_name", "n_nationkey", "n_name", "s_suppkey", "s_name", "l_tax", "l_returnflag", "l_linestatus", "p_type", "o_orderdate",
        F.col("l_quantity").cast("double").alias("area"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price_per_m2"),
        F.col("l_shipdate").alias("ingested_at"),
        F.col("l_partkey").alias("part_key"),
    )


def columns() -> dict[str, Column]:
    """A listing's columns, of those that priced line items have."""
    return {
        "listing_id": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "province_code": code("r_regionkey", 2),
        "province": F.col("r_name"),
        "district_code": code("n_nationkey", 3),
        "district": F.col("n_name"),
        "ward_code": code("s_suppkey", 5),
        "ward": F.col("s_name"),
        "area": F.col("area"),
        "price": F.col("price"),
        "price_per_m2": F.col("price_per_m2"),
        "access_road": F.round(F.col("l_tax") * 100, 4),
        "floors": F.col("l_linenumber").cast("double"),
        "legal_status": _named("l_returnflag", LEGAL),
        "furniture_state": _named("l_linestatus", FURNITURE),
        "property_type": F.col("p_type"),
        "posted_at": F.col("o_orderdate"),
        "ingested_at": F.col("ingested_at"),
        "part_key": F.col("part_key"),
    }


def listed(rows: DataFrame, names: Sequence[str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Priced line items, or groups of them, as listings: ids, codes and names are written out here, after what drops rows, sorts or counts them.

    names: the listing's columns to have, all by default; also: rows' own columns to keep.
    """
    made = columns()
    return rows.select(*also, *(made[n].alias(n) for n in names or made))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(priced(spark, sf_dir))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced line items in the physical range, the latest version of each."""
    tie = [F.desc("ingested_at"), F.asc("part_key"), F.asc("price")]
    return latest_per_key(physical_filter(priced(spark, sf_dir)), NUMBERS, tie)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in the physical range, the latest version of each."""
    return listed(latest(spark, sf_dir))


LISTINGS = """
listings AS (
  SELECT l_orderkey || '-' || l_linenumber AS listing_id,
         lpad(r_regionkey::VARCHAR, 2, '0') AS province_code, r_name AS province,
         lpad(n_nationkey::VARCHAR, 3, '0') AS district_code, n_name AS district,
         lpad(s_suppkey::VARCHAR, 5, '0') AS ward_code, s_name AS ward,
         l_quantity::DOUBLE AS area, l_extendedprice / 1000 AS price, l_extendedprice / l_quantity AS price_per_m2,
         round(l_tax * 100, 4) AS access_road, l_linenumber::DOUBLE AS floors,
         CASE l_returnflag WHEN 'R' THEN 'No certificate' WHEN 'A' THEN 'Have certificate' WHEN 'N' THEN 'Sale contract' END AS legal_status,
         CASE l_linestatus WHEN 'O' THEN 'Full' WHEN 'F' THEN 'Basic' END AS furniture_state,
         p_type AS property_type, o_orderdate AS posted_at, l_shipdate AS ingested_at, l_partkey AS part_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SILVER = (
    LISTINGS
    + """,
silver AS (
  SELECT * FROM listings WHERE area > 0 AND price > 0 AND price_per_m2 BETWEEN 1 AND 5000
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY ingested_at DESC, part_key, price) = 1)"""
)


def with_silver(body: str) -> str:
    return f"WITH {SILVER}\n{body}"


def with_listings(body: str) -> str:
    return f"WITH {LISTINGS}\n{body}"
