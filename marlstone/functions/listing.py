"""Column functions over listings: ids, unit prices, what is usable, when it happened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listing_id(source: str, *parts: Column) -> Column:
    """source_ and 16 hex digits of the parts' digest; a missing part counts as a word, not as nothing."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{source}_"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


def unit_price(price: Column, area: Column) -> Column:
    """Million per m2 from billion and m2, to four digits; null unless both are there and positive."""
    return F.when((price != 0) & (area > 0), F.round(price * 1000 / F.nullif(area, F.lit(0.0)), 4))


def is_usable() -> Column:
    """Sane area and price, and something to place the listing by."""
    placed = F.coalesce("address_raw", "district_raw").isNotNull()
    return F.coalesce(F.col("area").between(5, 10_000) & F.col("price").between(0.05, 1000) & placed, F.lit(False))


def event_time() -> Column:
    """When a listing was seen: never the arrival time if the crawl time is known."""
    return F.coalesce(F.try_to_timestamp("crawled_at"), F.col("kafka_timestamp"))
