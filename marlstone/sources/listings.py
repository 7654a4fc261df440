"""Sources of listings: logs, CSV files, API records and pages, brought to the canonical columns."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text as tx
from marlstone.functions.listing import is_usable, listing_id, unit_price
from marlstone.operators.quantiles import group_percentile
from marlstone.session import cut
from marlstone.sources.ledger import Ledger
from marlstone.sources.offset_log import Offsets, between, to_json

STRINGS = ("listing_id", "source", "crawled_at", "posted_at", "url", "address_raw", "province_raw", "district_raw", "ward_raw")
CANONICAL = (
    *((n, "string") for n in STRINGS), *((n, "double") for n in ("area", "frontage", "access_road")), ("house_direction", "string"), ("balcony_direction", "string"),
    *((n, "double") for n in ("floors", "bedrooms", "bathrooms")), *((n, "string") for n in ("legal_status", "furniture_state", "property_type")), ("price", "double"), ("price_per_m2", "double"),
)
LISTING_SCHEMA = T.StructType([T.StructField(n, T.StringType() if k == "string" else T.DoubleType()) for n, k in CANONICAL])
LOG_COLUMNS = ("topic", "partition", "offset")

# The names under which sources have the canonical fields.
ALIASES = {
    "address_raw": ["address", "dia chi", "diachi", "location", "full address"],
    "area": ["area", "dien tich", "acreage", "size", "area m2", "square"],
    "frontage": ["frontage", "mat tien", "facade", "width"],
    "access_road": ["access road", "duong vao", "road width", "access road width"],
    "house_direction": ["house direction", "huong nha", "direction"],
    "balcony_direction": ["balcony direction", "huong ban cong"],
    "floors": ["floors", "so tang", "number of floors", "n floors", "storeys"],
    "bedrooms": ["bedrooms", "so phong ngu", "n bedrooms", "bedroom", "rooms"],
    "bathrooms": ["bathrooms", "so toilet", "n bathrooms", "bathroom", "toilets", "wc"],
    "legal_status": ["legal status", "phap ly", "legal", "legal document"],
    "furniture_state": ["furniture state", "noi that", "furniture", "interior"],
    "property_type": ["property type", "loai bds", "loai hinh", "type", "house type"],
    "price": ["price", "gia", "gia ban", "price bil", "price billion"],
}
NUMBERS = {"area", "frontage", "access_road", "floors", "bedrooms", "bathrooms", "price"}


BROKER = r"[\w.,-]+:\d+"


def read_log(spark: SparkSession, source: str, start: Offsets | None = None, end: Offsets | None = None, topic: str = "listings") -> DataFrame:
    """A bounded read of a log: of a broker if source is host:port, else of a folder of Parquet rows with the same columns.

    start, end: offsets by topic and partition, an end is not included; by default all there is.
    Of a folder Spark scans the row groups whose statistics meet the offsets.
    """
    if re.fullmatch(BROKER, source):
        options = {"kafka.bootstrap.servers": source, "subscribe": topic, "startingOffsets": to_json(start) if start else "earliest", "endingOffsets": to_json(end) if end else "latest"}
        return spark.read.format("kafka").options(**options).load()
    return between(spark.read.parquet(source), start or {}, end)


def decoded(log: DataFrame, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """The log's rows with the struct d (null fields where the value is not such JSON), as a table or a stream."""
    return log.withColumn("d", F.from_json(F.col("value").cast("string"), schema)).withColumnRenamed("timestamp", "kafka_timestamp")


def good_events(rows: DataFrame) -> DataFrame:
    """Decoded rows that have a listing_id, with the fields as columns and the log's position."""
    return rows.where("d.listing_id is not null").select("d.*", *(c for c in (*LOG_COLUMNS, "kafka_timestamp") if c in rows.columns))


def decode_events(log: DataFrame, schema: T.StructType = LISTING_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Good rows with the decoded columns, and bad ones without a listing_id; either keeps the log's position."""
    rows = decoded(log, schema)
    return good_events(rows), rows.where("d.listing_id is null").select("value", *LOG_COLUMNS, "kafka_timestamp")


def stamp(df: DataFrame, now: datetime) -> DataFrame:
    return df.withColumns({"ingested_at": F.lit(now), "ingest_date": F.to_date(F.lit(now))})


def new_offsets(log: DataFrame) -> tuple[Offsets, Offsets]:
    """For each topic and partition of the log's rows the first offset, and the one behind the last."""
    rows = log.groupBy("topic", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last")).collect()  # a row for each partition
    return {(r.topic, r.partition): r.first for r in rows}, {(r.topic, r.partition): r.last + 1 for r in rows}


def bronze_table(spark: SparkSession, path: str) -> DataFrame:
    """The batches of the bronze table that are closed."""
    rows, left = spark.read.parquet(path), Ledger(spark, path).open_batch()
    return rows.where(F.col("batch").cast("long") != left.number) if left else rows


def normal_key(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", name.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Canonical field -> the source's column: the first alias that the source has."""
    have: dict[str, str] = {}
    for c in columns:
        have.setdefault(normal_key(c), c)
    found = {field: next((have[a] for a in aliases if a in have), None) for field, aliases in ALIASES.items()}
    return {k: v for k, v in found.items() if v is not None}


def canonical_select(df: DataFrame, colmap: dict[str, str] | None = None) -> DataFrame:
    """All 13 source fields, typed; a field that the source lacks is null."""
    colmap = resolve_columns(df.columns) if colmap is None else colmap
    out = []
    for field in ALIASES:
        c = F.col(f"`{colmap[field]}`").cast("string") if field in colmap else F.lit(None).cast("string")
        out.append((tx.to_number(c) if field in NUMBERS else tx.to_text(c)).alias(field))
    return df.select(*out)


def in_order(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(n).cast(k) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in CANONICAL))


def finalize(df: DataFrame, now: str) -> DataFrame:
    """Fill the unit price, and the crawl time of sources that are crawled."""
    crawled = F.coalesce("crawled_at", F.when(F.col("source") != "kaggle", F.lit(now)))
    return df.withColumns({"price_per_m2": F.coalesce("price_per_m2", unit_price(F.col("price"), F.col("area"))), "crawled_at": crawled})


def from_tabular(df: DataFrame, colmap: dict[str, str] | None = None, source: str = "kaggle", now: str = "") -> DataFrame:
    """CSV rows to canonical ones. Equal rows are told apart by their number among equals."""
    rows = canonical_select(df, colmap).withColumns({"source": F.lit(source), "crawled_at": F.lit(None).cast("string"), "price_per_m2": F.lit(None).cast("double")})
    copy = F.row_number().over(Window.partitionBy(*ALIASES).orderBy(F.lit(0)))
    rows = rows.withColumn("_copy", copy)
    return in_order(finalize(rows.withColumn("listing_id", listing_id(source, F.col("address_raw"), F.col("area"), F.col("price"), F.xxhash64(*ALIASES), F.col("_copy"))), now))


def from_api(df: DataFrame, now: str, source: str = "api", base: str = "") -> DataFrame:
    """API records to canonical rows: prices come in VND."""
    place = F.concat_ws(", ", *(tx.to_text(F.col(c)) for c in ("ward_name", "area_name", "region_name")))
    rows = df.select(
        F.concat(F.lit(f"{source}_"), F.col("list_id").cast("string")).alias("listing_id"), F.lit(source).alias("source"), F.concat(F.lit(base), F.col("list_id").cast("string")).alias("url"),
        F.coalesce(F.nullif(place, F.lit("")), tx.to_text(F.col("address"))).alias("address_raw"), F.col("region_name").alias("province_raw"), F.col("area_name").alias("district_raw"),
        F.col("ward_name").alias("ward_raw"), F.col("size").cast("double").alias("area"), F.col("property_width").cast("double").alias("frontage"), F.col("property_road_width").cast("double").alias("access_road"),
        F.col("direction").cast("string").alias("house_direction"), F.col("floors").cast("double"), F.col("rooms").cast("double").alias("bedrooms"), F.col("toilets").cast("double").alias("bathrooms"),
        F.col("property_legal_document").cast("string").alias("legal_status"), F.col("furnishing_status").cast("string").alias("furniture_state"), F.round(F.col("price") / 1e9, 6).alias("price"),
        F.lit(None).cast("double").alias("price_per_m2"), F.lit(None).cast("string").alias("crawled_at"),
    )
    return in_order(finalize(rows, now))


def to_events(df: DataFrame) -> DataFrame:
    """Canonical rows as log records: key, value."""
    return df.select(F.col("listing_id").alias("key"), F.to_json(F.struct(*(n for n, _ in CANONICAL))).alias("value"))


def alias_coverage(df: DataFrame) -> DataFrame:
    """field, column, n_null: the source's column of each canonical field (null if it has none), and its rows without a value."""
    found, rows = resolve_columns(df.columns), canonical_select(df)
    counts = rows.agg(F.count("*").alias("_n"), *(F.count(f).alias(f) for f in ALIASES))
    parts = ", ".join(f"'{f}', {chr(39) + found[f].replace(chr(39), chr(92) + chr(39)) + chr(39) if f in found else 'cast(null as string)'}, _n - {f}" for f in ALIASES)
    return counts.selectExpr(f"stack({len(ALIASES)}, {parts}) as (field, column, n_null)")


def replay_csv(spark: SparkSession, path: str, limit: int = 0, source: str = "kaggle", now: str = "") -> tuple[DataFrame, DataFrame]:
    """Usable rows of a CSV file as log records (key, value), and one row: n_read, n_usable. limit: rows read, 0 for all."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = resolve_columns(rows.columns)
    if "price" not in found or "area" not in found:
        raise ValueError("the file has no column of prices or areas")
    listings = from_tabular(rows.limit(limit) if limit else rows, found, source, now).withColumn("_ok", is_usable())
    return to_events(listings.where("_ok")), listings.agg(F.count("*").alias("n_read"), F.count_if("_ok").alias("n_usable"))


def write_log(events: DataFrame, target: str, topic: str = "listings") -> None:
    """Log records to a topic of a broker (host:port), or appended to a folder of Parquet rows with the log's columns.

    A folder's new records go on behind the last offset of their partition, without gaps. One
    writer at a time.
    """
    if re.fullmatch(BROKER, target):
        events.write.format("kafka").option("kafka.bootstrap.servers", target).option("topic", topic).save()
        return
    spark = events.sparkSession
    try:
        before = spark.read.parquet(target).where(F.col("topic") == topic).groupBy("partition").agg((F.max("offset") + 1).alias("_next"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = spark.createDataFrame([], "partition int, _next long")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its partition
    placed = events.withColumns({"topic": F.lit(topic), "partition": F.spark_partition_id(), "offset": number, "timestamp": F.current_timestamp()})
    # the sums are read before the append begins
    placed = placed.join(F.broadcast(cut(before)), "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("_next", F.lit(0)))
    placed.select(*events.columns, "topic", "partition", "offset", "timestamp").write.mode("append").parquet(target)


def profile(df: DataFrame, columns: tuple[str, ...] = ("area", "price")) -> DataFrame:
    """field, n_null, min, median, max of each numeric column; no task holds a column's values."""
    # settled: each pass of the percentiles reads the rows
    rows = cut(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    long = rows.unpivot([], list(columns), "field", "value")
    out = long.groupBy("field").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = group_percentile(long, ["field"], "value", name="median").drop("n")
    empty = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")  # also of an empty table
    return empty.join(out, "field", "left").join(medians, "field", "left").select("field", F.coalesce("n_null", F.lit(0)).alias("n_null"), "min", "median", "max")


# Pages -----------------------------------------------------------------------------------

ANCHOR = r'<a\b[^>]*itemprop="url"[^>]*>'


def explode_blocks(pages: DataFrame, anchor: str = ANCHOR, html: str = "html") -> DataFrame:
    """page_id, pos, block: one block from each such anchor to the next; what precedes the first goes."""
    parts = F.split(F.col(html), f"(?={anchor})")
    return pages.select("page_id", F.posexplode(parts).alias("pos", "block")).where(F.col("block").rlike(f"^{anchor}"))


def prop(block: Column, name: str, of: str = "content") -> Column:
    """An attribute of the element with this itemprop, or its text if of is text."""
    if of == "text":
        found = F.nullif(tx.html_text(F.regexp_extract(block, rf'(?s)itemprop="{name}"[^>]*>(.{{0,400}}?)</', 1)), F.lit(""))
    else:
        found = F.nullif(F.regexp_extract(block, rf'itemprop="{name}"[^>]{{0,200}}?\b{of}="([^"]*)"', 1), F.lit(""))
    return F.when(F.contains(block, F.lit(f'itemprop="{name}"')), found)


def posted_date(block: Column) -> Column:
    """The first that is there: an ISO date in microdata, a day-first one, a day-first one by class; never the crawl date."""
    iso = F.regexp_extract(block, r'itemprop="datePosted"[^>]{0,200}?(?:content|datetime)="(\d{4}-\d{2}-\d{2})', 1)
    micro = F.regexp_extract(block, r'(?s)itemprop="datePosted"[^>]{0,200}>\D{0,40}?(\d{1,2}/\d{1,2}/\d{4})', 1)
    classed = F.regexp_extract(block, r'(?s)class="[^"]*date[^"]*"[^>]{0,200}>\D{0,80}?(\d{1,2}/\d{1,2}/\d{4})', 1)
    # a text that is not there is not parsed: each failure is dear
    has, date = F.contains(block, F.lit('itemprop="datePosted"')), lambda text, form: F.try_to_date(F.nullif(text, F.lit("")), form)
    return F.coalesce(F.when(has, date(iso, "yyyy-MM-dd")), F.when(has, date(micro, "d/M/yyyy")), F.when(F.contains(block, F.lit('class="')), date(classed, "d/M/yyyy")))


def listing_fields(blocks: DataFrame, source: str = "site") -> DataFrame:
    """A block's microdata as a listing; blocks without a price or an area go."""
    b = F.col("block")
    url = F.regexp_extract(b, r'^<a\b[^>]*href="([^"]*)"', 1)
    tail = F.nullif(F.regexp_extract(url, r"-(\d{6,})\.html", 1), F.lit(""))
    number = lambda name: tx.first_number(F.coalesce(prop(b, name), prop(b, name, "text")))
    # as one generated row: the filter below then does not read the block a second time
    rows = blocks.select("page_id", "pos", F.inline(F.array(F.struct(
        url.alias("url"), listing_id(source, F.coalesce(tail, url)).alias("listing_id"), F.round(prop(b, "price").try_cast("double") / 1e9, 6).alias("price"),
        number("floorSize").alias("area"), number("numberOfBedrooms").alias("bedrooms"), number("numberOfFloors").alias("floors"), number("streetWidth").alias("access_road"),
        prop(b, "address", "text").alias("address_raw"), posted_date(b).alias("posted_on"),
    ))))
    return rows.where("price is not null and area is not null").withColumn("price_per_m2", unit_price(F.col("price"), F.col("area")))


# Labels of the detail table and the fields that they stand for.
DETAIL_LABELS = {
    "huong": "house_direction", "huong ban cong": "balcony_direction", "duong truoc nha": "access_road", "phap ly": "legal_status", "so lau": "floors", "so phong ngu": "bedrooms",
    "so toilet": "bathrooms", "chieu ngang": "frontage", "loai bds": "property_type",
}


def detail_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and nine fields of the label/value table of a detail page."""
    cell = lambda k: F.regexp_extract_all(F.col(html), F.lit(r"(?s)<td[^>]*>([^<]{1,80}?):?\s*</td>\s*<td[^>]*>(.{0,400}?)</td>"), F.lit(k))
    pairs = pages.select("page_id", F.inline(F.arrays_zip(cell(1).alias("label"), cell(2).alias("value"))))
    named = pairs.select("page_id", tx.norm_text(F.col("label")).alias("label"), tx.clean(tx.html_text(F.col("value"))).alias("value"))
    out = [F.max(F.when(F.col("label") == label, F.col("value"))).alias(field) for label, field in DETAIL_LABELS.items()]
    wide = named.groupBy("page_id").agg(*out)
    return wide.withColumns({f: tx.first_number(F.col(f)) for f in ("access_road", "floors", "bedrooms", "bathrooms", "frontage")})


def first_seen(df: DataFrame) -> DataFrame:
    """The first occurrence of each listing in the order of pages and positions."""
    rank = F.row_number().over(Window.partitionBy("listing_id").orderBy("page_id", "pos"))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
