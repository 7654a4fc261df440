"""Price series: periods, resampling, version priorities, dates of either convention, backtests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.quantiles import group_percentile
from marlstone.session import cut

MIN_PERIOD, MIN_POINTS = 5, 12
# The codes of numbered districts; two of them are parts of a merged one.
WIDE_CODES = {1: "760", 2: "769_Q2", 3: "770", 4: "773", 5: "774", 6: "775", 7: "778", 8: "776", 9: "769_Q9"}
# Names of the two, and the area of a series that names none.
WIDE_NAMES = {2: "Quận 2 (nay thuộc TP Thủ Đức)", 9: "Quận 9 (nay thuộc TP Thủ Đức)"}
DEFAULT_AREA = "TP. Hồ Chí Minh"
#: A column of a numbered district, by its name in lower case without accents.
WIDE_COLUMN = r"^\s*(?:district|quan|q)\s*[._-]?\s*(\d{1,2})\s*$"
# What the names of date, price and area columns contain, the first one first.
DATE_NAMES = ("date", "thang", "month", "time", "period", "ngay", "quarter")
PRICE_NAMES = ("price", "gia", "value", "index")
AREA_NAMES = ("district", "quan", "area_name", "region", "location")


def period_median(df: DataFrame, freq: str = "month", min_n: int = MIN_PERIOD, time: str = "posted_at") -> DataFrame:
    """area_code, ds, price_m2, n of each district and of the country (VN); no task holds a large group's prices."""
    rows = df.where("district_code is not null").withColumn("ds", F.to_date(F.date_trunc(freq, F.col(time))))
    rows = cut(rows.select(F.col("district_code").alias("area_code"), "ds", "price_per_m2"))
    medians = [group_percentile(r, ["area_code", "ds"], "price_per_m2", name="price_m2") for r in (rows, rows.withColumn("area_code", F.lit("VN")))]
    counts = [r.groupBy("area_code", "ds").agg(F.count("*").alias("n")) for r in (rows, rows.withColumn("area_code", F.lit("VN")))]
    out = [c.where(F.col("n") >= min_n).join(m.drop("n"), ["area_code", "ds"], "left") for c, m in zip(counts, medians, strict=True)]
    return out[0].unionByName(out[1]).select("area_code", "ds", "price_m2", "n")


def gaps(series: DataFrame) -> DataFrame:
    """area_code, n, gap: the median number of days between points."""
    lag = F.lag("ds").over(Window.partitionBy("area_code").orderBy("ds"))
    return series.withColumn("_gap", F.datediff("ds", lag)).groupBy("area_code").agg(F.count("*").alias("n"), F.percentile("_gap", F.lit(0.5)).alias("gap"))


def infer_freq(series: DataFrame) -> DataFrame:
    """area_code, freq: D up to 2 days, W up to 10, else MS."""
    return gaps(series).select("area_code", F.when(F.col("gap") <= 2, "D").when(F.col("gap") <= 10, "W").otherwise("MS").alias("freq"))


def resample_month(series: DataFrame, most_gap: float = 2, least: int = 200) -> DataFrame:
    """Daily series to monthly medians; other series stay as they are."""
    daily = gaps(series).select("area_code", ((F.col("gap") <= most_gap) & (F.col("n") > least)).alias("daily"))
    ds = F.when(F.col("daily"), F.to_date(F.date_trunc("month", "ds"))).otherwise(F.col("ds"))
    return series.join(daily, "area_code").select("area_code", ds.alias("ds"), "price_m2").groupBy("area_code", "ds").agg(F.percentile("price_m2", F.lit(0.5)).alias("price_m2"))


def cuts(series: DataFrame, h: int = 3, max_folds: int = 24, spread: bool = True) -> DataFrame:
    """area_code, cut: how many points each fold trains on. spread: over the whole series, else by whole steps."""
    n = F.col("n")
    low = F.greatest(F.lit(8), F.lit(2 * h), F.floor(n * 0.3)).cast("int")
    count = n - h - low + 1
    sized = series.groupBy("area_code").agg(F.count("*").alias("n")).where(count > 0)
    if spread:
        folds = F.transform(F.sequence(F.lit(0), F.least(count, F.lit(max_folds)) - 1), lambda i: low + F.floor(i * count / F.least(count, F.lit(max_folds))))
    else:
        step = F.greatest(F.lit(1), F.floor(count / max_folds))
        folds = F.slice(F.filter(F.sequence(low, (n - h).cast("int")), lambda x: (x - low) % step == 0), 1, max_folds)
    return sized.select("area_code", F.explode(folds.cast("array<int>")).alias("cut"))


def numbered(series: DataFrame) -> DataFrame:
    return series.withColumn("i", F.row_number().over(Window.partitionBy("area_code").orderBy("ds")))


def naive_backtest(series: DataFrame, h: int = 3, max_folds: int = 24, spread: bool = True) -> DataFrame:
    """area_code, cut, step, y, yhat: the last value before each cut, repeated."""
    points = numbered(series).select("area_code", "i", F.col("price_m2").alias("y"))
    folds = cuts(series, h, max_folds, spread)
    last = folds.join(points, "area_code").where("i = cut").select("area_code", "cut", F.col("y").alias("yhat"))
    return last.join(points, "area_code").where((F.col("i") > F.col("cut")) & (F.col("i") <= F.col("cut") + h)).select("area_code", "cut", (F.col("i") - F.col("cut")).alias("step"), "y", "yhat")


def errors(tests: DataFrame, keys: Sequence[str] = ("area_code", "cut")) -> DataFrame:
    """MAPE, RMSE and MAE of each fold."""
    e = F.col("yhat") - F.col("y")
    return tests.groupBy(*keys).agg(F.avg(F.abs(e / F.nullif("y", F.lit(0.0)))).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).withColumn("mape", F.col("mape") * 100)


def backtest_summary(folds: DataFrame, keys: Sequence[str] = ("area_code",)) -> DataFrame:
    out = [F.count("*").alias("folds")]
    for c in ("mape", "rmse", "mae"):
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std")]
    return folds.groupBy(*keys).agg(*out)


def winners(summary: DataFrame) -> DataFrame:
    """area_code, model: the model with the least mean MAPE, by name among equals; and whether it beats the naive one."""
    best = F.min(F.struct("mape_mean", "model")).alias("b")
    naive = F.min(F.when(F.col("model") == "naive", F.col("mape_mean"))).alias("naive")
    return summary.groupBy("area_code").agg(best, naive).select("area_code", "b.model", "b.mape_mean", (F.col("b.mape_mean") < F.col("naive")).alias("beats_naive"))


def future_dates(series: DataFrame, h: int = 3) -> DataFrame:
    """area_code, step, ds of the h periods after each series' end."""
    last = series.groupBy("area_code").agg(F.max("ds").alias("last"))
    steps = last.join(infer_freq(series), "area_code").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    ds = F.when(F.col("freq") == "D", F.date_add("last", F.col("step"))).when(F.col("freq") == "W", F.date_add("last", F.col("step") * 7)).otherwise(F.add_months("last", F.col("step")))
    return steps.select("area_code", "step", ds.alias("ds"))


def naive_forecast(series: DataFrame, h: int = 3) -> DataFrame:
    last = series.groupBy("area_code").agg(F.max_by("price_m2", "ds").alias("yhat"))
    return future_dates(series, h).join(last, "area_code")


def series_catalogue(series: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    return series.groupBy("source", "area_code").agg(F.count("*").alias("n")).withColumn("trainable", F.col("n") >= least)


# Files of series -------------------------------------------------------------------------


def one_version(rows: DataFrame, key: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*priority))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_date(c: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in formats))


YEAR_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy-M", "yyyy-MM-dd HH:mm:ss")


def month_first(c: Column) -> Column:
    return read_date(c, ("M/d/yyyy", "M-d-yyyy", *YEAR_FIRST))


def day_first(c: Column) -> Column:
    return read_date(c, ("d/M/yyyy", "d-M-yyyy", *YEAR_FIRST))


def parse_dates(df: DataFrame, column: str, name: str = "ds") -> DataFrame:
    """The column read as month-first and as day-first dates; whichever reads more rows (month-first if equal)."""
    month, day = month_first(F.col(column)), day_first(F.col(column))
    n = df.agg(F.count(month).alias("m"), F.count(day).alias("d")).first()
    return df.withColumn(name, month if n.m >= n.d else day)


def is_series(df: DataFrame, column: str, share: float = 0.8, least: int = 3) -> bool:
    r = parse_dates(df, column).agg(F.count("*").alias("n"), F.count("ds").alias("k"), F.countDistinct("ds").alias("d")).first()
    return r.n > 0 and r.k >= share * r.n and r.d >= least


def plain_name(c: Column) -> Column:
    return F.lower(tx.strip_accents(F.trim(c)))


def wide_number(c: Column) -> Column:
    """The number of the district that a column is named after; null if it is none."""
    return F.nullif(F.regexp_extract(plain_name(c), WIDE_COLUMN, 1), F.lit("")).cast("int")


def wide_area(number: Column) -> tuple[Column, Column]:
    """Code and name of a numbered district."""
    of = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), number)
    text = number.cast("string")
    return F.coalesce(of(WIDE_CODES), F.concat(F.lit("HCM_D"), text)), F.coalesce(of(WIDE_NAMES), F.concat(F.lit("Quận "), text))


def area_code(name: Column) -> Column:
    return F.concat(F.lit("HCM_"), F.regexp_replace(name, r"(?U)\W+", ""))


def price_of(c: Column) -> Column:
    return tx.to_number(F.regexp_replace(c.cast("string"), r"[^\d.,-]", ""))


def wide_to_long(df: DataFrame, date: str, source: str) -> DataFrame:
    """Columns named after numbered districts to rows: area_code, area_name, ds, price_m2, source."""
    found = [c for c in df.columns if re.match(WIDE_COLUMN, plain_header(c))]
    if len(found) < 2:
        raise ValueError("not a wide table of districts")
    values = [tx.to_number(F.col(f"`{c}`").cast("string")).alias(c) for c in found]
    long = parse_dates(df, date).select("ds", *values).unpivot(["ds"], found, "column", "price_m2")
    code, name = wide_area(wide_number(F.col("column")))
    return long.where("ds is not null and price_m2 is not null").select(code.alias("area_code"), name.alias("area_name"), "ds", "price_m2", F.lit(source).alias("source"))


def plain_header(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn").lower()


def long_series(df: DataFrame, date: str, price: str, area: str | None, source: str, default: str = DEFAULT_AREA) -> DataFrame:
    name = F.coalesce(tx.to_text(F.col(area)), F.lit(default)) if area else F.lit(default)
    rows = parse_dates(df, date).withColumns({"area_name": name, "area_code": area_code(name), "price_m2": price_of(F.col(price)), "source": F.lit(source)})
    return rows.where("ds is not null and price_m2 is not null").select("area_code", "area_name", "ds", "price_m2", "source")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A manual index of four columns; None if the file has others."""
    df = spark.read.option("header", True).csv(path)
    if set(df.columns) != {"area_code", "area_name", "ds", "price_m2"}:
        return None
    rows = parse_dates(df, "ds").select("area_code", "area_name", "ds", tx.to_number(F.col("price_m2")).alias("price_m2"), F.lit("bds_index").alias("source"))
    return rows.where("ds is not null and price_m2 is not null")


def csv_fields(line: Column) -> Column:
    """The fields of a line of CSV; quoted ones may hold commas and doubled quotes."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda x: F.replace(F.regexp_replace(F.trim(x), r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def column_with(names: Column, words: Sequence[str]) -> Column:
    """The first column, from 1, whose name contains the first of the words that any name contains; null without one."""
    first = lambda w: F.nullif(F.array_position(F.transform(names, lambda x: F.contains(x, F.lit(w))), F.lit(True)), F.lit(0))
    return F.coalesce(*(first(w) for w in words))


def series_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all CSV files of a folder but those named sample*, with what their headers say: one plan, whatever the number of files.

    file, size, at (the line's place), fields, date, and from the header: wide (each column's
    district number), date_at, price_at, area_at.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    lines = lines.where(~F.lower(F.element_at(F.split("file", "/"), -1)).startswith("sample") & (F.trim("value") != ""))
    headers = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("first"))
    names = F.transform(csv_fields(F.regexp_replace("header", "^\ufeff", "")), plain_name)
    headers = headers.select("file", "first", names.alias("names")).select(
        "file", "first", F.transform("names", wide_number).alias("wide"), column_with(F.col("names"), DATE_NAMES).alias("date_at"),
        column_with(F.col("names"), PRICE_NAMES).alias("price_at"), column_with(F.col("names"), AREA_NAMES).alias("area_at"),
    )
    rows = lines.join(headers, "file").where(F.col("at") != F.col("first")).withColumn("fields", csv_fields(F.col("value")))
    return rows.withColumn("date", F.try_element_at("fields", F.col("date_at").cast("int"))).drop("value", "first")


def series_files(rows: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """Of each file: file, size, n, kind (wide, long, or why it is none: no date, no dates, no price) and whether months come first. rows: of series_rows."""
    month, day = month_first(F.col("date")), day_first(F.col("date"))
    told = rows.groupBy("file").agg(
        F.max("size").alias("size"), F.count("*").alias("n"), F.count(month).alias("m"), F.count(day).alias("d"), F.count_distinct(month).alias("km"), F.count_distinct(day).alias("kd"),
        *(F.first(c).alias(c) for c in ("wide", "date_at", "price_at")),
    )
    by_month = F.col("m") >= F.col("d")
    read, kinds = F.greatest("m", "d"), F.when(by_month, F.col("km")).otherwise(F.col("kd"))
    kind = F.when(F.col("date_at").isNull(), "no date").when((read < share * F.col("n")) | (kinds < least), "no dates")
    kind = kind.when(F.size(F.filter("wide", lambda x: x.isNotNull())) > 1, "wide").when(F.col("price_at").isNull(), "no price").otherwise("long")
    return told.select("file", "size", "n", kind.alias("kind"), by_month.alias("by_month"))


def read_series_dir(spark: SparkSession, path: str, source: str = "kaggle") -> DataFrame:
    """All CSV files of series in a folder: area_code, area_name, ds, price_m2, source.

    Files are told by their content: a column of dates, and either columns of numbered districts or
    one of prices. Of equal (area, date) the row of the largest file stays. series_files says what
    was taken of each file and why others were not.
    """
    rows = series_rows(spark, path)
    kept = rows.join(series_files(rows).where("kind in ('wide', 'long')").select("file", "kind", "by_month"), "file")
    at = lambda c: F.try_element_at("fields", F.col(c).cast("int"))
    cell = lambda number, area, price: F.struct(number.cast("int").alias("number"), area.cast("string").alias("area"), price.cast("string").alias("price"))
    wide = F.filter(F.transform(F.arrays_zip("wide", "fields"), lambda x: cell(x["wide"], F.lit(None), x["fields"])), lambda x: x["number"].isNotNull())
    name = F.coalesce(tx.to_text(at("area_at")), F.lit(DEFAULT_AREA))
    cells = F.when(F.col("kind") == "wide", wide).otherwise(F.array(cell(F.lit(None), name, at("price_at"))))
    ds = F.when(F.col("by_month"), month_first(F.col("date"))).otherwise(day_first(F.col("date")))
    long = kept.select("file", "size", "at", "kind", ds.alias("ds"), F.explode(cells).alias("c"))
    code, wide_name = wide_area(F.col("c.number"))
    is_wide = F.col("kind") == "wide"
    long = long.select(
        F.when(is_wide, code).otherwise(area_code(F.col("c.area"))).alias("area_code"), F.when(is_wide, wide_name).otherwise(F.col("c.area")).alias("area_name"), "ds",
        F.when(is_wide, tx.to_number(F.col("c.price"))).otherwise(price_of(F.col("c.price"))).alias("price_m2"), F.lit(source).alias("source"), "size", "file", "at",
    )
    long = long.where("ds is not null and price_m2 is not null")
    return one_version(long, ["area_code", "ds"], [F.desc("size"), F.asc("file"), F.asc("at")]).drop("size", "file", "at")
