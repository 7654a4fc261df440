"""The 20 features of a listing, and the level of its district learned out of fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.quantiles import LIMIT, group_percentile, sent
from marlstone.operators.scoring import whole_percentile
from marlstone.session import cut, settle

# Ranks of legal states and of furniture, by their normalised names.
LEGAL_RANKS = {
    "so do": 4, "so hong": 4, "sodo": 4, "sohong": 4, "so hong so do": 4, "have certificate": 4, "certificate": 4, "red book": 4, "pink book": 4,
    "giay to hop le": 3, "valid documents": 3,
    "hop dong mua ban": 2, "hdmb": 2, "sale contract": 2, "contract": 2,
    "dang cho so": 1, "cho so": 1, "waiting for certificate": 1,
    "giay to viet tay": 0, "chua so": 0, "no certificate": 0, "handwritten documents": 0,
}
FURNITURE_RANKS = {
    "cao cap": 3, "luxury": 3, "high end": 3,
    "day du": 2, "full": 2, "fully furnished": 2,
    "co ban": 1, "basic": 1, "partly": 1,
    "ban giao tho": 0, "khong noi that": 0, "nha tho": 0, "unfurnished": 0, "bare shell": 0, "none": 0,
}
# Compass names in degrees.
DIRECTIONS = {"bac": 0, "dong bac": 45, "dong": 90, "dong nam": 135, "nam": 180, "tay nam": 225, "tay": 270, "tay bac": 315}

GROUPS = {
    "size": ["log_area", "floors", "bedrooms", "bathrooms", "area_per_bedroom", "rooms_total"],
    "plot": ["frontage", "access_road", "frontage_ratio", "is_mat_tien", "is_wide_road"],
    "legal": ["legal_rank", "furniture_rank"],
    "direction": ["house_dir_sin", "house_dir_cos", "balcony_dir_sin", "balcony_dir_cos"],
    "location": ["district_level"],
    "interaction": ["level_x_log_area", "level_x_legal"],
}
FEATURES = [f for names in GROUPS.values() for f in names]
FOLDS = 5


def looked_up(c: Column, values: dict[str, float]) -> Column:
    """The value of a normalised name; null if it has none. Names that are written as the table has them are not normalised first.

    Normalising stands in a lambda, which is not generated into the row's method: with it the method
    is over 8,000 bytes long, and the JVM does not compile it.
    """
    table = F.create_map(*(F.lit(x) for name, value in values.items() for x in (name, float(value))))
    normalised = F.get(F.transform(F.array(c), lambda v: F.try_element_at(table, tx.norm_text(v))), F.lit(0))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.when(c.isNotNull(), normalised))


def rank_of(c: Column, table: dict[str, int]) -> Column:
    return looked_up(c, table)


def direction(c: Column) -> tuple[Column, Column]:
    """Sine and cosine of a compass name; null if it is none."""
    degrees = looked_up(c, DIRECTIONS)
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def target() -> Column:
    return F.ln("price_per_m2")


def inverse(c: Column, area: Column) -> Column:
    """A predicted logarithm of the unit price to a price in billion."""
    return F.exp(c) * area / 1000


def fold_of(ident: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(folds)).cast("int")


def encoding_table(df: DataFrame, key: str = "district_code", y: str = "y", freq: str | None = None) -> DataFrame:
    return group_percentile(df, [key], y, freq=freq, name="level").drop("n")


def overall(df: DataFrame, y: str = "y", freq: str | None = None) -> float | None:
    return whole_percentile(df, y, 0.5, freq)


def apply_encoding(df: DataFrame, table: DataFrame, default: float, key: str = "district_code", name: str = "district_level") -> DataFrame:
    """The table has one row per district, and is broadcast if these are few."""
    return df.join(sent(table.withColumnRenamed("level", "_level")), key, "left").withColumn(name, F.coalesce("_level", F.lit(default))).drop("_level")


def fold_counts(df: DataFrame, key: str = "district_code", y: str = "y", fold: str = "fold", folds: int = FOLDS, more: Sequence[str] = ()) -> DataFrame:
    """How often each district has a value: _all, and _own_0 and so on in each fold. Settled. more: columns that counted rows have in common, too."""
    own = [F.count_if(F.col(fold) == k).alias(f"_own_{k}") for k in range(folds)]
    return settle(df.where(F.col(y).isNotNull()).groupBy(key, y, *more).agg(F.count("*").alias("_all"), *own))


def oof_encoding(df: DataFrame, key: str = "district_code", y: str = "y", fold: str = "fold", folds: int = FOLDS, name: str = "district_level", counted: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """Each row's median of y in its district over the other folds; else the median of all rows.

    Values are counted by district and fold once; how often the other folds have one is all its
    rows less those of the own fold, and all rows' median is of the counts. df is read twice; settle it where it is dear to make.
    counted: df's fold_counts, if they are there, and default, the median of all rows.
    """
    counted = fold_counts(df, key, y, fold, folds) if counted is None else counted
    few = counted.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") <= LIMIT).select(key)
    levels = counted.join(few, key).groupBy(key).agg(*(F.percentile(y, F.lit(0.5), F.col("_all") - F.col(f"_own_{k}")).alias(str(k)) for k in range(folds)))
    table = levels.unpivot([key], [str(k) for k in range(folds)], "_fold", "_level").withColumn("_fold", F.col("_fold").cast("int"))
    many = counted.join(few, key, "left_anti").where(F.col(key).isNotNull())
    if not many.isEmpty():
        times = F.array(*(F.struct(F.lit(k).alias("_fold"), (F.col("_all") - F.col(f"_own_{k}")).alias("_f")) for k in range(folds)))
        spread = many.select(key, y, F.inline(times))
        table = table.unionByName(group_percentile(spread, [key, "_fold"], y, freq="_f", name="_level").select(key, "_fold", "_level"))
    out = df.join(sent(cut(table.withColumnRenamed("_fold", fold))), [key, fold], "left")
    default = overall(counted, y, "_all") if default is None else default
    return out.withColumn(name, F.coalesce("_level", F.lit(default))).drop("_level")


def ensure(df: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    missing = {n: F.lit(None).cast(kind) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def build_features(df: DataFrame) -> DataFrame:
    """df with the 20 features, in order, after its own columns. df has district_level already.

    A feature with the name of a source column replaces it.
    """
    df = ensure(df, ("area", "floors", "bedrooms", "bathrooms", "frontage", "access_road", "district_level"), "double")
    df = ensure(df, ("legal_status", "furniture_state", "house_direction", "balcony_direction"), "string")
    number = lambda n: F.col(n).cast("double")
    at_least = lambda n, least: F.when(F.col(n).isNotNull(), (F.col(n) >= least).cast("double"))
    house, balcony = direction(F.col("house_direction")), direction(F.col("balcony_direction"))
    legal, level, log_area = rank_of(F.col("legal_status"), LEGAL_RANKS), number("district_level"), F.log1p("area")
    made = {
        "log_area": log_area, "floors": number("floors"), "bedrooms": number("bedrooms"), "bathrooms": number("bathrooms"),
        "area_per_bedroom": F.col("area") / F.nullif(number("bedrooms"), F.lit(0.0)), "rooms_total": F.coalesce(number("bedrooms"), F.lit(0.0)) + F.coalesce(number("bathrooms"), F.lit(0.0)),
        "frontage": number("frontage"), "access_road": number("access_road"), "frontage_ratio": number("frontage") / F.nullif(F.sqrt("area"), F.lit(0.0)),
        "is_mat_tien": at_least("access_road", 4), "is_wide_road": at_least("access_road", 8), "legal_rank": legal, "furniture_rank": rank_of(F.col("furniture_state"), FURNITURE_RANKS),
        "house_dir_sin": house[0], "house_dir_cos": house[1], "balcony_dir_sin": balcony[0], "balcony_dir_cos": balcony[1],
        "district_level": level, "level_x_log_area": level * log_area, "level_x_legal": level * legal,
    }
    return df.select(*(c for c in df.columns if c not in made), *(made[f].alias(f) for f in FEATURES))


def dead_features(df: DataFrame, column: str, table: dict[str, int]) -> DataFrame:
    """One row: values that are not blank, hits in the table, whether the feature is dead, the most common values."""
    values = df.select(tx.to_text(F.col(column)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    top = ", ".join(r.v for r in values.orderBy(F.desc("n"), "v").limit(5).collect())
    sums = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.coalesce(F.sum(F.when(rank_of(F.col("v"), table).isNotNull(), F.col("n"))), F.lit(0)).alias("n_hits"))
    return sums.withColumns({"dead": (F.col("n_values") > 0) & (F.col("n_hits") == 0), "top": F.lit(top)})
