"""Exact percentiles of groups of any size, all groups at once.

Small groups take Spark's percentile. Of a group with more than LIMIT rows no task holds the values:
they are counted in BINS bins between the least and the greatest, the bin that holds the rank
is cut into bins again, and so on until its values are one or few. A pass is one aggregation with
at most BINS rows a group and rank after the combination in map tasks, so a group with a third of
all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut

LIMIT, BINS, BROADCAST = 100_000, 256, 50_000


def group_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.5, freq: str | None = None, limit: int = LIMIT, name: str = "percentile") -> DataFrame:
    """keys, n (values that are not null) and the percentile, between two values as F.percentile has it; groups without values are left out.

    freq: a column with how often a row's value counts. df is read once for the sizes and once for
    each pass; settle it where it is dear to make.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.col(freq) if freq else F.lit(1)).cast("long").alias("_f")).where("_f > 0")
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("_f").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    whole = lambda r: r.groupBy(*keys).agg(F.sum("_f").alias("n"), F.percentile("_v", F.lit(share), F.col("_f")).alias(name))
    large = sizes.where(F.col("_rows") > limit)
    if large.isEmpty():
        return whole(rows)
    small = whole(met(rows, sizes.where(F.col("_rows") <= limit).select(*keys), keys))
    place = (F.col("n") - 1) * F.lit(share)
    left = large.select(*keys, "n", F.lit(0).cast("long").alias("_before"), "_low", "_high", "_rows", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"))
    found = None
    while True:
        done = left.where("_low = _high").select(*keys, "n", "_rank", F.col("_low").alias("_value"))
        few = left.where("_low < _high").where(F.col("_rows") <= limit)
        inside = met(rows, few, keys).where("_v between _low and _high").groupBy(*keys, "n", "_rank", "_before").agg(F.collect_list(F.struct("_v", "_f")).alias("_l"))
        listed = inside.select(*keys, "n", "_rank", value_at(F.sort_array("_l"), F.col("_rank") - F.col("_before")).alias("_value"))
        part = cut(done.unionByName(listed))
        found = part if found is None else found.unionByName(part)
        many = left.where("_low < _high").where(F.col("_rows") > limit)
        if many.isEmpty():
            break
        left = cut(next_bin(met(rows, many, keys), keys))
    ranks = found.groupBy(*keys, "n").agg(F.min_by("_value", "_rank").alias("_a"), F.max_by("_value", "_rank").alias("_b"))
    # as Spark's percentile weighs the two values around the place
    between = (F.ceil(place) - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b")
    return small.unionByName(ranks.select(*keys, "n", F.when(F.floor(place) == F.ceil(place), F.col("_a")).otherwise(between).alias(name)))


def sent(groups: DataFrame) -> DataFrame:
    """Groups to join with, sent to all tasks if they are few. They are counted; settle them where they are dear to make."""
    return F.broadcast(groups) if groups.count() <= BROADCAST else groups


def met(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's columns; groups are sent to all tasks if they are few. Null keys are equal."""
    groups = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(sent(groups), same).drop(*(f"_k_{k}" for k in keys))


def value_at(listed: Column, place: Column) -> Column:
    """The value at a place, from 0, of sorted (value, how often) pairs."""
    start = F.struct(place.alias("left"), F.lit(None).cast("double").alias("value"))
    step = lambda a, x: F.struct((a["left"] - x["_f"]).alias("left"), F.coalesce(a["value"], F.when(a["left"] < x["_f"], x["_v"])).alias("value"))
    return F.aggregate(listed, start, step)["value"]


def bin_of() -> Column:
    """The bin of _v between _low and _high: its ends are never in one, so that each pass leaves less (also of infinities and NaN)."""
    width, place = F.col("_high") - F.col("_low"), F.col("_v") - F.col("_low")
    even = F.least(F.floor(place / width * BINS), F.lit(BINS - 1))
    ends = F.when(F.col("_v") == F.col("_low"), 0).when(F.col("_v") == F.col("_high"), 2).otherwise(1).cast("long")
    return F.when(width < float("inf"), even).otherwise(ends)


def next_bin(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each group and rank the bin that holds it: its least and greatest value, rows, and how many values lie before."""
    binned = rows.where("_v between _low and _high").withColumn("_bin", bin_of())
    group = [*keys, "n", "_rank", "_before"]
    counts = binned.groupBy(*group, "_bin").agg(F.sum("_f").alias("_c"), F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    above = F.col("_before") + F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("_above", above).where("_above <= _rank and _rank < _above + _c")
    return at.select(*keys, "n", F.col("_above").alias("_before"), "_low", "_high", "_rows", "_rank")


def discrete(share: float) -> Callable[[Column], Column]:
    """The place, from 0, of a percentile that is one of n values."""
    return lambda n: F.greatest(F.ceil(n * share), F.lit(1)) - 1


def group_values(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, Callable]], more: Sequence[Column] = (), freq: str | None = None, limit: int | None = None) -> DataFrame:
    """keys, the aggregates of more, and for each of wanted (name: column, place by the number of values) the value at that place.

    Places count from 0 in the ascending values that are not null; the values are exact. Small
    groups are sorted; of larger ones the bins that hold a place are cut again, as above, all
    columns and places in one pass. freq: as in group_percentile. df is read a few times; settle it where it is dear to make.
    """
    limit = LIMIT if limit is None else limit
    keys, columns = list(keys), sorted({c for c, _ in wanted.values()})
    df = df.where(F.col(freq) > 0) if freq else df
    times = (F.col(freq) if freq else F.lit(1)).cast("long")
    sides = [f(F.col(c).cast("double")).alias(f"_{side}{i}") for i, c in enumerate(columns) for side, f in (("low", F.min), ("high", F.max))]
    sizes = cut(df.groupBy(*keys).agg(F.count("*").alias("_rows"), *(F.sum(F.when(F.col(c).isNotNull(), times)).alias(f"_n{i}") for i, c in enumerate(columns)), *sides, *more))
    told = [c for c in sizes.columns if not c.startswith("_") and c not in keys]
    at = {name: place(F.col(f"_n{columns.index(c)}")).cast("long") for name, (c, place) in wanted.items()}

    def listed(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.struct(F.col(c).cast("double").alias("_v"), times.alias("_f")) if freq else F.col(c).cast("double"))).alias(f"_l{i}") for i, c in enumerate(columns)))
        both = with_groups(lists, sizes, keys)
        value = lambda name, c: value_at(F.filter(f"_l{columns.index(c)}", lambda x: x["_v"].isNotNull()), at[name]) if freq else F.get(f"_l{columns.index(c)}", at[name].cast("int"))
        return both.select(*keys, *told, *(value(name, c).alias(name) for name, (c, _) in wanted.items()))

    large = sizes.where(F.col("_rows") > limit)
    if large.isEmpty():
        return listed(df)
    small = listed(met(df, sizes.where(F.col("_rows") <= limit).select(*keys), keys))
    large = cut(large.withColumn("_g", F.monotonically_increasing_id()))
    values = F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))
    long = met(df.withColumn("_f", times), large.select(*keys, "_g"), keys).select("_g", "_f", F.inline(values)).where("_v is not null")
    boxes = F.array(*(F.struct(
        F.lit(i).alias("_c"), F.col(f"_low{i}").alias("_low"), F.col(f"_high{i}").alias("_high"),
        F.array(*(F.struct(F.lit(name).alias("name"), at[name].alias("rank")) for name, (c2, _) in wanted.items() if c2 == c)).alias("_ranks"),
    ) for i, c in enumerate(columns)))
    left = cut(large.select("_g", F.lit(0).cast("long").alias("_before"), "_rows", F.inline(boxes)).where("_low is not null"))
    box, found = ["_g", "_c", "_before"], None
    while True:
        done = left.where("_low = _high").select("_g", F.explode("_ranks.name").alias("name"), F.col("_low").alias("value"))
        few = met(long, left.where("_low < _high").where(F.col("_rows") <= limit), ["_g", "_c"]).where("_v between _low and _high")
        few = few.groupBy(*box, "_ranks").agg(F.sort_array(F.collect_list(F.struct("_v", "_f"))).alias("_l")).select("_g", "_before", "_l", F.inline("_ranks"))
        part = cut(done.unionByName(few.select("_g", "name", value_at(F.col("_l"), F.col("rank") - F.col("_before")).alias("value"))))
        found = part if found is None else found.unionByName(part)
        many = left.where("_low < _high").where(F.col("_rows") > limit)
        if many.isEmpty():
            break
        inside = met(long, many.drop("_rows"), ["_g", "_c"]).where("_v between _low and _high").withColumn("_bin", bin_of())
        counts = inside.groupBy(*box, "_bin").agg(F.sum("_f").alias("_count"), F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        above = F.coalesce(F.sum("_count").over(Window.partitionBy(*box).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = counts.withColumn("_above", F.col("_before") + above).join(many.select(*box, "_ranks"), box)
        held = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_above")) & (r["rank"] < F.col("_above") + F.col("_count")))
        left = cut(bins.withColumn("_ranks", held).where(F.size("_ranks") > 0).select("_g", "_c", F.col("_above").alias("_before"), "_rows", "_low", "_high", "_ranks"))
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted))
    return small.unionByName(large.join(wide, "_g", "left").select(*keys, *told, *wanted))


def with_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns, a row for each group; null keys are equal."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(groups.withColumnsRenamed({k: f"_k_{k}" for k in keys}), same).drop(*(f"_k_{k}" for k in keys))
