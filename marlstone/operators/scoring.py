"""Ranks and scores: percentile ranks, residual anomalies, flags, detector quality, price errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marlstone.operators.quantiles import group_values
from marlstone.session import cut

CONTAMINATION, FLAG_RANK, FLAG_RATIO = 0.03, 97.0, 0.40
WEIGHTS = {"residual": 1.0, "forest": 0.0, "lof": 0.0}
KS = (50, 100, 200)
#: Rows in a range of an order over all rows, and the most ranges: beyond that ranges grow.
RANGE, MOST_RANGES = 100_000, 20_000


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each of sums, the sum of that column over all rows before a row in the order. The order breaks ties.

    Rows are dealt out by ranges of the order with about RANGE rows each, and settled; only a sum
    for each of at most MOST_RANGES ranges meets in one task and is broadcast.
    """
    seen = Observation()
    df = cut(df.observe(seen, F.count("*").alias("n")))
    ranges = min(MOST_RANGES, -(-max(1, seen.get["n"]) // RANGE))
    ranged = cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    out = ranged.withColumns(within).join(F.broadcast(starts), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *(f"_{n}" for n in sums))


def ordered_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, before (rows with a smaller value) of each distinct value; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, [F.asc("value")], {"before": "n"})


def pct_rank(df: DataFrame, column: str, name: str = "pct_rank") -> DataFrame:
    """Rank of each value from 0 to 100, tied values at the mean of their ranks; null stays null."""
    counts = ordered_counts(df, column)
    total = counts.agg(F.sum("n")).first()[0] or 1
    ranks = counts.select(F.col("value").alias(column), ((F.col("before") + 1 + (F.col("n") - 1) / 2) / total * 100).alias(name))
    return df.join(ranks, column, "left")


def whole_percentile(df: DataFrame, column: str, share: float, freq: str | None = None) -> float | None:
    """The exact percentile of a column over all rows, between two values as F.percentile has it; no task holds or sorts all values.

    freq: a column with how often a row's value counts. df is read a few times.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.lit(0).alias("one"), F.col(column).cast("double").alias("value"), (F.col(freq) if freq else F.lit(1)).cast("long").alias("times"))
    place = lambda n: F.floor((n - 1) * share)
    ends = {"below": ("value", place), "above": ("value", lambda n: F.least(place(n) + 1, n - 1))}
    one = group_values(rows, ["one"], ends, [F.sum("times").alias("total")], freq="times" if freq else None).first()
    if not one:
        return None
    at = (one.total - 1) * share
    return one.below + (one.above - one.below) * (at - int(at))


def residual_scores(df: DataFrame, price: str = "price", predicted: str = "predicted") -> DataFrame:
    """residual |ln p - ln p^|, ratio expm1 of it, and its percentile rank as the score."""
    residual = F.abs(F.ln(price) - F.ln(predicted))
    return pct_rank(df.withColumn("residual", residual).withColumn("ratio", F.expm1("residual")), "residual", "score")


def blend(weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights.values())
    return sum((F.coalesce(F.col(k), F.lit(0.0)) * (w / total) for k, w in weights.items()), F.lit(0.0))


def reason(price: str = "price", predicted: str = "predicted", ratio: str = "ratio", ranks: dict[str, str] | None = None) -> Column:
    """Why a listing stands out. A price below the prediction is said as the share that is missing. ranks: columns of ranks, and what they are called."""
    higher = F.concat(F.lit("price higher than predicted by "), F.round((F.col(price) / F.col(predicted) - 1) * 100).cast("long").cast("string"), F.lit(" %"))
    lower = F.concat(F.lit("price lower than predicted by "), F.round((1 - F.col(price) / F.col(predicted)) * 100).cast("long").cast("string"), F.lit(" %"))
    parts = [F.when(F.col(ratio) >= FLAG_RATIO, F.when(F.col(price) >= F.col(predicted), higher).otherwise(lower))]
    parts += [F.when(F.col(r) >= FLAG_RANK, F.lit(f"unusual by {name}")) for r, name in (ranks or {}).items()]
    return F.concat_ws("; ", *parts)


def flag(df: DataFrame, contamination: float = CONTAMINATION, score: str = "score") -> DataFrame:
    """The rows whose score is at least the percentile 1 - contamination. df is settled: the percentile reads it, too."""
    df = cut(df)
    least = whole_percentile(df, score, 1 - contamination)
    return df.where(F.col(score) >= least) if least is not None else df.limit(0)


def score_detectors(scores: DataFrame, signals: Sequence[str], truth: str = "is_anomaly", ident: str = "listing_id", ks: Sequence[int] = KS) -> DataFrame:
    """signal, average_precision, roc_auc, precision_at_k, recall_at_k, base_rate of each signal.

    Ties are broken by ident (distinct) for the first, averaged for the second. Ranks come from
    ranges of rows, which may cut through a tie, so only the top k rows are sorted in one place.
    """
    out = None
    spark = scores.sparkSession
    n, positives = scores.agg(F.count("*"), F.sum(F.col(truth).cast("long"))).first()
    for s in signals:
        order = scores.select(F.col(s).alias("s"), F.col(ident).alias("i"), F.col(truth).cast("long").alias("t"))
        top = order.orderBy(F.desc("s"), "i").limit(max(ks))
        found = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "i")))
        at = found.agg(*(F.sum(F.when(F.col("r") <= k, F.col("t"))).alias(f"k{k}") for k in ks)).first()
        # positives before each value, and among its ties by ident
        ranked = _running(order)
        hit = ranked.where("t = 1").agg(F.avg(F.col("cum") / F.col("r")).alias("ap"), F.sum("mean_rank").alias("ranks")).first()
        pos, neg = positives or 0, n - (positives or 0)
        auc = (hit.ranks - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else None
        row = (s, hit.ap, auc, *((at[f"k{k}"] or 0) / min(k, n) for k in ks), (at[f"k{ks[-1]}"] or 0) / pos if pos else None, pos / n if n else None)
        names = ["signal", "average_precision", "roc_auc", *(f"precision_at_{k}" for k in ks), f"recall_at_{ks[-1]}", "base_rate"]
        one = spark.createDataFrame([row], ", ".join(f"{x} {'string' if x == 'signal' else 'double'}" for x in names))
        out = one if out is None else out.unionByName(one)
    return out


def _running(order: DataFrame) -> DataFrame:
    """Each row's rank by (s desc, i), the positives up to it, and the mean ascending rank of its value."""
    means = ordered_counts(order, "s").select(F.col("value").alias("s"), (F.col("before") + 1 + (F.col("n") - 1) / 2).alias("mean_rank"))
    rows = running_sums(order.withColumn("one", F.lit(1).cast("long")), [F.desc("s"), F.asc("i")], {"k": "one", "kp": "t"})
    return rows.join(means, "s").select("s", "i", "t", (F.col("k") + 1).alias("r"), (F.col("kp") + F.col("t")).alias("cum"), "mean_rank")


def price_metrics(df: DataFrame, price: str = "price", predicted: str = "predicted", area: str = "area") -> DataFrame:
    """RMSE, MAE, MAPE and R2 of prices, RMSE and MAE of unit prices, R2 of logarithms, in one pass."""
    p, q = F.col(price), F.col(predicted)
    e, u = q - p, (q - p) * 1000 / F.col(area)
    r2 = lambda y, z: 1 - F.sum(F.pow(y - z, 2)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    out = {
        "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "mape": F.avg(F.abs(e) / p) * 100, "r2": r2(p, q),
        "rmse_m2": F.sqrt(F.avg(u * u)), "mae_m2": F.avg(F.abs(u)), "r2_log": r2(F.ln(p), F.ln(q)),
    }
    return df.agg(*(F.round(c, 6).alias(k) for k, c in out.items()))
