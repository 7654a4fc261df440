"""Percentiles by bins equal Spark's, and no task holds a large group's values."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from marlstone.operators import features as fe
from marlstone.operators import gold
from marlstone.operators import quantiles as q
from marlstone.operators import scoring, series
from marlstone.plans import model_queries
from marlstone.sources import listings as src


def rows_of(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for key, n in (("hot", 3000), ("b", 700), (None, 400), ("one", 1), ("two", 2), ("same", 900)):
        for _ in range(n):
            v = 7.25 if key == "same" else r.choice([r.random() * 1e-9, r.gauss(0, 1), -(10 ** r.uniform(0, 8)), float(r.randrange(5))])
            rows.append((key, None if r.random() < 0.05 else v, r.randrange(0, 4)))
    return spark.createDataFrame(rows, "key string, v double, times int")


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_equals_percentile(spark, share, monkeypatch):
    monkeypatch.setattr(q, "BINS", 16)
    df = rows_of(spark)
    want = {r.key: (r.n, r.p) for r in df.where("v is not null").groupBy("key").agg(F.count("v").alias("n"), F.percentile("v", F.lit(share)).alias("p")).collect()}
    got = {r.key: (r.n, r.percentile) for r in q.group_percentile(df, ["key"], "v", share, limit=20).collect()}
    assert got == want


def test_counted_values(spark):
    df = rows_of(spark, 2)
    want = {r.key: r.p for r in df.where("v is not null").groupBy("key").agg(F.percentile("v", F.lit(0.3), F.col("times")).alias("p")).collect()}
    got = {r.key: r.percentile for r in q.group_percentile(df, ["key"], "v", 0.3, freq="times", limit=15).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_a_large_groups_values_meet_in_no_task(spark, monkeypatch):
    """The rows that pass an exchange of next_bin are counts of bins, whatever the size of the group."""
    df = spark.range(20_000).select(F.lit("hot").alias("key"), F.sin("id").alias("v"))
    seen = []
    real = q.next_bin

    def watched(rows, keys):
        out = real(rows, keys)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        seen.append(plan)
        assert "collect_list" not in plan and "percentile(" not in plan
        return out

    monkeypatch.setattr(q, "next_bin", watched)
    got = q.group_percentile(df, ["key"], "v", limit=50).first()
    assert got.percentile == df.agg(F.percentile("v", F.lit(0.5))).first()[0] and len(seen) >= 1


def test_medians_of_periods_and_profiles(spark, monkeypatch):
    monkeypatch.setattr(q, "LIMIT", 30)
    for f in (q.group_percentile,):
        monkeypatch.setattr(f, "__defaults__", (0.5, None, 30, "percentile"))
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice(["1", "2", None]), date(2024, r.randrange(1, 4), 3), r.choice([None, r.random()])) for _ in range(600)], "district_code string, posted_at date, price_per_m2 double")
    got = {(x.area_code, x.ds): (x.price_m2, x.n) for x in series.period_median(df).collect()}
    known = df.where("district_code is not null").withColumn("ds", F.to_date(F.date_trunc("month", "posted_at")))
    want = {}
    for rows in (known.withColumn("area_code", F.col("district_code")), known.withColumn("area_code", F.lit("VN"))):
        for x in rows.groupBy("area_code", "ds").agg(F.percentile("price_per_m2", F.lit(0.5)).alias("p"), F.count("*").alias("n")).collect():
            want[x.area_code, x.ds] = (x.p, x.n)
    assert got == want and len(got) == 9
    told = {x.field: (x.n_null, x.min, x.median, x.max) for x in src.profile(df.withColumnRenamed("price_per_m2", "price").withColumn("area", F.lit(2.0))).collect()}
    p = df.agg(F.count_if(F.col("price_per_m2").isNull()), F.min("price_per_m2"), F.median("price_per_m2"), F.max("price_per_m2")).first()
    assert told == {"price": tuple(p), "area": (0, 2.0, 2.0, 2.0)}
    assert [x.n_null for x in src.profile(df.limit(0).withColumnRenamed("price_per_m2", "price").withColumn("area", F.lit(2.0))).collect()] == [0, 0]


@pytest.mark.parametrize("limit", [10, 100_000])
def test_encoding_of_other_folds(spark, monkeypatch, limit):
    monkeypatch.setattr(fe, "LIMIT", limit)
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), round(r.gauss(5, 1), 2), r.randrange(5)) for i in range(500)] + [(500, "alone", 3.0, 1)]
    df = spark.createDataFrame(rows, "id int, district_code string, y double, fold int")
    got = {x.id: x.district_level for x in fe.oof_encoding(df).collect()}
    median = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    whole = median([x[2] for x in rows])
    for i, d, _, fold in rows:
        others = [x[2] for x in rows if d is not None and x[1] == d and x[3] != fold]
        assert got[i] == pytest.approx(median(others) if others else whole)
    level = {x.district_code: x.level for x in fe.encoding_table(df).collect()}
    assert level["alone"] == 3.0 and level["a"] == pytest.approx(median([x[2] for x in rows if x[1] == "a"]))


def test_ranks_by_ranges_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,)], "v double")
    want = None
    for size in (7, 100_000):
        monkeypatch.setattr(scoring, "RANGE", size)
        got = sorted((r.v if r.v is not None else -1, r.pct_rank) for r in scoring.pct_rank(df, "v").collect())
        assert want in (None, got)
        want = got
    assert got[0] == (-1, None) and got[-1][1] < 100


@pytest.mark.parametrize("limit", [20, 100_000])
@pytest.mark.parametrize("freq", [None, "times"])
def test_values_at_places(spark, monkeypatch, limit, freq):
    monkeypatch.setattr(q, "BINS", 16)
    df = rows_of(spark, 3).withColumn("w", F.when(F.col("key") != "two", F.col("v") * -2.0))
    shares = {"low": ("v", 0.0), "a": ("v", 0.25), "b": ("v", 0.5), "c": ("w", 0.5), "d": ("w", 1.0)}
    got = q.group_values(df, ["key"], {k: (c, q.discrete(s)) for k, (c, s) in shares.items()}, [F.count("*").alias("n")], freq=freq, limit=limit)
    rows = df.collect()
    for r in got.collect():
        group = [x for x in rows if x.key == r.key and (freq is None or x.times > 0)]
        assert r.n == len(group)
        for name, (c, s) in shares.items():
            values = sorted(x[c] for x in group if x[c] is not None for _ in range(x.times if freq else 1))
            assert r[name] == (values[max(1, math.ceil(len(values) * s)) - 1] if values else None)


def test_values_without_end(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in [-inf, inf, float("nan"), *map(float, range(40))]], "key string, v double")
    got = q.group_values(df, ["key"], {"a": ("v", q.discrete(0.0)), "b": ("v", q.discrete(0.5)), "c": ("v", lambda n: n - 2), "d": ("v", lambda n: n - 1)}, limit=5).first()
    assert (got.a, got.b, got.c) == (-inf, 20.0, inf) and math.isnan(got.d)


def test_percentiles_of_large_areas_are_exact(spark, monkeypatch):
    """Beyond 100,000 listings an approximate percentile is another value."""
    n = 400_001
    v = (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10**6 + 1).alias("price_per_m2")
    df = spark.range(n).select(*(F.lit("1").alias(c) for c in ("province_code", "province", "district_code", "district", "ward_code", "ward")), v, F.lit(2.0).alias("area"), (v + 1).alias("price"))
    values = sorted(r[0] for r in df.select("price_per_m2").collect())
    at = lambda s: values[math.ceil(n * s) - 1]
    found = gold.area_price(df).collect()
    assert [r.level for r in found] == ["province", "district", "ward"]
    assert {(r.p25_price_m2, r.median_price_m2, r.p75_price_m2, r.median_area) for r in found} == {(at(0.25), at(0.5), at(0.75), 2.0)}
    told = {r.key: r.value for r in gold.market_summary(df).collect()}
    assert told["median_price_m2"] == round(at(0.5), 6) and told["total_listings"] == n
    assert [r.value for r in gold.market_summary(df.limit(0)).orderBy("key").collect()] == [None, None, None, 0.0, 0.0, 0.0]


def test_profile_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = spark.range(30).select(F.udf(counted, "double")(F.col("id").cast("double")).alias("area"), F.lit(1.0).alias("price"))
    assert {r.field: r.median for r in src.profile(df).collect()} == {"area": 14.5, "price": 1.0} and seen.value <= 30


def test_percentile_of_counted_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 0), (9.0, 2), (None, 4)], "v double, n int")
    assert scoring.whole_percentile(df, "v", 0.5, "n") == 1.5 and scoring.whole_percentile(df, "v", 0.5) == 3.5
    assert scoring.whole_percentile(df.limit(0), "v", 0.5) is None


def test_scored_rows_hold_what_scores_need(spark, sf_dir):
    assert model_queries.predicted(spark, sf_dir).columns == ["listing_id", "area", "price", "predicted"]
