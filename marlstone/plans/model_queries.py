"""Queries over series, features, scores and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.fixtures import listings, silver, table, with_listings, with_silver
from marlstone.operators import features as fe
from marlstone.operators import gold, learning, scoring, series
from marlstone.session import settle

WAYS = ("Đông", "Tây", "Nam", "Bắc", "Đông Nam", "Tây Bắc", "dong bac", "TÂY NAM", "không rõ")


def monthly(spark, sf):
    return series.period_median(silver(spark, sf))


def forecast_rows(spark, sf):
    return series.naive_forecast(monthly(spark, sf)).select("area_code", "step", "ds", "yhat")


def summary(spark, sf):
    return series.backtest_summary(series.errors(series.naive_backtest(monthly(spark, sf))))


def weekly(spark, sf):
    """Medians of event values by type and day: a daily series."""
    daily = table(spark, sf, "events").groupBy(F.col("event_type").alias("area_code"), F.to_date("ts").alias("ds")).agg(F.percentile("value", F.lit(0.5)).alias("price_m2"))
    return series.resample_month(daily, least=20)


def catalogue(spark, sf):
    return series.series_catalogue(monthly(spark, sf).withColumn("source", F.when(F.col("area_code") == "VN", "all").otherwise("district")))


def versions(spark, sf):
    """One line item of each order: the one shipped last, the dearest of equals."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_partkey")
    return series.one_version(rows, ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.asc("l_partkey")])


def dates(spark, sf):
    """Order dates written day first in half of the rows that only allow it: the column is read as the better convention."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")
    return series.parse_dates(table(spark, sf, "orders").select("o_orderkey", text), "d").select("o_orderkey", "ds")


def with_target(spark, sf, *columns):
    """Listings with these columns, and the level of their district."""
    rows = silver(spark, sf).select("listing_id", "district_code", *columns, fe.target().alias("y"), F.pmod("part_key", F.lit(5)).cast("int").alias("fold"))
    return fe.oof_encoding(settle(rows))  # a join of six tables, read twice


def varied_features(spark, sf):
    """Features of listings that have a plot, rooms and directions, and of some that lack them."""
    number = F.col("part_key")
    some = {
        "frontage": F.when(number % 4 > 0, (number % 13).cast("double")), "bedrooms": F.when(number % 7 > 0, (number % 5).cast("double")), "bathrooms": F.when(number % 3 > 0, (number % 4).cast("double")),
        "house_direction": F.element_at(F.array(*map(F.lit, WAYS)), (number % 9 + 1).cast("int")), "balcony_direction": F.element_at(F.array(*map(F.lit, WAYS)), (number % 8 + 2).cast("int")),
    }
    made = fe.build_features(listings(spark, sf).withColumns(some).withColumn("district_level", F.lit(1.0)))
    names = [*fe.GROUPS["size"], *fe.GROUPS["plot"], *fe.GROUPS["direction"]]
    return made.select("listing_id", "part_key", "ingested_at", *((F.round(f, 6) + 0.0).alias(f) for f in names))


def feature_rows(spark, sf):
    made = fe.build_features(with_target(spark, sf, "area", "floors", "access_road", "legal_status", "furniture_state"))
    return made.select("listing_id", *(F.round(f, 6).alias(f) for f in fe.FEATURES))


def predicted(spark, sf):
    """Prices by the out-of-fold level of the district."""
    rows = with_target(spark, sf, "area", "price").withColumn("predicted", fe.inverse(F.col("district_level"), F.col("area")))
    return rows.select("listing_id", "area", "price", "predicted")


def residuals(spark, sf):
    rows = scoring.residual_scores(predicted(spark, sf))
    return rows.select("listing_id", *(F.round(c, 6).alias(c) for c in ("residual", "ratio", "score")))


def flagged(spark, sf):
    rows = scoring.flag(scoring.residual_scores(predicted(spark, sf)))
    return rows.select("listing_id", scoring.reason().alias("reason"))


def top_anomalies(spark, sf):
    rows = gold.top_anomalies(scoring.residual_scores(predicted(spark, sf)), 50)
    return rows.select("listing_id", F.round("score", 6).alias("score"))


def detectors(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 97).cast("double").alias("by_length"), (F.col("doc_id") * 1.0).alias("by_id"))
    truth = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_anomaly"))
    out = scoring.score_detectors(docs.join(truth, "doc_id"), ["by_length", "by_id"], ident="doc_id")
    return out.select("signal", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def checked(spark, sf):
    """Listings that are far from their predicted price, with a severity."""
    return learning.check_listings(predicted(spark, sf)).groupBy("severity").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


QUERIES = {
    "period_median": monthly,
    "infer_freq": lambda s, d: series.infer_freq(monthly(s, d)),
    "resample_month": weekly,
    "fold_cuts": lambda s, d: series.cuts(monthly(s, d)),
    "fold_cuts_stepped": lambda s, d: series.cuts(monthly(s, d), spread=False),
    "naive_backtest": lambda s, d: series.naive_backtest(monthly(s, d)),
    "backtest_summary": summary,
    "naive_forecast": forecast_rows,
    "series_catalogue": catalogue,
    "longest_series": lambda s, d: gold.longest_series(monthly(s, d)),
    "one_version": versions,
    "parse_dates": dates,
    "features": feature_rows,
    "varied_features": varied_features,
    "dead_features": lambda s, d: fe.dead_features(listings(s, d), "legal_status", fe.LEGAL_RANKS),
    "residual_scores": residuals,
    "flagged": flagged,
    "top_anomalies": top_anomalies,
    "score_detectors": detectors,
    "price_metrics": lambda s, d: scoring.price_metrics(predicted(s, d)),
    "check_listings": checked,
}

MONTHLY = """monthly AS (
  SELECT district_code AS area_code, date_trunc('month', posted_at)::DATE AS ds, quantile_cont(price_per_m2, 0.5) AS price_m2, count(*) AS n FROM silver GROUP BY 1, 2 HAVING count(*) >= 5
  UNION ALL SELECT 'VN', date_trunc('month', posted_at)::DATE, quantile_cont(price_per_m2, 0.5), count(*) FROM silver GROUP BY 2 HAVING count(*) >= 5)"""
FREQ = """gaps AS (SELECT area_code, datediff('day', lag(ds) OVER (PARTITION BY area_code ORDER BY ds), ds) AS gap FROM monthly),
freq AS (SELECT area_code, CASE WHEN quantile_cont(gap, 0.5) <= 2 THEN 'D' WHEN quantile_cont(gap, 0.5) <= 10 THEN 'W' ELSE 'MS' END AS freq FROM gaps GROUP BY 1)"""
CUTS = """sized AS (SELECT area_code, count(*) AS n, greatest(8, 6, floor(count(*) * 0.3))::INTEGER AS low FROM monthly GROUP BY 1),
counted AS (SELECT *, n - 3 - low + 1 AS k FROM sized WHERE n - 3 - low + 1 > 0),
cuts AS (SELECT area_code, (low + (i * k) // least(k, 24))::INTEGER AS cut FROM counted, range(24) r(i) WHERE i < least(k, 24))"""
BACKTEST = f"""{CUTS},
points AS (SELECT area_code, row_number() OVER (PARTITION BY area_code ORDER BY ds)::INTEGER AS i, price_m2 AS y FROM monthly),
tests AS (SELECT p.area_code, cut, p.i - cut AS step, p.y, b.y AS yhat FROM cuts JOIN points b ON b.area_code = cuts.area_code AND b.i = cut
          JOIN points p ON p.area_code = cuts.area_code AND p.i > cut AND p.i <= cut + 3)"""
TARGET = """rows_ AS (SELECT *, ln(price_per_m2) AS y, (part_key % 5)::INTEGER AS fold FROM silver),
levels AS (SELECT district_code, f.i::INTEGER AS fold, quantile_cont(y, 0.5) AS level FROM rows_, range(5) f(i) WHERE f.i <> fold GROUP BY 1, 2),
target AS (SELECT rows_.*, coalesce(level, (SELECT quantile_cont(y, 0.5) FROM rows_)) AS district_level FROM rows_ LEFT JOIN levels USING (district_code, fold)),
predicted AS (SELECT *, exp(district_level) * area / 1000 AS predicted FROM target),
scored AS (SELECT *, abs(ln(price) - ln(predicted)) AS residual FROM predicted),
ranked AS (SELECT *, exp(residual) - 1 AS ratio, (rank() OVER (ORDER BY residual) + (count(*) OVER (PARTITION BY residual) - 1) / 2.0) / count(*) OVER () * 100 AS score FROM scored)"""


def over(*ctes: str):
    return lambda body: with_silver(", " + ",\n".join(ctes) + "\n" + body).replace("\n, ", ",\n", 1)


monthly_sql, freq_sql, cuts_sql, test_sql, target_sql = over(MONTHLY), over(MONTHLY, FREQ), over(MONTHLY, CUTS), over(MONTHLY, BACKTEST), over(TARGET)
ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in fe.FEATURES)
DETECT = """d AS (SELECT doc_id, (n_chars % 97)::DOUBLE AS by_length, doc_id * 1.0::DOUBLE AS by_id, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)),
u AS (SELECT 'by_length' AS signal, doc_id, by_length AS s, t FROM d UNION ALL SELECT 'by_id', doc_id, by_id, t FROM d),
r AS (SELECT *, row_number() OVER w AS r, sum(t::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, rank() OVER (PARTITION BY signal ORDER BY s) + (count(*) OVER (PARTITION BY signal, s) - 1) / 2.0 AS mr
      FROM u WINDOW w AS (PARTITION BY signal ORDER BY s DESC, doc_id))"""
DEGREES = "[90, 270, 180, 0, 135, 315, 45, 225, NULL]"
VARIED_INPUT = f"""CASE WHEN part_key % 4 > 0 THEN (part_key % 13)::DOUBLE END AS frontage, CASE WHEN part_key % 7 > 0 THEN (part_key % 5)::DOUBLE END AS bedrooms,
  CASE WHEN part_key % 3 > 0 THEN (part_key % 4)::DOUBLE END AS bathrooms, radians({DEGREES}[part_key % 9 + 1]) AS house, radians({DEGREES}[part_key % 8 + 2]) AS balcony"""
VARIED = {
    "log_area": "ln(1 + area)", "floors": "floors", "bedrooms": "bedrooms", "bathrooms": "bathrooms", "area_per_bedroom": "area / nullif(bedrooms, 0)", "rooms_total": "coalesce(bedrooms, 0) + coalesce(bathrooms, 0)",
    "frontage": "frontage", "access_road": "access_road", "frontage_ratio": "frontage / nullif(sqrt(area), 0)", "is_mat_tien": "(access_road >= 4)::INTEGER::DOUBLE", "is_wide_road": "(access_road >= 8)::INTEGER::DOUBLE",
    "house_dir_sin": "sin(house)", "house_dir_cos": "cos(house)", "balcony_dir_sin": "sin(balcony)", "balcony_dir_cos": "cos(balcony)",
}
SQL = {
    "period_median": monthly_sql("SELECT * FROM monthly"),
    "infer_freq": freq_sql("SELECT * FROM freq"),
    "resample_month": """WITH d AS (SELECT event_type AS area_code, ts::DATE AS ds, quantile_cont(value, 0.5) AS price_m2 FROM events GROUP BY 1, 2)
        SELECT area_code, date_trunc('month', ds)::DATE AS ds, quantile_cont(price_m2, 0.5) AS price_m2 FROM d GROUP BY 1, 2""",
    "fold_cuts": cuts_sql("SELECT area_code, cut FROM cuts"),
    "fold_cuts_stepped": cuts_sql("""SELECT area_code, x::INTEGER AS cut FROM (SELECT area_code, low, k, n, unnest(range(low, n - 2)) AS x FROM counted)
        WHERE (x - low) % greatest(1, k // 24) = 0 QUALIFY row_number() OVER (PARTITION BY area_code ORDER BY x) <= 24"""),
    "naive_backtest": test_sql("SELECT area_code, cut, step, y, yhat FROM tests"),
    "backtest_summary": test_sql(""", folds AS (SELECT area_code, cut, avg(abs((yhat - y) / nullif(y, 0))) * 100 AS mape, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(abs(yhat - y)) AS mae FROM tests GROUP BY 1, 2)
        SELECT area_code, count(*) AS folds, round(avg(mape), 6) AS mape_mean, round(stddev_samp(mape), 6) AS mape_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std,
               round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std FROM folds GROUP BY 1""").replace("\n, folds", ",\nfolds"),
    "naive_forecast": freq_sql(""", last AS (SELECT area_code, max(ds) AS last, arg_max(price_m2, ds) AS yhat FROM monthly GROUP BY 1)
        SELECT area_code, s::INTEGER AS step, (CASE freq WHEN 'D' THEN last + s::INTEGER WHEN 'W' THEN last + (7 * s)::INTEGER ELSE (last + to_months(s::INTEGER))::DATE END)::DATE AS ds, yhat
        FROM last JOIN freq USING (area_code), range(1, 4) r(s)""").replace("\n, last", ",\nlast"),
    "series_catalogue": monthly_sql("SELECT CASE WHEN area_code = 'VN' THEN 'all' ELSE 'district' END AS source, area_code, count(*) AS n, count(*) >= 12 AS trainable FROM monthly GROUP BY 1, 2"),
    "longest_series": monthly_sql("SELECT area_code, count(*) AS n FROM monthly GROUP BY 1 ORDER BY n DESC, area_code LIMIT 1"),
    "one_version": """SELECT l_orderkey, l_shipdate, l_extendedprice, l_partkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey) = 1""",
    "parse_dates": "SELECT o_orderkey, o_orderdate::DATE AS ds FROM orders",
    "features": target_sql(f""", f AS (SELECT listing_id, ln(1 + area) AS log_area, floors, NULL::DOUBLE AS bedrooms, NULL::DOUBLE AS bathrooms, NULL::DOUBLE AS area_per_bedroom, 0.0::DOUBLE AS rooms_total,
          NULL::DOUBLE AS frontage, access_road, NULL::DOUBLE AS frontage_ratio, (access_road >= 4)::INTEGER::DOUBLE AS is_mat_tien, (access_road >= 8)::INTEGER::DOUBLE AS is_wide_road,
          CASE legal_status WHEN 'Have certificate' THEN 4.0 WHEN 'Sale contract' THEN 2.0 WHEN 'No certificate' THEN 0.0 END::DOUBLE AS legal_rank,
          CASE furniture_state WHEN 'Full' THEN 2.0 WHEN 'Basic' THEN 1.0 END::DOUBLE AS furniture_rank,
          NULL::DOUBLE AS house_dir_sin, NULL::DOUBLE AS house_dir_cos, NULL::DOUBLE AS balcony_dir_sin, NULL::DOUBLE AS balcony_dir_cos, district_level FROM target),
        g AS (SELECT *, district_level * log_area AS level_x_log_area, district_level * legal_rank AS level_x_legal FROM f)
        SELECT listing_id, {ROUNDED} FROM g""").replace("\n, f AS", ",\nf AS"),
    "varied_features": with_listings(f"""SELECT listing_id, part_key, ingested_at, {", ".join(f"round({c}, 6) + 0.0 AS {n}" for n, c in VARIED.items())}
        FROM (SELECT *, {VARIED_INPUT} FROM listings)"""),
    "dead_features": with_silver("""SELECT count(legal_status) AS n_values, count(legal_status) AS n_hits, false AS dead,
        (SELECT string_agg(legal_status, ', ' ORDER BY n DESC, legal_status) FROM (SELECT legal_status, count(*) AS n FROM listings GROUP BY 1)) AS top FROM listings"""),
    "residual_scores": target_sql("SELECT listing_id, round(residual, 6) AS residual, round(ratio, 6) AS ratio, round(score, 6) AS score FROM ranked"),
    "flagged": target_sql("""SELECT listing_id, CASE WHEN ratio < 0.4 THEN '' WHEN price >= predicted THEN 'price higher than predicted by ' || round((price / predicted - 1) * 100)::BIGINT || ' %'
        ELSE 'price lower than predicted by ' || round((1 - price / predicted) * 100)::BIGINT || ' %' END AS reason FROM ranked WHERE score >= (SELECT quantile_cont(score, 0.97) FROM ranked)"""),
    "top_anomalies": target_sql("SELECT listing_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, listing_id LIMIT 50"),
    "score_detectors": f"""WITH {DETECT}, c AS (SELECT signal, count(*) AS n, sum(t::INTEGER) AS p FROM u GROUP BY 1)
        SELECT signal, round(avg(cum / r) FILTER (t), 6) AS average_precision, round((sum(mr) FILTER (t) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * (any_value(n) - any_value(p))), 6) AS roc_auc,
               round(count(*) FILTER (t AND r <= 50) / least(50, any_value(n)), 6) AS precision_at_50, round(count(*) FILTER (t AND r <= 100) / least(100, any_value(n)), 6) AS precision_at_100, round(count(*) FILTER (t AND r <= 200) / least(200, any_value(n)), 6) AS precision_at_200,
               round(count(*) FILTER (t AND r <= 200) / any_value(p), 6) AS recall_at_200, round(any_value(p) / any_value(n), 6) AS base_rate FROM r JOIN c USING (signal) GROUP BY 1""",
    "price_metrics": target_sql("""SELECT round(sqrt(avg((predicted - price) ** 2)), 6) AS rmse, round(avg(abs(predicted - price)), 6) AS mae, round(avg(abs(predicted - price) / price) * 100, 6) AS mape,
        round(1 - sum((price - predicted) ** 2) / (var_pop(price) * count(*)), 6) AS r2, round(sqrt(avg(((predicted - price) * 1000 / area) ** 2)), 6) AS rmse_m2,
        round(avg(abs((predicted - price) * 1000 / area)), 6) AS mae_m2, round(1 - sum((ln(price) - ln(predicted)) ** 2) / (var_pop(ln(price)) * count(*)), 6) AS r2_log FROM predicted"""),
    "check_listings": target_sql("""SELECT CASE WHEN gap >= 1 THEN 'cao' WHEN gap >= 0.5 THEN 'trung bình' ELSE 'thấp' END AS severity, count(*) AS n, count(*) FILTER (gap >= 0.5) AS n_flagged
        FROM (SELECT abs(price - predicted) / predicted AS gap FROM predicted) GROUP BY 1"""),
}
