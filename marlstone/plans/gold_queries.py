"""Queries over the gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.fixtures import listings, silver, table, with_listings, with_silver
from marlstone.operators import gold, lake, learning
from marlstone.operators.quantiles import group_values
from marlstone.session import cut

STATS = """count(*) AS n_listings, quantile_disc(price_per_m2, 0.5) AS median_price_m2, quantile_disc(price_per_m2, 0.25) AS p25_price_m2,
    quantile_disc(price_per_m2, 0.75) AS p75_price_m2, round(avg(price_per_m2), 6) AS mean_price_m2,
    quantile_disc(area, 0.5) AS median_area, quantile_disc(price, 0.5) AS median_price"""
AREAS = f"""areas AS (
  SELECT 'province' AS level, province_code AS code, province AS name, NULL AS parent_code, {STATS} FROM silver GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT 'district', district_code, district, province_code, {STATS} FROM silver GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT 'ward', ward_code, ward, district_code, {STATS} FROM silver GROUP BY ALL HAVING count(*) >= 30)"""


DISTRICTS = """districts AS (SELECT district_code, district, province_code, count(*) AS n_listings, quantile_disc(price_per_m2, 0.5) AS median_price_m2,
  round(avg(area), 6) AS mean_area, round(avg(floors), 6) AS mean_floors, round(avg(CASE WHEN legal_status = 'Have certificate' THEN 1.0 WHEN legal_status IS NOT NULL THEN 0.0 END), 6) AS pct_red_book,
  round(avg(CASE WHEN access_road >= 4 THEN 1.0 WHEN access_road IS NOT NULL THEN 0.0 END), 6) AS pct_mat_tien FROM silver GROUP BY ALL HAVING count(*) >= 30)"""


def with_areas(body: str) -> str:
    return with_silver(f", {AREAS}\n{body}").replace("\n, areas AS", ",\nareas AS", 1)


def areas(spark, sf):
    return gold.area_price(silver(spark, sf))


def districts(spark, sf):
    return gold.area_price(silver(spark, sf), levels=["district"])


def ward_year(spark, sf):
    """Wards by year: small groups, so that the smallest size matters."""
    by = cut(silver(spark, sf).select("ward_code", F.year("posted_at").alias("year"), "price_per_m2"))
    return group_values(by, ["ward_code", "year"], {"median_price_m2": gold.MEDIAN}, [F.count("*").alias("n_listings")]).where("n_listings >= 30").select("ward_code", "year", "n_listings", "median_price_m2")


def choropleth(spark, sf):
    """Every nation as a geometry: its class by median price, 0 where there is no data."""
    found = districts(spark, sf)
    shapes = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"), F.col("n_name").alias("shape"))
    joined = shapes.join(found.select("code", "median_price_m2"), "code", "left")
    return gold.assign_class(joined, gold.class_breaks(found, "median_price_m2"), "median_price_m2")


def source_shares(spark, sf):
    kinds = F.when(F.col("area") < 10, "old").when(F.col("area") < 12, "bridge2025").otherwise("none")
    return lake.source_breakdown(listings(spark, sf).withColumn("geo_source", kinds))


def match_rates(spark, sf):
    known = listings(spark, sf).withColumns({
        "ward_code": F.when(F.col("area") >= 5, F.col("ward_code")), "district_code": F.when(F.col("area") >= 3, F.col("district_code")),
        "geo_match_score": F.when(F.col("area") < 5, 90.0).otherwise(100.0),
    })
    return lake.match_quality(known)


def codes_of(spark, sf):
    ref = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"))
    other = silver(spark, sf).where("province_code <> '02'").select(F.col("district_code").alias("code"))
    return gold.reconcile_codes(ref, other)


def city_and_median(spark, sf):
    """Listings beside their district's median: how far each is from it."""
    joined = learning.beside_district(silver(spark, sf), districts(spark, sf), F.col("price_per_m2"))
    return joined.select("listing_id", F.round("vs_district_pct", 6).alias("vs_district_pct"))


def hot_detail(spark, sf):
    """The districts with most listings, with their details joined by code."""
    counts = silver(spark, sf).groupBy(F.col("district_code").alias("code"), F.col("district_code").alias("district")).agg(F.count("*").alias("n"))
    return gold.with_details(gold.hottest(counts, 5), districts(spark, sf)).select("code", "name", "n", "median_price_m2")


def cluster_table(spark, sf):
    """Districts in clusters by the last digit of their code, summarised and named by the rank of their prices."""
    rows = gold.district_features(silver(spark, sf)).withColumn("cluster", (F.col("district_code").cast("int") % 3).cast("int"))
    out = learning.label_by_rank(learning.cluster_summary(rows))
    return out.select("cluster", "n", *(F.round(c, 6).alias(c) for c in ("median_price", "mean_price", "min_price", "max_price", "share")), "label")


def spelt_states(spark, sf):
    """Silver whose legal states come in the spellings of several sources."""
    spellings = {"Have certificate": ["Have certificate", "Sổ đỏ", "Sổ hồng", "Sổ hồng/ Sổ đỏ", "sodo", " SỔ ĐỎ ", "Pink book"], "Sale contract": ["Sale contract", "Hợp đồng mua bán", "HĐMB"], "No certificate": ["No certificate", "Chưa sổ", "Giấy tờ viết tay"]}
    state = F.lit(None).cast("string")
    for name, forms in spellings.items():
        state = F.when(F.col("legal_status") == name, F.element_at(F.array(*map(F.lit, forms)), (F.col("floors") % len(forms) + 1).cast("int"))).otherwise(state)
    return silver(spark, sf).withColumn("legal_status", state)


QUERIES = {
    "silver_latest": lambda s, d: silver(s, d).select("listing_id", "price", "area", "part_key"),
    "area_price": areas,
    "ward_year": ward_year,
    "district_features": lambda s, d: gold.district_features(spelt_states(s, d)),
    "market_summary": lambda s, d: gold.market_summary(silver(s, d)),
    "distinct_areas": lambda s, d: gold.distinct_areas(silver(s, d)),
    "top_districts": lambda s, d: gold.top_districts(districts(s, d), 10),
    "area_list": lambda s, d: gold.area_list(districts(s, d), "district", "01"),
    "class_breaks": lambda s, d: gold.class_breaks(districts(s, d), "median_price_m2"),
    "choropleth": choropleth,
    "reconcile_codes": codes_of,
    "match_quality": match_rates,
    "source_breakdown": source_shares,
    "vs_district": city_and_median,
    "hot_detail": hot_detail,
    "cluster_table": cluster_table,
    "cluster_screen": lambda s, d: learning.cv_screen(gold.district_features(silver(s, d))).select("feature", F.round("cv", 6).alias("cv"), "used"),
}
SQL = {
    "silver_latest": with_silver("SELECT listing_id, price, area, part_key FROM silver"),
    "area_price": with_areas("SELECT * FROM areas"),
    "ward_year": with_silver("SELECT ward_code, year(posted_at)::INTEGER AS year, count(*) AS n_listings, quantile_disc(price_per_m2, 0.5) AS median_price_m2 FROM silver GROUP BY ALL HAVING count(*) >= 30"),
    "district_features": with_silver("""SELECT district_code, district, province_code, count(*) AS n_listings, quantile_disc(price_per_m2, 0.5) AS median_price_m2,
        round(avg(area), 6) AS mean_area, round(avg(floors), 6) AS mean_floors, round(avg(CASE WHEN legal_status = 'Have certificate' THEN 1.0 WHEN legal_status IS NOT NULL THEN 0.0 END), 6) AS pct_red_book,
        round(avg(CASE WHEN access_road >= 4 THEN 1.0 WHEN access_road IS NOT NULL THEN 0.0 END), 6) AS pct_mat_tien FROM silver GROUP BY ALL HAVING count(*) >= 30"""),
    "market_summary": with_silver(""", k AS (SELECT count(*)::DOUBLE AS total_listings, quantile_disc(price_per_m2, 0.5) AS median_price_m2, quantile_disc(price, 0.5) AS median_price,
        quantile_disc(area, 0.5) AS median_area, count(DISTINCT district_code)::DOUBLE AS n_districts, count(DISTINCT province_code)::DOUBLE AS n_provinces FROM silver),
        u AS (SELECT 'total_listings' AS key, total_listings AS v FROM k UNION ALL SELECT 'median_price_m2', median_price_m2 FROM k UNION ALL SELECT 'median_price', median_price FROM k
        UNION ALL SELECT 'median_area', median_area FROM k UNION ALL SELECT 'n_districts', n_districts FROM k UNION ALL SELECT 'n_provinces', n_provinces FROM k)
        SELECT key, round(v, 6) AS value, printf('%.2f', v) AS text FROM u""").replace("\n,", ",", 1),
    "distinct_areas": with_silver("SELECT count(DISTINCT district_code) AS n_districts, count(DISTINCT province_code) AS n_provinces, count(DISTINCT ward_code) AS n_wards FROM silver"),
    "top_districts": with_areas("SELECT * FROM areas WHERE level = 'district' ORDER BY median_price_m2 DESC, code LIMIT 10"),
    "area_list": with_areas("SELECT * FROM areas WHERE level = 'district' AND parent_code = '01'"),
    "class_breaks": with_areas("""SELECT i::INTEGER AS idx, list_sort(list(median_price_m2))[1 + floor(i / 6.0 * (count(*) - 1))::INTEGER] AS value
        FROM areas, range(7) r(i) WHERE level = 'district' GROUP BY i"""),
    "choropleth": with_areas(""", b AS (SELECT i, list_sort(list(median_price_m2))[1 + floor(i / 6.0 * (count(*) - 1))::INTEGER] AS v FROM areas, range(1, 6) r(i) WHERE level = 'district' GROUP BY i)
        SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS code, n_name AS shape, median_price_m2,
               CASE WHEN median_price_m2 IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM b WHERE v <= median_price_m2) END::INTEGER AS class
        FROM nation LEFT JOIN (SELECT * FROM areas WHERE level = 'district') ON code = lpad(n_nationkey::VARCHAR, 3, '0')""").replace("\n, b AS", ", b AS", 1),
    "reconcile_codes": with_silver(""", r AS (SELECT DISTINCT lpad(n_nationkey::VARCHAR, 3, '0') AS code FROM nation), o AS (SELECT DISTINCT district_code AS code FROM silver WHERE province_code <> '02')
        SELECT *, round(n_both / n_ref, 6) AS match, n_both / n_ref < 0.95 AS low FROM (
          SELECT (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM o) AS n_other, (SELECT count(*) FROM r SEMI JOIN o USING (code)) AS n_both,
                 (SELECT min(code) FROM r ANTI JOIN o USING (code)) AS first_missing)""").replace("\n,", ",", 1),
    "match_quality": with_listings("""SELECT count(*) AS n_rows, 1.0::DOUBLE AS province_rate, round(avg((area >= 3)::INTEGER), 6) AS district_rate, round(avg((area >= 5)::INTEGER), 6) AS ward_rate,
        round(avg(CASE WHEN area < 5 THEN 90.0 ELSE 100.0 END), 6) AS mean_score, avg((area >= 3)::INTEGER) < 0.9 AS low FROM listings"""),
    "source_breakdown": with_listings("""SELECT CASE WHEN area < 10 THEN 'old' WHEN area < 12 THEN 'bridge2025' ELSE 'none' END AS geo_source, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (), 6) AS share FROM listings GROUP BY 1"""),
    "vs_district": with_areas("""SELECT listing_id, round((price_per_m2 / median_price_m2 - 1) * 100, 6) AS vs_district_pct
        FROM silver LEFT JOIN (SELECT code, median_price_m2 FROM areas WHERE level = 'district') ON code = district_code"""),
    "cluster_table": with_silver(f""", {DISTRICTS}, c AS (SELECT (district_code::INTEGER % 3)::INTEGER AS cluster, count(*) AS n, round(quantile_cont(median_price_m2, 0.5), 6) AS median_price,
          round(avg(median_price_m2), 6) AS mean_price, round(min(median_price_m2), 6) AS min_price, round(max(median_price_m2), 6) AS max_price FROM districts GROUP BY 1)
        SELECT *, round(n / sum(n) OVER (), 6) AS share, list_extract(CASE count(*) OVER () WHEN 3 THEN ['Cao cấp', 'Trung cấp', 'Bình dân'] WHEN 2 THEN ['Cao cấp', 'Phổ thông'] ELSE ['Nhóm 1'] END,
          row_number() OVER (ORDER BY median_price DESC, cluster)) AS label FROM c""").replace("\n,", ",", 1),
    "cluster_screen": with_silver(f""", {DISTRICTS}, cv AS (SELECT unnest(['median_price_m2', 'mean_area', 'mean_floors', 'pct_red_book', 'pct_mat_tien']) AS feature,
          unnest([{", ".join(f"stddev_samp({c}) / nullif(abs(avg({c})), 0)" for c in ("median_price_m2", "mean_area", "mean_floors", "pct_red_book", "pct_mat_tien"))}]) AS cv FROM districts)
        SELECT feature, round(cv, 6) AS cv, coalesce(cv >= 0.15, false) AS used FROM cv""").replace("\n,", ",", 1),
    "hot_detail": with_areas("""SELECT code, name, n, median_price_m2 FROM (SELECT district_code, count(*) AS n FROM silver GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) JOIN areas ON code = district_code AND level = 'district'"""),
}
