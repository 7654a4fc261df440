"""Queries over addresses, codes and the event stream as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.fixtures import table
from marlstone.operators import geo, gold
from marlstone.operators.quantiles import group_values
from marlstone.streaming import hot_path


def dims(spark, sf):
    r, n, s = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    code = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    return geo.dimensions(
        r.select(code("r_regionkey", 2).alias("code"), F.col("r_name").alias("name")),
        n.select(code("n_nationkey", 3).alias("code"), F.col("n_name").alias("name"), code("n_regionkey", 2).alias("province_code")),
        s.select(code("s_suppkey", 5).alias("code"), F.col("s_name").alias("name"), code("s_nationkey", 3).alias("district_code")),
    )


def addresses(spark, sf):
    """Every line item's place written as an address: ward, district, province."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("Phường "), "s_name", F.lit(" ,Quận "), F.lower("n_name"), F.lit("/ TỈNH "), F.initcap("r_name"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("address_raw"))


def resolved(spark, sf):
    found = geo.resolve_addresses(addresses(spark, sf), dims(spark, sf))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "province_code", "district_code", "ward_code", "geo_match_score", "geo_source")


def word(column: str):
    """Ten letters for a name: no two are alike."""
    return F.substring(F.translate(F.sha1(F.col(column).cast("binary")), "0123456789", "ghijklmnop"), 1, 10)


def varied(spark, sf):
    """Every line item's place, spelled by its number in the order so that each tier is reached, and some without a place."""
    r, n, s = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    code = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    named = lambda unit, c: F.concat(F.lit(unit), word(c)).alias("name")
    levels = geo.dimensions(
        r.select(code("r_regionkey", 2).alias("code"), named("Tỉnh ", "r_name")),
        n.select(code("n_nationkey", 3).alias("code"), named("Quận ", "n_name"), code("n_regionkey", 2).alias("province_code")),
        s.select(code("s_suppkey", 5).alias("code"), named("Phường ", "s_name"), code("s_nationkey", 3).alias("district_code")),
    )
    ends = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"), F.max("n_nationkey").alias("high"))
    merged = [(x.p, "cu xua", x.c, "old") for x in ends.select(code("n_regionkey", 2).alias("p"), code("low", 3).alias("c")).collect()]  # one row a region
    wards = ends.select(F.lit("x").alias("new_province_key"), F.concat(F.lit("moi"), code("n_regionkey", 2)).alias("new_ward_key"), code("n_regionkey", 2).alias("province_code"), F.lit("x").alias("province"), code("high", 3).alias("district_code"), F.lit("new").alias("district"), F.lit(0.75).alias("confidence"), F.lit(2).alias("n_candidates"))
    r, n, s = r.withColumn("p", word("r_name")), n.withColumn("d", word("n_name")), s.withColumn("w", word("s_name"))  # once a place, not once a line item
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    p, d, w = F.col("p"), F.col("d"), F.col("w")
    spelled = {
        1: F.concat(F.lit("Số 5, P. "), w, F.lit(", Q. "), d, F.lit("; T. "), p), 2: F.concat(F.upper(d), F.lit("/ TỈNH "), p), 3: F.concat(F.lit("quan "), F.substring(d, 1, 9), F.lit(", "), p),
        4: F.concat(F.lit("Quận "), d), 5: F.concat(F.lit("Quận Cũ Xưa, "), p), 6: F.concat(F.lit("Phường Mới"), code("r_regionkey", 2), F.lit(", "), p),
    }
    text = F.lit(None).cast("string")
    for k, v in spelled.items():
        text = F.when(F.col("l_linenumber") == k, v).otherwise(text)
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("address_raw"))
    found = geo.resolve_addresses(rows, levels, wards, merged)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "province_code", "district_code", "ward_code", F.round("geo_match_score", 6).alias("geo_match_score"), "geo_source")


def bridge(spark, sf):
    """Parts as new wards, suppliers as old ones: the nation that supplies most of a part."""
    moves = table(spark, sf, "lineitem").select(F.lit("p").alias("new_province_key"), F.col("l_partkey").alias("new_ward_key"), F.col("l_suppkey").alias("old_ward_code"))
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    units = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    units = units.select(F.col("s_suppkey").alias("ward_code"), F.col("n_nationkey").alias("district_code"), F.col("n_name").alias("district"), F.col("r_regionkey").alias("province_code"), F.col("r_name").alias("province"))
    return geo.build_bridge(moves, units).select("new_ward_key", "district_code", "confidence", "n_candidates")


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("event_type").alias("district"), F.col("value").alias("price_per_m2"), F.col("ts").cast("timestamp").alias("event_time"))


def baseline(spark, sf):
    return group_values(events(spark, sf), ["district"], {"median_price_m2": gold.MEDIAN})


def windows(spark, sf):
    rows = hot_path.velocity(events(spark, sf))
    return rows.select(F.to_timestamp_ntz(F.date_format("win_start", "yyyy-MM-dd HH:mm:ss")).alias("win_start"), "district", "n", F.round("avg_price", 6).alias("avg_price"), "min_price", "max_price")


def hottest(spark, sf):
    """The districts by the size of their latest window."""
    return gold.hottest(hot_path.latest_window(hot_path.velocity(events(spark, sf)))).select("district", "n", F.round("avg_price", 6).alias("avg_price"))


def alerts(spark, sf):
    found = hot_path.price_alerts(events(spark, sf), baseline(spark, sf))
    return found.select("event_id", "district", F.round("deviation", 6).alias("deviation"), "severity", "reason")


def newest(spark, sf):
    return gold.newest_alerts(hot_path.price_alerts(events(spark, sf), baseline(spark, sf))).select("event_id", "severity")


def short_names(spark, sf):
    """Each supplier's nation with a letter too many, its first one missing, or as it is, and the region."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("s_suppkey") % 3
    name = F.when(kind == 0, F.concat("n_name", F.lit("x"))).when(kind == 1, F.substring("n_name", 2, 100)).otherwise(F.col("n_name"))
    found = geo.resolve_addresses(rows.select("s_suppkey", F.concat(F.lit("Số 9, Quận "), name, F.lit(", "), "r_name").alias("address_raw")), dims(spark, sf))
    return found.select("s_suppkey", "district_code", F.round(F.when(F.col("district_code").isNotNull(), F.col("geo_match_score")), 6).alias("score"))


def alert_json(spark, sf):
    found = hot_path.price_alerts(events(spark, sf), baseline(spark, sf)).select("event_id", "district", "severity")
    return hot_path.alerts_as_events(found, "event_id")


QUERIES = {
    "resolve_addresses": resolved,
    "resolve_varied": varied,
    "resolve_short_names": short_names,
    "build_bridge": bridge,
    "velocity": windows,
    "hottest": hottest,
    "price_alerts": alerts,
    "newest_alerts": newest,
    "alerts_as_events": alert_json,
}
ALERTS = """base AS (SELECT event_type AS district, quantile_disc(value, 0.5) AS m FROM events GROUP BY 1),
alerts AS (SELECT event_id, ts, event_type AS district, (value - m) / m AS d FROM events JOIN base ON event_type = district WHERE abs((value - m) / m) >= 0.6),
tiers AS (SELECT *, CASE WHEN abs(d) >= 1.5 THEN 'cao' WHEN abs(d) >= 1 THEN 'trung binh' ELSE 'thap' END AS severity FROM alerts)"""
WINDOWS = """w AS (SELECT time_bucket(INTERVAL 5 minute, ts) - to_minutes((5 * i)::INTEGER) AS win_start, event_type AS district, count(*) AS n, avg(value) AS a, min(value) AS lo, max(value) AS hi
FROM events, range(12) r(i) GROUP BY 1, 2)"""
SQL = {
    "resolve_addresses": """SELECT l_orderkey, l_linenumber, l_partkey, lpad(n_regionkey::VARCHAR, 2, '0') AS province_code, lpad(n_nationkey::VARCHAR, 3, '0') AS district_code,
        lpad(s_suppkey::VARCHAR, 5, '0') AS ward_code, 100.0::DOUBLE AS geo_match_score, 'old' AS geo_source FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "resolve_short_names": """WITH a AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS kind, length(n_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        b AS (SELECT *, CASE kind WHEN 0 THEN 200 * n / (2 * n + 1) WHEN 1 THEN 200 * (n - 1) / (2 * n - 1) ELSE 100 END AS ratio FROM a)
        SELECT s_suppkey, CASE WHEN ratio >= 88 THEN lpad(s_nationkey::VARCHAR, 3, '0') END AS district_code, round(CASE WHEN ratio >= 88 THEN ratio END, 6)::DOUBLE AS score FROM b""",
    "resolve_varied": """WITH e AS (SELECT n_regionkey, min(n_nationkey) AS low, max(n_nationkey) AS high FROM nation GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 7 THEN lpad(n_regionkey::VARCHAR, 2, '0') END AS province_code,
          CASE l_linenumber WHEN 5 THEN lpad(low::VARCHAR, 3, '0') WHEN 6 THEN lpad(high::VARCHAR, 3, '0') WHEN 7 THEN NULL ELSE lpad(n_nationkey::VARCHAR, 3, '0') END AS district_code,
          CASE l_linenumber WHEN 1 THEN lpad(s_suppkey::VARCHAR, 5, '0') END AS ward_code, round([100, 100, 200 * 9 / 19, 90, 95, 75, 0][l_linenumber], 6)::DOUBLE AS geo_match_score,
          ['old', 'old', 'old', 'unique', 'dissolved', 'bridge2025', 'none'][l_linenumber] AS geo_source
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN e USING (n_regionkey)""",
    "build_bridge": """WITH v AS (SELECT DISTINCT l_partkey AS new_ward_key, l_suppkey FROM lineitem), c AS (SELECT new_ward_key, s_nationkey AS district_code, count(*) AS n FROM v JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        SELECT new_ward_key, district_code, round(n / sum(n) OVER p, 3) AS confidence, (count(*) OVER p)::INTEGER AS n_candidates FROM c WINDOW p AS (PARTITION BY new_ward_key)
        QUALIFY row_number() OVER (PARTITION BY new_ward_key ORDER BY n DESC, district_code) = 1""",
    "velocity": f"WITH {WINDOWS} SELECT win_start, district, n, round(a, 6) AS avg_price, lo AS min_price, hi AS max_price FROM w",
    "hottest": f"WITH {WINDOWS} SELECT district, arg_max(n, win_start) AS n, round(arg_max(a, win_start), 6) AS avg_price FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "price_alerts": f"WITH {ALERTS} SELECT event_id, district, round(d, 6) AS deviation, severity, CASE WHEN d < 0 THEN 'cheaper' ELSE 'dearer' END || ' than the district median by ' || round(abs(d) * 100)::BIGINT || ' %' AS reason FROM tiers",
    "newest_alerts": f"WITH {ALERTS} SELECT event_id, severity FROM tiers ORDER BY ts DESC, event_id LIMIT 200",
    "alerts_as_events": f"""WITH {ALERTS} SELECT event_id::VARCHAR AS key, '{{"event_id":' || event_id || ',"district":"' || district || '","severity":"' || severity || '"}}' AS value FROM tiers""",
}
