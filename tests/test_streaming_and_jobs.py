from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import gold, lake
from marlstone.plans import jobs
from marlstone.streaming import hot_path as hp
from tests.test_geo import SCHEMA, TREE

START = datetime(2025, 1, 1, 12)
EVENT = "listing_id string, district string, price_per_m2 double, event_time timestamp"


def events(n, first=0, minutes=1):
    return [(f"l{i}", f"d{i % 3}", 100.0 + 40 * (i % 5), START + timedelta(minutes=minutes * i)) for i in range(first, first + n)]


def put(spark, path, rows, number):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def drain(queries):
    for q in queries:
        q.awaitTermination(120)
        assert q.exception() is None


def test_stream_equals_table_and_restarts(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    baseline = spark.createDataFrame([("d0", 150.0), ("d1", 60.0)], "district string, median_price_m2 double")
    schema = spark.createDataFrame([], EVENT).schema
    put(spark, source, events(60), 0)
    drain(hp.run_hot_path(hp.event_stream(spark, source, schema), baseline, out, ckpt))
    put(spark, source, events(60, 60), 1)
    drain(hp.run_hot_path(hp.event_stream(spark, source, schema), baseline, out, ckpt))
    table = spark.read.parquet(source)
    state = {r.district: (r.win_end, r.n) for r in hp.read_state(spark, f"{out}/velocity").collect()}
    want = {r.district: (r.win_end, r.n) for r in hp.latest_window(hp.velocity(table)).collect()}
    assert state == want
    assert hp.alert_count(spark, f"{out}/alerts") == hp.price_alerts(table, baseline).count() > 0
    drain(hp.run_hot_path(hp.event_stream(spark, source, schema), baseline, out, ckpt))
    assert hp.alert_count(spark, f"{out}/alerts") == hp.price_alerts(table, baseline).count()


def test_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], EVENT).schema
    for n, at in enumerate((0, 600, 1200)):
        put(spark, source, [("x", "d", 1.0, START + timedelta(minutes=at))], n)
    put(spark, source, [("late", "d", 9.0, START)], 3)
    rows = []
    q = hp.velocity(hp.event_stream(spark, source, schema)).writeStream.outputMode("append").foreachBatch(lambda b, i: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain([q])
    early = [r for r in rows if r.win_end <= START + timedelta(hours=1)]
    assert early and {(r.max_price, r.n) for r in early} == {(1.0, 1)}  # the late row of 9.0 is in no window


def test_merge_keeps_the_newest_window(spark, tmp_path):
    path = str(tmp_path / "s")
    row = lambda end, n: (START, START + timedelta(minutes=end), "d", n, 1.0, 1.0, 1.0, 1.0)
    names = "win_start timestamp, win_end timestamp, district string, n long, avg_price double, min_price double, max_price double, median_price double"
    for i, r in enumerate([row(60, 5), row(30, 9), row(60, 7)]):
        for _ in range(2):  # a batch that runs again changes nothing
            hp.merge_state(spark.createDataFrame([r], names), i, path)
    r = hp.read_state(spark, path).first()
    assert (r.win_end, r.n) == (START + timedelta(minutes=60), 7)
    assert hp.read_state(spark, path, ttl_seconds=900, now=datetime(2100, 1, 1)).count() == 0
    assert hp.read_state(spark, str(tmp_path / "none")) is None and hp.load_baseline(spark, str(tmp_path / "none")) is None


def test_alert_tiers(spark):
    rows = spark.createDataFrame([("a", "d", p, START) for p in (39.0, 41.0, 160.0, 200.0, 250.0)], EVENT)
    base = spark.createDataFrame([("d", 100.0)], "district string, median_price_m2 double")
    found = hp.price_alerts(rows, base).orderBy("price_per_m2").collect()
    assert [r.severity for r in found] == ["thap", "thap", "trung binh", "cao"]
    assert found[0].reason == "cheaper than the district median by 61 %"


@pytest.fixture(scope="module")
def lake_run(spark, tmp_path_factory):
    from marlstone.operators import geo

    top = tmp_path_factory.mktemp("lake")
    value = lambda i, v: '{"listing_id":"l%d","source":"s","address_raw":"Phường Bến Nghé, %s, TP.HCM","area":%d,"price":%f,"floors":2,"access_road":5,"legal_status":"Have certificate"}' % (i, "Quận 1" if i % 2 else "Quận 10", 40 + i % 5, v)
    values = [value(i, 4.0 + i % 7) for i in range(80)] + ["broken"] + [value(0, 9.0)]
    rows = [("t", 0, i, START + timedelta(minutes=i), v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value string").write.parquet(f"{top}/log")
    first = jobs.run_bronze(spark, f"{top}/log", f"{top}/bronze", START)
    again = jobs.run_bronze(spark, f"{top}/log", f"{top}/bronze", START)
    dims = geo.flatten_units(spark.createDataFrame(TREE, SCHEMA))
    silver = jobs.run_silver(spark, spark.read.parquet(f"{top}/bronze"), f"{top}/silver", dims)
    return top, first, again, silver, jobs.run_gold(spark.read.parquet(f"{top}/silver"), f"{top}/gold")


def test_jobs(spark, lake_run):
    top, first, again, silver, found = lake_run
    assert first == {"rows_in": 82, "rows_out": 81} and again == {"rows_in": 0, "rows_out": 0}
    assert (silver["rows_in"], silver["rows_out"], silver["district_rate"]) == (81, 80, 1.0)
    rows = spark.read.parquet(f"{top}/silver")
    assert set(rows.columns) == set(lake.SILVER_COLUMNS)
    assert rows.where("listing_id = 'l0'").first().price == 9.0  # the later of two versions of one run
    assert found == {"rows_in": 80, "rows_out": 80}
    areas = spark.read.parquet(f"{top}/gold/area_price")
    assert {(r.level, r.n_listings) for r in areas.collect()} == {("province", 80), ("district", 40), ("ward", 40)}
    block = jobs.overview(spark, f"{top}/gold")
    assert block["hot"] is None and block["clusters"] is None and block["top_districts"].count() == 2
    log = lake.dq_row(spark, "silver", silver).withColumn("run_at", F.lit(START))
    assert jobs.last_runs(log).first().rows_dropped == 1


def test_partitions_are_pruned(spark, lake_run):
    top = lake_run[0]
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    plan = spark.read.parquet(f"{top}/silver").where("province_code = '79' and price > 5").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(province_code" in plan and "PushedFilters: [IsNotNull(price), GreaterThan(price,5.0)]" in plan
    assert spark.read.parquet(f"{top}/silver").select("province_code").first()[0] == "79"


def test_limits_are_clamped():
    assert [gold.clamp(x, 1, 500) for x in (-1, 0, 7, 900)] == [1, 1, 7, 500]


def test_from_the_log_to_districts_and_alerts(spark, tmp_path):
    from marlstone.operators import geo

    source, out, ckpt = (str(tmp_path / x) for x in ("log", "out", "ckpt"))
    value = lambda i: '{"listing_id":"l%d","source":"s","address_raw":"%s","area":50,"price":%f,"crawled_at":"%s"}' % (i, ["Q7, TP.HCM", "P.1, TP.HCM", "Q.1, Sài Gòn", "Quận 10, tp hcm"][i % 4], 2.0 + i % 9, START + timedelta(minutes=i))
    dims = geo.flatten_units(spark.createDataFrame(TREE, SCHEMA))
    baseline = spark.createDataFrame([("760", 60.0), ("771", 100.0)], "district string, median_price_m2 double")
    records, sent = [], []
    for part in range(2):
        values = [value(i) for i in range(part * 40, part * 40 + 40)] + ["broken"]
        rows = [("t", 0, part * 100 + i, START + timedelta(days=300), v) for i, v in enumerate(values)]
        records += rows
        spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value string").coalesce(1).write.mode("append").parquet(source)
        drain([hp.run_placement(hp.log_stream(spark, source, per_trigger=25, ckpt=f"{ckpt}/placed"), dims, f"{out}/placed", f"{ckpt}/placed")])
        drain(hp.run_hot_path(hp.placed_stream(spark, f"{out}/placed"), baseline, out, ckpt, sink=lambda e, i: sent.extend(r.key for r in e.collect())))
    log = spark.createDataFrame(records, "topic string, partition int, offset long, timestamp timestamp, value string")
    table = hp.placed_events(hp.priced_events(log), dims)
    assert {(r.district, r.district_name) for r in table.select("district", "district_name").distinct().collect()} == {("760", "Quận 1"), ("771", "Quận 10")}
    assert table.count() == 40 and table.where("price_per_m2 is null or event_time > '2025-02-01'").count() == 0
    state = {r.district: (r.win_end, r.n) for r in hp.read_state(spark, f"{out}/velocity").collect()}
    assert state == {r.district: (r.win_end, r.n) for r in hp.latest_window(hp.velocity(table)).collect()}
    alerts = {r.listing_id for r in hp.price_alerts(table, baseline).collect()}
    assert hp.alert_count(spark, f"{out}/alerts") == len(alerts) > 0 and sorted(sent) == sorted(alerts)
    assert {r.listing_id for r in hp.read_state(spark, f"{out}/newest").collect()} == alerts
    assert len(hp._versions(spark, f"{out}/newest")) <= 2 and len(hp._versions(spark, f"{out}/velocity")) <= 2


def test_newest_alerts_are_kept(spark, tmp_path):
    rows = lambda first: spark.createDataFrame([(f"a{i}", START + timedelta(minutes=i)) for i in range(first, first + 5)], "listing_id string, event_time timestamp")
    for batch, first in enumerate((0, 20, 10)):
        hp.merge_newest(rows(first), batch, str(tmp_path), most=7)
    assert {r.listing_id for r in hp.read_state(spark, str(tmp_path)).collect()} == {"a20", "a21", "a22", "a23", "a24", "a14", "a13"}


def test_replay_of_a_csv_file(spark, tmp_path):
    from marlstone.sources import listings as src

    (tmp_path / "x.csv").write_text('Địa chỉ,Diện tích,Giá\n"12 A, Q1, TP.HCM","45,5",3.2\n,50,2\n"Q7, TP.HCM",4,2\n"Q10, TP.HCM",60,6\n')
    events, counts = src.replay_csv(spark, f"{tmp_path}/x.csv")
    assert tuple(counts.first()) == (4, 2)
    src.write_log(events, f"{tmp_path}/log")
    result = jobs.run_bronze(spark, f"{tmp_path}/log", f"{tmp_path}/bronze", START)
    assert result == {"rows_in": 2, "rows_out": 2} and spark.read.parquet(f"{tmp_path}/bronze").where("price_per_m2 > 70").count() == 2
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        src.replay_csv(spark, f"{tmp_path}/y.csv")


def test_an_empty_log(spark, tmp_path):
    spark.createDataFrame([], "topic string, partition int, offset long, timestamp timestamp, value string").write.parquet(f"{tmp_path}/log")
    assert jobs.run_bronze(spark, f"{tmp_path}/log", f"{tmp_path}/bronze", START) == {"rows_in": 0, "rows_out": 0}


def test_serving_tables_over_jdbc(spark, tmp_path):
    """Spark brings Derby along: write, overwrite by truncation, append and read back."""
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "level VARCHAR(32), code VARCHAR(32)"}
    rows = lambda *codes: spark.createDataFrame([("district", c, 10.0) for c in codes], "level string, code string, median_price_m2 double")
    assert jobs.read_serving(spark, "", "area_price", jdbc) is None and hp.load_baseline(spark, "x", jdbc) is None
    for mode, df in (("overwrite", rows("a", "b", "c")), ("overwrite", rows("d")), ("append", rows("e"))):
        jobs.write_serving(df, "", "area_price", mode, jdbc)
    assert {r.code for r in jobs.read_serving(spark, "", "area_price", jdbc).collect()} == {"d", "e"}
    assert sorted(tuple(r) for r in hp.load_baseline(spark, "x", jdbc).collect()) == [("d", 10.0), ("e", 10.0)]


def test_clusters_for_serving(spark, tmp_path):
    path = str(tmp_path)
    districts = spark.createDataFrame([(f"{i:03d}", f"D{i}", 20.0 + 100 * (i // 6) + i, 50.0 + i % 2, 2.0 + i // 6, 0.5, 0.1 * (i % 3)) for i in range(18)], "district_code string, district string, median_price_m2 double, mean_area double, mean_floors double, pct_red_book double, pct_mat_tien double")
    found = jobs.run_clusters(districts, path)
    assert "mean_area" not in found["features"] and 2 <= found["k"] <= 6
    rows = jobs.overview(spark, path)["clusters"].collect()
    assert len(rows) == 18 and all(r.label and r.x is not None and r.y is not None for r in rows)
    one = jobs.run_clusters(districts.withColumns({"mean_floors": F.lit(2.0), "pct_mat_tien": F.lit(0.5)}), f"{path}/one")
    assert one["features"] == ["median_price_m2"] and one["explained"] == 1.0


def test_anomalies_for_serving(spark, tmp_path):
    path = str(tmp_path)
    listings = spark.createDataFrame([(f"l{i}", "001", "D", 5.0 if i else 50.0, 100.0, 5.0, float(i % 7) if i else 900.0, float(i % 11)) for i in range(120)], "listing_id string, district_code string, district string, price double, price_per_m2 double, predicted double, a double, b double")
    assert jobs.run_anomalies(listings, path, ["a", "b"], contamination=1 / 120) == {"rows_in": 120, "rows_out": 1}
    worst = spark.read.parquet(f"{path}/anomaly").first()
    assert worst.listing_id == "l0" and worst.score == 100.0 and worst.reason == "price higher than predicted by 900 %" and worst.lof_score is None
    jobs.run_anomalies(listings, path, ["a", "b"], contamination=1 / 120, also=("lof",))
    worst = spark.read.parquet(f"{path}/anomaly").first()
    assert worst.reason == "price higher than predicted by 900 %; unusual by local density" and worst.lof_score > 1 and worst.forest_score is None
    blended = jobs.run_anomalies(listings, f"{path}/blend", ["a", "b"], {"residual": 0.5, "forest": 0.25, "lof": 0.25}, contamination=0.1)
    assert blended["rows_out"] >= 12
    assert spark.read.parquet(f"{path}/blend/anomaly").where("forest_score is null or lof_score is null").count() == 0


def test_forecasts_for_serving(spark, tmp_path):
    path = str(tmp_path)
    history = spark.createDataFrame([(a, (START + timedelta(days=31 * i)).date().replace(day=1), 50.0 + i * (a == "A")) for a in "AB" for i in range(24)], "area_code string, ds date, price_m2 double")
    jobs.run_forecasts(history, path)
    tables = [spark.read.parquet(f"{path}/{n}") for n in ("price_history", "forecast", "forecast_metrics")]
    bundle = jobs.forecast_bundle(*tables, area="A")
    assert bundle["history"].count() == 24 and {r.area_code for r in bundle["forecast"].collect()} == {"A"}
    metrics = bundle["metrics"].collect()
    assert metrics == sorted(metrics, key=lambda r: (r.mape_mean, r.model)) and sum(r.is_best for r in metrics) == 1
    assert bundle["forecast"].groupBy("model").count().where("count <> 3").count() == 0
    assert jobs.forecast_bundle(*tables)["history"].first().area_code == "A"
