"""The hot path: sliding-window velocity per district, and alerts on prices far from the baseline.

Events go from the log to placed events (decoded, priced, with their district), a folder of
micro-batches that is itself a stream's source; velocity and alerts read that stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions.listing import event_time
from marlstone.operators import geo, lake
from marlstone.plans.jobs import read_serving
from marlstone.session import ship
from marlstone.sources import listings as src
from marlstone.sources import offset_log
from marlstone.streaming.alert_state import first_alerts, keyed_state

# Windows, and the deviations from which an alert is raised and is worse.
WINDOW, SLIDE, LATE = "1 hour", "5 minutes", "2 hours"
DEVIATION, HIGH, MIDDLE = 0.60, 1.5, 1.0
PER_TRIGGER, TTL_SECONDS, NEWEST = 2000, 900, 200


def event_stream(spark: SparkSession, source: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many files in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)


def log_stream(spark: SparkSession, source: str, per_trigger: int = PER_TRIGGER, start: str = "earliest", ckpt: str | None = None) -> DataFrame:
    """A log as a stream, at most per_trigger records in each micro-batch: of a broker (host:port/topic), or of a folder of Parquet rows with the log's columns.

    start: earliest, latest, or JSON {topic: {partition: offset}}. ckpt: the checkpoint of the query
    that will read it, from which a folder's stream goes on.
    """
    if m := re.fullmatch(r"([\w.-]+:\d+)/([\w.-]+)", source):
        options = {"kafka.bootstrap.servers": m[1], "subscribe": m[2], "startingOffsets": start, "maxOffsetsPerTrigger": str(per_trigger)}
        return spark.readStream.format("kafka").options(**options).load()
    offset_log.register(spark)
    options = {"path": source, "startingOffsets": start, "maxOffsetsPerTrigger": str(per_trigger)} | ({"checkpoint": ckpt} if ckpt else {})
    return spark.readStream.format(offset_log.NAME).options(**options).load()


def priced_events(log: DataFrame) -> DataFrame:
    """Good events of a log, table or stream, with event_time and a unit price."""
    rows = src.good_events(src.decoded(log))
    return lake.with_unit_price(rows.withColumn("event_time", event_time()))


def placed_events(events: DataFrame, dims: geo.Dimensions, bridge: DataFrame | None = None) -> DataFrame:
    """Priced events of a table with district (its code) and district_name; those without a district go."""
    found = geo.resolve_addresses(events, dims, bridge).where("district_code is not null")
    return found.select(*(c for c in events.columns), F.col("district_code").alias("district"), F.col("district").alias("district_name"))


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch as a folder of its own; one that was written whole before is left as it is."""
    if batch_id not in _versions(batch.sparkSession, path):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_placement(log: DataFrame, dims: geo.Dimensions, out: str, ckpt: str, bridge: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """From a log's stream to a folder of placed events: each micro-batch's distinct addresses are resolved once.

    once: until the log has no more; the query that found nothing new is returned.
    """
    place = lambda b, i: append_batch(placed_events(b, dims, bridge), i, out)
    start = lambda: priced_events(log).writeStream.foreachBatch(place).option("checkpointLocation", ckpt).trigger(**trigger_of(once)).start()
    query = start()
    # a source with a limit of records gives one micro-batch to a query that takes what is available
    while once and (query.awaitTermination() or True) and sum(p.numInputRows for p in query.recentProgress):
        query = start()
    return query


def placed_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The stream of what run_placement has written."""
    schema = spark.read.parquet(path).drop("batch").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(path)


def trigger_of(once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": "10 seconds"}


def velocity(events: DataFrame, win: str = WINDOW, slide: str = SLIDE, late: str = LATE, key: str = "district") -> DataFrame:
    """Per district and window: count, mean, least, most and median unit price. Works on streams and tables.

    events: district, price_per_m2 and event_time (a timestamp).
    """
    if events.isStreaming:
        events = events.withWatermark("event_time", late)
    p = "price_per_m2"
    out = events.groupBy(F.window("event_time", win, slide).alias("w"), key).agg(F.count("*").alias("n"), F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.percentile_approx(p, 0.5).alias("median_price"))
    return out.select(F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), key, "n", "avg_price", "min_price", "max_price", "median_price")


def latest_window(velocity_rows: DataFrame, key: str = "district") -> DataFrame:
    names = [c for c in velocity_rows.columns if c != key]
    return velocity_rows.groupBy(key).agg(F.max_by(F.struct(*names), "win_end").alias("v")).select(key, "v.*")


def price_alerts(events: DataFrame, baseline: DataFrame, dev: float = DEVIATION, key: str = "district") -> DataFrame:
    """Events whose unit price is at least dev away from their district's median, with severity and reason.

    baseline: the key and median_price_m2, one row per district; Spark broadcasts it by its size.
    """
    joined = events.join(baseline.select(key, "median_price_m2"), key)
    d = F.try_divide(F.col("price_per_m2") - F.col("median_price_m2"), F.col("median_price_m2"))
    far = joined.withColumn("deviation", d).where(F.abs("deviation") >= dev)
    size = F.abs("deviation")
    severity = F.when(size >= HIGH, "cao").when(size >= MIDDLE, "trung binh").otherwise("thap")
    side = F.when(F.col("deviation") < 0, "cheaper").otherwise("dearer")
    text = F.concat(side, F.lit(" than the district median by "), F.round(size * 100).cast("long").cast("string"), F.lit(" %"))
    return far.withColumns({"severity": severity, "reason": text})


def alerts_as_events(alerts: DataFrame, key: str = "listing_id") -> DataFrame:
    return alerts.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def load_baseline(spark: SparkSession, path: str, jdbc: dict | None = None) -> DataFrame | None:
    """District medians of the gold table (over JDBC: of the table area_price); None without one, and the stream then runs without alerts."""
    top, name = path.rstrip("/").rsplit("/", 1) if "/" in path else ("", path)
    gold = read_serving(spark, top, "area_price" if jdbc else name, jdbc)
    if gold is None:
        return None
    return gold.where("level = 'district'").select(F.col("code").alias("district"), "median_price_m2")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    done = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def read_state(spark: SparkSession, path: str, ttl_seconds: int | None = None, now=None) -> DataFrame | None:
    """The newest whole version of the latest-window table; rows past their time are left out."""
    found = _versions(spark, path)
    if not found:
        return None
    rows = spark.read.parquet(f"{path}/batch={found[-1]}")
    if ttl_seconds is not None:
        at = F.lit(now) if now is not None else F.current_timestamp()
        rows = rows.where(F.col("updated_at") >= at - F.expr(f"interval {ttl_seconds} seconds"))
    return rows


def merge_state(batch: DataFrame, batch_id: int, path: str, key: str = "district") -> None:
    """Merge a micro-batch into the latest-window table, a version per batch: a batch that runs again writes the same version.

    An older window of a late batch does not replace a newer one.
    """
    spark = batch.sparkSession
    new = latest_window(batch, key).withColumn("updated_at", F.current_timestamp())
    before = [v for v in _versions(spark, path) if v < batch_id]
    if before:
        old = spark.read.parquet(f"{path}/batch={before[-1]}")
        both = old.unionByName(new)
        names = [c for c in both.columns if c != key]
        # of the same window the later count is the larger one
        new = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("win_end", "n", "updated_at")).alias("v")).select(key, "v.*")
    replace_version(new, batch_id, path)


def replace_version(df: DataFrame, version: int, path: str) -> None:
    """Write a version of a small state table; of the whole ones only the last two stay."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/batch={version}")
    jvm = spark.sparkContext._jvm
    for old in [v for v in _versions(spark, path) if v <= version][:-2]:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def append_alerts(batch: DataFrame, batch_id: int, path: str) -> None:
    """Alerts of a micro-batch in a folder of their own, with their number beside them; again the same for the same batch."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def alert_count(spark: SparkSession, path: str) -> int:
    found = _versions(spark, path)
    return spark.read.parquet(*(f"{path}/batch={v}" for v in found)).count() if found else 0


def merge_newest(batch: DataFrame, batch_id: int, path: str, most: int = NEWEST) -> None:
    """The newest alerts over all batches, a version per batch."""
    spark = batch.sparkSession
    before = [v for v in _versions(spark, path) if v < batch_id]
    rows = spark.read.parquet(f"{path}/batch={before[-1]}").unionByName(batch) if before else batch
    replace_version(rows.orderBy(F.desc("event_time"), "listing_id").limit(most), batch_id, path)


def topic_sink(bootstrap: str, topic: str) -> Callable[[DataFrame, int], None]:
    """Alert records to a topic of a broker."""
    return lambda events, batch_id: events.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()


def fan_out(batch: DataFrame, batch_id: int, out: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Alerts of a micro-batch to their folder, to the list of the newest, and as records to a sink."""
    append_alerts(batch, batch_id, f"{out}/alerts")
    written = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/alerts/batch={batch_id}")
    merge_newest(written, batch_id, f"{out}/newest")
    if sink is not None:
        sink(alerts_as_events(written), batch_id)


def run_hot_path(events: DataFrame, baseline: DataFrame | None, out: str, ckpt: str, once: bool = True, sink: Callable[[DataFrame, int], None] | None = None, quiet: int | None = None) -> list[StreamingQuery]:
    """Two independent queries, each with its checkpoint: velocity (update) and alerts (append, if there is a baseline).

    quiet: seconds after an alert in which its listing raises no other one, also if its events are
    replayed; None: each event that is far from the baseline raises one.
    """
    start = lambda df, mode, name, write: df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{ckpt}/{name}").trigger(**trigger_of(once)).start()
    started = [start(velocity(events), "update", "velocity", lambda b, i: merge_state(b, i, f"{out}/velocity"))]
    if baseline is not None:
        alerts = price_alerts(events, baseline)
        write = lambda b, i: fan_out(b, i, out, sink)
        if quiet is None:
            started.append(start(alerts, "append", "alerts", write))
        else:
            ship(events.sparkSession)
            with keyed_state(events.sparkSession):
                started.append(start(first_alerts(alerts, quiet), "append", "alerts", write))
    return started


def describe(query: StreamingQuery) -> str:
    return json.dumps(query.lastProgress, default=str) if query.lastProgress else ""
