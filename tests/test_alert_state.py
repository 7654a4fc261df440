import time
from datetime import timedelta

from marlstone.streaming import hot_path as hp
from marlstone.streaming.alert_state import PROVIDER
from tests.test_streaming_and_jobs import EVENT, START, drain


def run(spark, top, rows, quiet):
    """Append rows as a file and run the hot path to its end, as a new query each time."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{top}/in")
    base = spark.createDataFrame([("d", 100.0)], "district string, median_price_m2 double")
    before = spark.conf.get(PROVIDER, None)
    drain(hp.run_hot_path(hp.event_stream(spark, f"{top}/in", spark.createDataFrame([], EVENT).schema), base, f"{top}/out", f"{top}/ckpt", quiet=quiet))
    assert spark.conf.get(PROVIDER, None) == before
    return sorted((r.listing_id or "", r.price_per_m2) for r in spark.read.parquet(f"{top}/out/alerts").collect())


def row(listing, price, minutes=0):
    return (listing, "d", price, START + timedelta(minutes=minutes))


def test_a_listing_alerts_once_across_restarts_and_replays(spark, tmp_path):
    top = str(tmp_path)
    first = [row("a", 300.0, 5), row("a", 250.0, 1), row("b", 20.0), row("c", 110.0), row(None, 400.0), row(None, 500.0), row(None, 500.0)]
    # the earliest of a listing's events; rows without an id by their values
    want = [("", 400.0), ("", 500.0), ("a", 250.0), ("b", 20.0)]
    assert run(spark, top, first, 3600) == want
    assert run(spark, top, first, 3600) == want  # all of it replayed, by a query that was started again
    assert run(spark, top, [row("a", 900.0, 90), row("c", 300.0, 90)], 3600) == sorted([*want, ("c", 300.0)])


def test_an_expired_listing_alerts_again(spark, tmp_path):
    top = str(tmp_path)
    assert run(spark, top, [row("a", 300.0)], 1) == [("a", 300.0)]
    time.sleep(2)
    assert run(spark, top, [row("a", 310.0)], 1) == [("a", 300.0), ("a", 310.0)]


def test_a_hot_listing_and_an_empty_file(spark, tmp_path):
    top = str(tmp_path)
    assert run(spark, top, [row("a", 300.0, i) for i in range(2000)], 3600) == [("a", 300.0)]
    assert run(spark, top, [], 3600) == [("a", 300.0)]
