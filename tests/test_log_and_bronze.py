"""The folder log as a source with offsets, and bronze batches by a ledger."""

import json
import random
from datetime import datetime

import pytest

from marlstone.plans import jobs
from marlstone.sources import listings as src
from marlstone.sources import offset_log as ol
from marlstone.sources.ledger import Ledger
from marlstone.streaming import hot_path as hp

NOW = datetime(2025, 1, 2, 3)
LOG = "topic string, partition int, offset long, timestamp timestamp, value string"


def put(spark, path, places, files=1):
    rows = [(t, p, o, NOW, f'{{"listing_id":"{t}-{p}-{o}","price":2.5}}') for t, p, o in places]
    spark.createDataFrame(rows, LOG).repartition(files).write.mode("append").parquet(path)


def places_of(df):
    return sorted((r.topic, r.partition, r.offset) for r in df.select("topic", "partition", "offset").collect())


def test_source_as_a_table(spark, tmp_path):
    path = f"{tmp_path}/log"
    all_places = [("t", p, o) for p in range(3) for o in range(40)] + [("u", 0, o) for o in range(7)]
    put(spark, path, all_places, 3)
    ol.register(spark)
    read = lambda **o: spark.read.format(ol.NAME).options(path=path, **o).load()
    assert places_of(read()) == sorted(all_places)
    start, end = {("t", 0): 5, ("t", 1): 40}, {("t", 0): 9, ("t", 1): 40, ("t", 2): 3, ("u", 0): 2}
    want = [("t", 0, o) for o in range(5, 9)] + [("t", 2, o) for o in range(3)] + [("u", 0, o) for o in range(2)]
    assert places_of(read(startingOffsets=ol.to_json(start), endingOffsets=ol.to_json(end))) == sorted(want)
    assert places_of(src.read_log(spark, path, start, end)) == sorted(want)
    assert places_of(src.read_log(spark, path, start)) == sorted(x for x in all_places if x[2] >= start.get(x[:2], 0))
    assert spark.read.format(ol.NAME).option("path", f"{tmp_path}/none").load().count() == 0
    assert read().first().key is None and read().schema.simpleString() == "struct<key:string,value:string,topic:string,partition:int,offset:bigint,timestamp:timestamp>"


def test_offsets_advance_by_records():
    piece = lambda p, first, last, rows=None: ol.Piece("f", 0, ("t", p), first, last, rows or last - first + 1)
    index = {("t", 0): [piece(0, 0, 99)], ("t", 1): [piece(1, 0, 9), piece(1, 1 << 33, (1 << 33) + 9)], ("t", 2): [piece(2, 5, 5)]}
    at, records = {}, {("t", 0): 100, ("t", 1): 20, ("t", 2): 1}
    seen = lambda place, a, b: sum(max(0, min(b, p.last + 1) - max(a, p.first)) for p in index[place])
    got = dict.fromkeys(index, 0)
    for _ in range(100):
        new = ol.advance(at, index, 7)
        step = {place: seen(place, at.get(place, 0), new.get(place, 0)) for place in index}
        assert sum(step.values()) <= 7
        got = {k: got[k] + v for k, v in step.items()}
        if new == at:
            break
        at = new
    assert got == records and at == ol.ends(index)


def test_random_logs_are_read_once(spark, tmp_path):
    draw = random.Random(2)
    index = {}
    for p in range(4):
        at = 0
        for _ in range(draw.randrange(1, 6)):
            at += draw.choice([0, 0, 3, 50])
            n = draw.randrange(1, 30)
            index.setdefault(("t", p), []).append(ol.Piece(f"f{p}", at, ("t", p), at, at + n - 1, n))
            at += n
    at, ranges = {}, []
    while (new := ol.advance(at, index, 11)) != at:
        ranges += [(r.piece.place, o) for r in ol.ranges(index, at, new) for o in range(max(r.start, r.piece.first), min(r.end, r.piece.last + 1))]
        at = new
    assert sorted(ranges) == sorted((k, o) for k, v in index.items() for p in v for o in range(p.first, p.last + 1))


def run_stream(spark, path, ckpt, out, most=2000):
    """The sizes of the micro-batches until nothing is left."""
    sizes = []

    def keep(batch, number):
        rows = batch.collect()
        sizes.append(len(rows))
        out.extend((r.topic, r.partition, r.offset) for r in rows)

    while True:
        log = hp.log_stream(spark, path, most, ckpt=ckpt)
        q = log.writeStream.foreachBatch(keep).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        if not sum(p.numInputRows for p in q.recentProgress):
            return sizes


def test_stream_takes_so_many_records_and_restarts(spark, tmp_path):
    path, ckpt, out = f"{tmp_path}/log", f"{tmp_path}/ckpt", []
    first = [("t", p, o) for p in range(3) for o in range(1500)]
    put(spark, path, first, 2)
    sizes = run_stream(spark, path, ckpt, out)
    assert len(sizes) == 3 and max(sizes) == 2000 and sorted(out) == sorted(first)
    more = [("t", p, o) for p in range(1, 4) for o in range(1500, 1510)] + [("t", 3, 0)]
    put(spark, path, more)
    assert run_stream(spark, path, ckpt, out) == [31] and sorted(out) == sorted(first + more)
    assert run_stream(spark, path, ckpt, out) == []


def test_stream_with_a_trigger_of_time(spark, tmp_path):
    """Micro-batches of one query go on by themselves, and the next query takes up where it stopped."""
    path, ckpt, sizes, out = f"{tmp_path}/log", f"{tmp_path}/ckpt", [], []

    def keep(batch, number):
        rows = batch.collect()
        sizes.append(len(rows))
        out.extend(r.offset for r in rows)

    for part in range(2):
        put(spark, path, [("t", 0, o) for o in range(part * 50, part * 50 + 50)])
        q = hp.log_stream(spark, path, 20, ckpt=ckpt).writeStream.foreachBatch(keep).option("checkpointLocation", ckpt).trigger(processingTime="0 seconds").start()
        for _ in range(600):
            if len(out) >= (part + 1) * 50 or q.exception():
                break
            q.awaitTermination(0.2)
        q.stop()
        assert q.exception() is None
    assert sorted(out) == list(range(100)) and max(sizes) == 20


def test_bronze_reads_only_what_is_new(spark, tmp_path):
    log, bronze = f"{tmp_path}/log", f"{tmp_path}/bronze"
    put(spark, log, [("t", p, o) for p in range(2) for o in range(5)])
    assert jobs.run_bronze(spark, log, bronze, NOW) == {"rows_in": 10, "rows_out": 10}
    assert jobs.run_bronze(spark, log, bronze, NOW) == {"rows_in": 0, "rows_out": 0}
    put(spark, log, [("t", 1, 5), ("t", 2, 0)])
    assert jobs.run_bronze(spark, log, bronze, NOW) == {"rows_in": 2, "rows_out": 2}
    assert places_of(src.bronze_table(spark, bronze)) == sorted([("t", p, o) for p in range(2) for o in range(5)] + [("t", 1, 5), ("t", 2, 0)])
    plan = src.read_log(spark, log, Ledger(spark, bronze).position())._jdf.queryExecution().executedPlan().toString()
    assert "offset" in plan.split("PushedFilters:")[1].splitlines()[0]


def test_a_run_that_breaks_off_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    log, bronze = f"{tmp_path}/log", f"{tmp_path}/bronze"
    put(spark, log, [("t", 0, o) for o in range(4)])
    jobs.run_bronze(spark, log, bronze, NOW)
    put(spark, log, [("t", 0, o) for o in range(4, 9)])
    with monkeypatch.context() as m:
        m.setattr(Ledger, "finish", lambda self, batch: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):  # the data is there, the ledger's entry is open
            jobs.run_bronze(spark, log, bronze, NOW)
    assert src.bronze_table(spark, bronze).count() == 4
    put(spark, log, [("t", 0, 9)])
    later = datetime(2025, 1, 5)
    assert jobs.run_bronze(spark, log, bronze, later) == {"rows_in": 5, "rows_out": 5}
    assert jobs.run_bronze(spark, log, bronze, later) == {"rows_in": 1, "rows_out": 1}
    assert places_of(src.bronze_table(spark, bronze)) == places_of(spark.read.parquet(bronze)) == [("t", 0, o) for o in range(10)]


def test_a_second_writer_fails(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/bronze")
    batch = ledger.begin({}, {("t", 0): 3}, NOW)
    with pytest.raises(FileExistsError):
        Ledger(spark, f"{tmp_path}/bronze").begin({}, {("t", 0): 3}, NOW)
    ledger.finish(batch)
    assert ledger.position() == {("t", 0): 3} and ledger.open_batch() is None
    assert Ledger(spark, f"{tmp_path}/bronze").begin({("t", 0): 3}, {("u", 0): 1}, NOW).number == 1


def test_replays_into_one_log_go_on(spark, tmp_path):
    log, bronze = f"{tmp_path}/log", f"{tmp_path}/bronze"
    events = lambda name, n: spark.createDataFrame([(f"{name}{i}", json.dumps({"listing_id": f"{name}{i}", "price": 1.0})) for i in range(n)], "key string, value string").repartition(3)
    for name, n in (("a", 5), ("b", 7), ("c", 1)):
        src.write_log(events(name, n), log)
        result = jobs.run_bronze(spark, log, bronze, NOW)
        assert result == {"rows_in": n, "rows_out": n}
    rows = spark.read.parquet(log).collect()
    by = {}
    for r in rows:
        by.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())  # no gaps, none twice
    assert sorted(r.listing_id for r in spark.read.parquet(bronze).collect()) == sorted([f"a{i}" for i in range(5)] + [f"b{i}" for i in range(7)] + ["c0"])
    src.write_log(events("d", 2), log, topic="other")
    assert jobs.run_bronze(spark, log, bronze, NOW)["rows_out"] == 2
