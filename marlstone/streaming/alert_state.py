"""Keyed state with a time to live: of the alerts of a listing only the first goes out, across micro-batches, restarts and replays."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds for which a listing that had its alert raises no other one.
QUIET_SECONDS = 7 * 24 * 3600


class FirstOfKey(StatefulProcessor):
    """The first row of a key by the order columns; nothing more until the key's state has expired."""

    def __init__(self, names: Sequence[str], order: Sequence[str], ttl_seconds: int):
        self.names, self.order, self.ttl_seconds = list(names), list(order), ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "at timestamp", ttlDurationMs=self.ttl_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.sent.exists():
            return
        # one row at a time: the rows of a key are never held together
        first = min(rows, key=lambda r: [(r[c] is None, () if r[c] is None else (r[c],)) for c in self.order])
        self.sent.update((first["_at"],))
        yield Row(**{c: first[c] for c in self.names})

    def close(self) -> None:
        pass


def first_alerts(alerts: DataFrame, ttl_seconds: int = QUIET_SECONDS, key: str = "listing_id", order: Sequence[str] = ("event_time", "price_per_m2")) -> DataFrame:
    """Of a stream of alerts, the first of each key, and no other one until ttl_seconds of processing time have passed.

    Of several in a micro-batch the least by order goes out (nulls last). Rows without a key are
    told apart by all their values. State is a timestamp per key; it needs the RocksDB provider
    (see keyed_state) when the query starts.
    """
    names = alerts.columns
    own = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("r"), F.sha2(F.to_json(F.struct(*names)), 256)))
    keyed = alerts.withColumns({"_key": own, "_at": F.current_timestamp()})
    processor = FirstOfKey(names, order, ttl_seconds)
    return keyed.groupBy("_key").transformWithState(processor, alerts.schema, "Append", "ProcessingTime")


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB and run no batches without data.

    A query copies the session's settings when it starts. Without the second one, a query by
    processing time that takes what is available never ends; expired state goes with later data.
    """
    settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
