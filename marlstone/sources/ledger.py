"""Which offsets a table's batches hold: said before a batch is written, and closed after it.

A batch's entry is a small file in the table's folder _ledger, which Spark's readers pass over. The
one that is open says what a run that broke off was writing: the next run writes the same batch over
it, so that nothing is lost and nothing is there twice. One writer at a time: a second one fails.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import SparkSession

from marlstone.sources.offset_log import Offsets, from_json, to_json


@dataclass(frozen=True)
class Batch:
    """start and end: offsets as JSON, the end not included; position: where the next batch begins."""

    number: int
    start: str
    end: str
    position: str
    at: str

    @property
    def range(self) -> tuple[Offsets, Offsets]:
        return from_json(self.start), from_json(self.end)

    @property
    def now(self) -> datetime:
        return datetime.fromisoformat(self.at)


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.top = spark.sparkContext._jvm, f"{path.rstrip('/')}/_ledger"
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(""))) if self.fs.exists(self.path("")) else []

    def _read(self, name: str) -> Batch:
        stream = self.fs.open(self.path(name))
        try:
            return Batch(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def last(self) -> Batch | None:
        """The last batch that is closed."""
        done = [n for n in self._names() if n.endswith(".done")]
        return self._read(done[-1]) if done else None

    def open_batch(self) -> Batch | None:
        """The batch of a run that broke off."""
        names = set(self._names())
        left = [n for n in sorted(names) if n.endswith(".open") and n.replace(".open", ".done") not in names]
        return self._read(left[-1]) if left else None

    def position(self) -> Offsets:
        last = self.last()
        return from_json(last.position) if last else {}

    def begin(self, start: Offsets, end: Offsets, now: datetime) -> Batch:
        last = self.last()
        batch = Batch(last.number + 1 if last else 0, to_json(start), to_json(end), to_json(self.position() | end), now.isoformat())
        self._write(f"{batch.number:012d}.open", batch)
        return batch

    def finish(self, batch: Batch) -> None:
        self._write(f"{batch.number:012d}.done", batch)

    def _write(self, name: str, batch: Batch) -> None:
        """The whole file or none: written aside and renamed, which fails if the name is taken."""
        aside = self.path(f".{name}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(json.dumps(asdict(batch)).encode()))
        stream.close()
        if not self.fs.rename(aside, self.path(name)):
            raise FileExistsError(f"{self.top}/{name} is there already: another writer is at work")
