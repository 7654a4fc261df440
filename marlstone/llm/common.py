"""What the operators of this subpackage share: sessions, shared folders, Arrow helpers."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds a worker's memory where single texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in a local session that has none, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return settle_at(df, work_dir(df.sparkSession, name))


def settle_at(df: DataFrame, path: str) -> DataFrame:
    """As settle, at a path. The shuffles that led to the table are removed with the query that writes it."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own in the shared folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def file_system(uri: str):
    """The file system and the path in it of a URI or a plain path, for use inside tasks."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def scratch():
    """A folder of the task's own that goes when the task ends, whether or not it succeeds."""
    path = tempfile.mkdtemp(prefix="task-", dir=os.environ.get("TMPDIR") or None)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty: crosses to Python without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def crc_mod(column: str, n: int):
    """crc32 of the column's value as decimal text, modulo n (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


class WordCache(dict):
    """What make() gives for a word, kept by a worker in two generations of bounded size.

    Use self[word]. When the younger generation is full it becomes the older one, and what is
    asked for again moves back. Long words are made anew each time.
    """

    def __init__(self, limit: int, longest: int = 100):
        self.limit, self.longest, self.older = limit, longest, {}

    def make(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
            if len(word) > self.longest:
                return made
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made


def hash_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hash of the column: bounded, and the same each time."""
    return df.orderBy(F.xxhash64(F.lit(17), column), column).limit(most)
