"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the jobs rely on: UTC, adaptive plans, no guessing of partition types."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="marlstone-code-")) / "marlstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._marlstone_shipped = True


def shared_folder(sc) -> str:
    """The checkpoints' folder in spark.checkpoint.dir. One of our own is set only in a local session that has none, as in tests."""
    if not sc.getCheckpointDir():
        if not sc.getConf().get("spark.checkpoint.dir") and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: later plans begin there."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """df as Parquet files in the shared folder: for rows that are read many times, by a few columns each time.

    A checkpoint's rows are read whole, object by object; these by column. How rows were dealt out is not kept.
    """
    path = f"{shared_folder(df.sparkSession.sparkContext)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
