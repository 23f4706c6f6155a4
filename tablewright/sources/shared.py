"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine that has none gets a temporary folder; on a cluster a
    missing one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_LOCK, _HELD = threading.Lock(), {"writers": 0, "before": "false"}


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each is done; several threads may be inside."""
    with _LOCK:
        if not _HELD["writers"]:
            _HELD["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _HELD["writers"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _HELD["writers"] -= 1
            if not _HELD["writers"]:
                spark.conf.set(CLEANUP, _HELD["before"])


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written and read back: later passes see the same rows in the same places, and a lost executor
    costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tablewright/fixed-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    with _cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass
