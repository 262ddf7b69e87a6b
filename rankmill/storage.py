"""Tables in the folder that all executors share: written once, read again, and deleted when they have served."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session while a table is written, and only then: shuffle files of a write aren't needed after it, and
#: rows go to Python in small batches (which Spark bounds in bytes as well).
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_lock, _writers, _before = threading.Lock(), {}, {}
#: Folders of the tables written for each application.
_tables: dict[str, set[str]] = {}


class StorageError(RuntimeError):
    """No folder that all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a folder of this machine if Spark runs in this process alone, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "rankmill-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _enter(spark: SparkSession) -> None:
    """Writers of several threads share one change of the settings."""
    key = spark._jsparkSession.hashCode()
    with _lock:
        if not _writers.get(key):
            _before[key] = {k: spark.conf.get(k, None) for k in SETTINGS}
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
        _writers[key] = _writers.get(key, 0) + 1


def _leave(spark: SparkSession) -> None:
    key = spark._jsparkSession.hashCode()
    with _lock:
        _writers[key] -= 1
        if not _writers[key]:
            for k, v in _before.pop(key).items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors cost nothing that is in it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _enter(spark)
    try:
        df.write.parquet(path)
    finally:
        _leave(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.rankmill_path = path
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what a caller writes; clear() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no result will read again."""
    for t in tables:
        path = getattr(t, "rankmill_path", None)
        if path:
            _delete(t.sparkSession, path)
            _tables.get(t.sparkSession.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this application's results stand on, once those have been read; how many there were."""
    own = _tables.pop(spark.sparkContext.applicationId, set())
    for path in own:
        _delete(spark, path)
    return len(own)
