"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks.
FEW = 200_000
#: Paths that this process has made for its own tables, and temporary folders of its local sessions; they are removed when it ends.
_MADE: list[str] = []
_LOCAL: list[str] = []
#: The paths of tables that `written` has given.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Spark's setting by which shuffle files go when the job that made them has ended.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a cluster that would be out of the
    executors' sight, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        _LOCAL.append(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor recomputes nothing before it."""
    path = new_path(df.sparkSession, name)
    with tidy(df):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


@contextmanager
def tidy(df: DataFrame) -> Iterator[None]:
    """Within, a write of df leaves no shuffle files: they go when the job that made them has ended, not when the driver happens to
    collect its garbage. Its own session, such as a stream's, is told so."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES, None)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES)
        else:
            spark.conf.set(SHUFFLES, before)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that `written` has given and that nothing asks for any more."""
    for table in tables:
        if table is not None and (path := _PATHS.pop(table, None)):
            remove(table.sparkSession, path)


def few(df: DataFrame, name: str) -> DataFrame:
    """df as a table; broadcast if its rows have been counted as few, so that what it meets, such as texts, need not be shuffled."""
    table = written(df, name)
    if table.count() > FEW:
        return table
    sent = F.broadcast(table)
    _PATHS[sent] = _PATHS.pop(table)
    return sent


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes paths, in whatever store they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _MADE:
        try:
            remove(spark, *_MADE)
        except Exception:  # noqa: BLE001  the session or its store is gone already; nothing more can be done here
            pass
    for folder in _LOCAL:
        shutil.rmtree(folder, ignore_errors=True)
