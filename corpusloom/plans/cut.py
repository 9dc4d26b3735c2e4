"""Cutting lineage with tables written to the folder all executors share.

``cut`` writes a DataFrame once as parquet and reads it back.  Unlike a
``checkpoint()`` of an unpersisted frame it runs the plan once, and unlike
``localCheckpoint()`` it survives the loss of an executor.  Shuffle files of that run
go with its end, not when the driver happens to collect its garbage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Row, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: list[str] = []


def _remove(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    """Tables that are left go with the process: through Spark's file system while
    there is a session, else those on a file system mounted on this machine."""
    for path in _written:
        try:
            _remove(path)
        except Exception:  # the session is gone
            pass
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)


def sweep(spark: SparkSession) -> None:
    """Remove all tables written so far: for a session that goes on, once the results
    of its queries are written.  Frames that read them are of no use afterwards."""
    while _written:
        _remove(_written.pop())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where the
    setting may be unset, a temporary folder of this process."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, swept like the tables of ``cut``."""
    _written.append(f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def _table(df: DataFrame, tag: str, *by: str) -> DataFrame:
    spark = df.sparkSession
    path, before = scratch(spark, f"cut-{tag}"), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it.

    Columns keep names and types; an empty frame stays empty.  The table lives
    until ``drop`` is called with the result or the folder is removed.
    """
    return _table(df, tag)


def cut_by(df: DataFrame, by: str, tag: str = "t") -> DataFrame:
    """Like ``cut``, in a folder for each value of column ``by``, an integer, so that
    those of other values aren't read."""
    return _table(df, tag, by)


def drop(*frames: DataFrame) -> None:
    """Remove the tables of frames made by ``cut``; others are left alone."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _remove(path)
            if path in _written:
                _written.remove(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)



def bounded(df: DataFrame, most: int = 100_000) -> list[Row]:
    """All rows of a table that is small by its nature; more than ``most`` are an error,
    so that none is ever left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows where a small fixed one is expected")
    return rows
