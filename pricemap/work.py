"""Work tables in the folder that the cluster shares, for loops that must cut their lineage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local applications without a setting, by their id.
_LOCAL: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, by Hadoop's default file system where it has none, so that driver, tasks and Python mean the same folder."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    return raw.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(raw).toString().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` with its scheme (a new local folder where that is unset under a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a setting of the whole application can't be made later: the folder is kept here
        name = spark.sparkContext.applicationId
        base = _LOCAL[name] = _LOCAL.get(name) or tempfile.mkdtemp(prefix="pricemap-", dir="/tmp")
    return qualified(spark, base)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a path, for files that tasks read or write themselves.

    The path must be :func:`qualified` on the driver: one without a scheme is a local one here.
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Spark's own setting: the shuffle files of an execution go when it ends, not when the driver collects garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back; what the write shuffled goes at once."""
    path = new_folder(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEAN_KEY, before)


#: Wide rows that one turn shuffles.
TURN_ROWS = 32_000_000


def written_in_turns(make: Callable[[Callable[..., Column]], DataFrame], name: str, rows: int = 0) -> DataFrame:
    """What ``make`` gives turn by turn, in one table as of :func:`written`; ``rows`` are those that it shuffles in all, about.

    ``make`` gets a test of columns, by whose hash rows are dealt over the turns: with it on all its tables that meet, a turn
    shuffles no more than its share, and that goes before the next turn.
    """
    n = max(1, math.ceil(rows / TURN_ROWS))
    path = None
    for k in range(n):
        part = make(lambda *by, k=k: F.lit(True) if n == 1 else F.pmod(F.xxhash64(*by), F.lit(n)) == k)
        path = path or new_folder(part.sparkSession, name)
        _write(part, path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` (narrow rows) dealt over all tasks, by columns if named: few bytes that make much work a row are few tasks otherwise."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
