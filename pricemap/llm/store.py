"""Work tables in the folder that the cluster shares.

Lineage is cut by writing a table and reading it back, so a lost executor costs only the tasks that
had not written yet.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pricemap.work import CLEAN_KEY, filesystem, new_folder

_SCOPES: list[list[DataFrame]] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) below the shared folder, with its scheme: tasks and pyarrow take it for the same folder as Spark."""
    return new_folder(spark, name)


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back with the same schema.

    What the write shuffled isn't needed after it, so its files go at once.
    """
    spark = df.sparkSession
    path, before = new_dir(spark, name), spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.set(CLEAN_KEY, before)
    table = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


@contextmanager
def work_tables():
    """Tables that :func:`saved` makes meanwhile go at the end, but for those put into the list that is given."""
    keep: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield keep
    finally:
        stay = {f for df in keep for f in df.inputFiles()}
        drop(*[df for df in _SCOPES.pop() if not stay.intersection(df.inputFiles())])


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`saved` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class WholeFile:
    """A file that is written under another name and takes its own on close, so a repeated task leaves one whole file."""

    def __init__(self, uri: str):
        self.where, self.path = filesystem(uri)
        self.where.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary, self.size = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
        self.out = self.where.open_output_stream(self.temporary, compression=None, buffer_size=1 << 20)

    def write(self, part: bytes) -> None:
        self.out.write(part)
        self.size += len(part)

    def close(self) -> int:
        self.out.close()
        self.where.move(self.temporary, self.path)
        return self.size
