"""Messages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricemap.operators.participation import new_messages


def _stored(spark, path: str) -> DataFrame | None:
    """The table below ``path``, None before the first write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def ingest(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's new messages to a table, all that is there now, then stop.

    A message is new if the table hasn't it, however late it comes: a watermark would drop late ones.
    A replayed batch overwrites its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        stored = _stored(batch.sparkSession, path)
        known = batch.limit(0) if stored is None else stored.filter(F.col("batch") != number)
        batch = new_messages(batch, known).select(batch.columns)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
