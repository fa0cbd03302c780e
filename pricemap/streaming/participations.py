"""Participations of a stream of messages, kept in keyed state.

Messages repeat and come late, and the first of an id by arrival order counts, whoever sent it (F3, W3).
Spark's own state holds the first arrival of each message id, without Python; a batch's changed arrivals are
written, and the pairs of process and sender that a message has begun or ceased to count for are made anew from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricemap.operators.participation import PAIR, participations

MESSAGE = ["process_id", "message_id"]

STORE_KEY, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(messages: DataFrame) -> DataFrame:
    """The first arrival so far of each message id of a stream (process_id, message_id, from_email, ingest_seq, type, sent_at)."""
    arrival = F.struct(F.col("ingest_seq").cast("long").alias("ingest_seq"), "from_email", "type", F.col("sent_at").cast("timestamp").alias("sent_at"))
    return messages.groupBy(*MESSAGE).agg(F.min(arrival).alias("arrival")).select(*MESSAGE, "arrival.*")


def changed_participations(arrivals: DataFrame, number: int) -> DataFrame:
    """The participations that batch ``number`` has changed, with the messages that count for each, none of them perhaps.

    ``arrivals``: the first arrivals that each batch so far has found, by ``batch``.
    """
    seen = arrivals.filter(F.col("batch") <= number)
    touched = seen.filter(F.col("batch") == number).select(*[F.col(c).alias(f"__{c}") for c in MESSAGE])
    pairs = seen.join(touched.hint("merge"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in MESSAGE], "left_semi").select(*PAIR).distinct()
    # state only ever moves to an earlier arrival
    counting = seen.groupBy(*MESSAGE).agg(F.min(F.struct("ingest_seq", "from_email", "type", "sent_at")).alias("arrival")).select(*MESSAGE, "arrival.*")
    counted = counting.groupBy(*[F.col(c).alias(f"__{c}") for c in PAIR]).agg(F.count("*").alias("n_messages"))
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in PAIR]
    own = participations(counting).withColumnsRenamed({c: f"_{c}" for c in PAIR})
    out = pairs.join(counted.hint("merge"), same("__"), "left").join(own.hint("merge"), same("_"), "left")
    return out.withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).drop(*[f"{p}{c}" for p in ("_", "__") for c in PAIR])


def follow_participations(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changed participations to a table, all that is there now, then stop; a replayed batch overwrites its own folders.

    First arrivals are kept beside the table.  State is held in the RocksDB store, so the session's store is set to it.
    """
    messages.sparkSession.conf.set(STORE_KEY, ROCKS_DB)
    kept = f"{path}-arrivals"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        arrivals = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, batch long").parquet(kept)
        changed_participations(arrivals, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return first_arrivals(messages).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_participations(spark, path: str) -> DataFrame:
    """The newest row of each pair that still has a message."""
    table = spark.read.parquet(path)
    own = [c for c in table.columns if c not in (*PAIR, "batch")]
    newest = table.groupBy(*PAIR).agg(F.max_by(F.struct(*own), "batch").alias("v")).select(*PAIR, "v.*")
    return newest.filter("n_messages > 0").drop("n_messages")
