"""Counters of a run, taken in the passes that write its tables, and the figures of its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pricemap.operators.participation import participation_status
from pricemap.sources.store import cache_valid
from pricemap.work import written


class Run:
    """The tables of one run; each is written once, and its counters are observed as its rows go by."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}
        self._seen: list[tuple[str, Observation]] = []

    def _write(self, name: str, df: DataFrame, **counters: Column) -> DataFrame:
        seen = Observation(name)
        observed = df.observe(seen, *[F.count_if(F.coalesce(test, F.lit(False))).alias(c) for c, test in counters.items()])
        self.tables[name] = written(observed, f"run-{name}")
        self._seen.append((name, seen))
        return self.tables[name]

    def messages(self, messages: DataFrame, stored: DataFrame) -> DataFrame:
        """``messages`` with ``is_new``: not stored, and the first of its id by arrival.

        ``rule_type`` and ``label``, where they have them, tell who classified them.
        """
        key = ["process_id", "message_id"]
        known = stored.select(*key).distinct().withColumn("__known", F.lit(True))
        first = F.row_number().over(Window.partitionBy(*key).orderBy("ingest_seq")) == 1
        marked = messages.join(known.hint("merge"), key, "left").withColumn("is_new", F.col("__known").isNull() & first).drop("__known")
        outside = F.col("rule_type").isNull() & F.col("label").isNotNull() if {"rule_type", "label"} <= set(messages.columns) else F.lit(False)
        return self._write("messages", marked, new=F.col("is_new"), duplicate=~F.col("is_new"), labelled_outside=F.col("is_new") & outside)

    def attachments(self, attachments: DataFrame) -> DataFrame:
        """``attachments`` with their ``disposition``."""
        d = F.col("disposition")
        return self._write("attachments", attachments, total=F.lit(True), approved=d == "accepted", filtered=d.isin("institutional", "template", "rejected"), duplicate=d == "duplicate")

    def files(self, files: DataFrame, cached: DataFrame) -> DataFrame:
        """``files`` with ``is_cached``: the cache has a valid entry of their version."""
        valid = cache_valid(cached).select("file_id", "version").distinct().withColumn("is_cached", F.lit(True))
        marked = files.join(valid.hint("merge"), ["file_id", "version"], "left").withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
        return self._write("files", marked, cached=F.col("is_cached"), new=~F.col("is_cached"))

    def enriched(self, updates: DataFrame) -> DataFrame:
        """A row for each supplier that ``updates`` (supplier_id, field, value) tell something new."""
        own = updates.groupBy("supplier_id").agg(F.count("*").alias("n_fields"))
        return self._write("suppliers", own, enriched=F.lit(True))

    def counters(self, spark: SparkSession) -> DataFrame:
        """(counter, n) of all that was written."""
        found = [(f"{name}_{c}", int(n)) for name, seen in self._seen for c, n in seen.get.items()]
        return spark.createDataFrame(found, "counter string, n long")


def _sets(df: DataFrame, section: str, key: Column, n: Column, distinct: Column) -> DataFrame:
    own = df.withColumn("key", key)
    by = [F.col("process_id"), F.col("key")]
    grouped = own.groupingSets([by, by[:1], []], *by).agg(n.cast("long").alias("n"), distinct.cast("long").alias("n_distinct"))
    return grouped.select(F.lit(section).alias("section"), "process_id", "key", "n", "n_distinct")


def figures(messages: DataFrame, part: DataFrame, cells: DataFrame) -> DataFrame:
    """(section, process_id, key, n, n_distinct): messages by type, suppliers by status, prices by supplier; each by process too, and in all.

    One grouping of each table gives all three levels; every rendering of a report reads this table.
    """
    kinds = _sets(messages, "messages", F.coalesce("type", F.lit("outro")), F.count("*"), F.countDistinct("from_email"))
    states = _sets(participation_status(part), "suppliers", F.col("status"), F.count("*"), F.lit(None))
    priced = _sets(cells, "prices", F.col("supplier"), F.count("unit_price"), F.countDistinct("row_id"))
    return kinds.unionByName(states).unionByName(priced)
