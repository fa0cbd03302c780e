"""Listings in the order in which people read them (K1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nocase(col: Column) -> Column:
    """Key of an order that ignores the case of A to Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def processes(df: DataFrame) -> DataFrame:
    """Processes, the newest first."""
    return df.orderBy(F.col("created_at").desc_nulls_last(), "process_id")


def process_messages(df: DataFrame) -> DataFrame:
    """Messages of each process by the time they were sent, then by arrival; those without a time come first."""
    return df.orderBy("process_id", F.col("sent_at").asc_nulls_first(), "ingest_seq")


def process_links(df: DataFrame) -> DataFrame:
    """Quotation files of each process in the order in which they were linked."""
    return df.orderBy("process_id", F.col("created_at").asc_nulls_first(), "file_id")


def supplier_names(df: DataFrame) -> DataFrame:
    """Suppliers by name, whatever its case."""
    return df.orderBy(nocase(F.coalesce("name", F.lit(""))), "email")
