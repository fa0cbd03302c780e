"""Stored tables: upserts, replacements, deletions, and incremental extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the extraction that cached results must have.
EXTRACTION_VERSION = "5"


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str], seq: str = "seq") -> DataFrame:
    """``target`` with ``source`` merged in, one row per key.

    Rule of each column: ``last`` (the newest row's value), ``first`` (insert or ignore), ``fill`` (the
    oldest value that isn't blank), ``add`` (sum).  ``seq`` orders the rows of both tables.
    """
    rows = target.unionByName(source, allowMissingColumns=True)
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col(seq))
    merge = {
        "last": lambda c: F.max_by(c, seq),
        "first": lambda c: F.min_by(c, seq),
        "fill": lambda c: F.min_by(c, filled(c)),
        "add": lambda c: F.sum(c),
    }
    return rows.groupBy(*keys).agg(*[merge[rule](c).alias(c) for c, rule in rules.items()], F.max(seq).alias(seq))


def save_items(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the items of the files in ``df``: only their hash buckets are rewritten."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")
    fresh = df.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = fresh.select("bucket").distinct()
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(fresh.select("file_id").distinct(), "file_id", "left_anti")
        # read and write the same folder: the kept rows go through a table of their own first
        from pricemap.work import written

        fresh = written(kept.unionByName(fresh, allowMissingColumns=True), "items")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def cached_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Cached items of the given files."""
    return items.join(files.select("file_id").distinct(), "file_id", "left_semi")


def cache_valid(cached: DataFrame, version: str = EXTRACTION_VERSION) -> DataFrame:
    """Cached documents that may be used again: current version, and a tax id or a phone."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return cached.filter((F.col("extraction_version") == version) & ~(blank("tax_id") & blank("phone")))


def incremental(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files without a valid cache entry of their version."""
    return files.join(cache_valid(cached).select("file_id", "version"), ["file_id", "version"], "left_anti")


def delete_process(tables: dict[str, DataFrame], process_id: str) -> dict[str, DataFrame]:
    """Every table without one process; rows of no process stay."""
    return {name: df.filter(~F.col("process_id").eqNullSafe(process_id)) for name, df in tables.items()}


def purge_versions(df: DataFrame, version: str = EXTRACTION_VERSION) -> DataFrame:
    """Cached rows of the current version."""
    return df.filter(F.col("extraction_version") == version)


def load_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Saved decisions on pairs of descriptions."""
    return spark.read.schema("desc_a string, desc_b string, decision string, origin string, created_at timestamp").parquet(path)


def search(df: DataFrame, columns: list[str], term: str, types: list[str] | None = None) -> DataFrame:
    """Rows of the given types in which a column holds the term, whatever its case."""
    low = F.lit(term.lower())
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in columns])
    return df.filter(hit & F.col("type").isin(types)) if types else df.filter(hit)


def review_queue(review: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` doubtful matches that have both descriptions."""
    # Kinds that a person looks at.
    kinds = ["casamento", "casado", "IA juiz", "número igual"]
    wanted = reduce(lambda a, b: a | b, [F.col("kind").startswith(k) for k in kinds])
    return review.filter(F.col("new_desc").isNotNull() & F.col("matched_desc").isNotNull() & wanted).orderBy("seq").limit(n)


def write_map(tables: dict[str, DataFrame], path: str) -> None:
    """A map, its review list and its sources, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
