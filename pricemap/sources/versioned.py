"""Tables in versions: files are written first, then one small commit names those that count.

A table is cut into buckets by a hash of its key.  A write makes new folders for the buckets that it
touches, and publishes a commit that names the folder of every bucket, at most one entry a bucket.
Readers take the newest commit, so they see a write whole or not at all; a writer that fails before
its commit leaves folders that no commit names.  Two writers can't publish the same version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemap.work import written

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that a writer built on."""


class VersionedTable:
    """A table below ``path`` whose rows are kept by ``key`` columns."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        raw = hadoop.Path(path)
        self.fs = raw.getFileSystem(spark._jsc.hadoopConfiguration())
        # the full name, so that tasks and driver mean the same folder
        self.path = self.fs.makeQualified(raw).toString().rstrip("/")
        self._path = hadoop.Path

    # -- commits -----------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, version: int | None = None) -> dict:
        """The named commit, the newest one by default; before the first write, an empty one."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}}
        stream = self.fs.open(self._path(f"{self.path}/_commits/{version or known[-1]:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, commit: dict) -> None:
        target = self._path(f"{self.path}/_commits/{commit['version']:020d}.json")
        draft = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # without an option to overwrite: the second of two writers fails here
            context.rename(draft, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {commit['version']} of {self.path} is there already") from e
            raise

    # -- reading and writing ---------------------------------------------------------------------------

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default); None before the first write."""
        commit = self.commit(version)
        if commit["schema"] is None:
            return None
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(commit["schema"])
        wanted = [f for b, f in sorted(commit["folders"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(schema.toDDL())
        return reader.parquet(*wanted) if wanted else self.spark.createDataFrame([], schema.toDDL())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.commit()["buckets"])).cast("int")

    def change(self, source: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """Publish ``merge(old rows, source)`` for the buckets that ``source`` touches; the version.

        ``merge`` may only give rows with keys of those buckets.
        """
        before = self.commit()
        source = written(source.withColumn("__bucket", self._bucket()), "versioned-source")
        touched = [r[0] for r in source.select("__bucket").distinct().collect()]  # at most one a bucket
        if not touched and before["schema"] is not None:
            return before["version"]
        held = self.read(before["version"] or None, touched) if before["schema"] else None
        rows = merge(held, source.drop("__bucket"))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket", *self.key).write.partitionBy("bucket").parquet(folder)
        made = self.fs.listStatus(self._path(folder))
        fresh = {s.getPath().getName().removeprefix("bucket="): s.getPath().toString() for s in made if s.isDirectory()}
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched} | fresh
        self._publish({"version": before["version"] + 1, "buckets": before["buckets"], "schema": rows.schema.json(), "folders": folders})
        return before["version"] + 1

    def replace(self, source: DataFrame, by: list[str] | None = None) -> int:
        """``source``'s rows in place of those that share their key."""
        by = by or self.key

        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return new
            kept = old.join(new.select(*by).distinct().hint("merge"), by, "left_anti")
            return kept.unionByName(new, allowMissingColumns=True)

        return self.change(source, merge)

    def upsert(self, source: DataFrame, rules: dict[str, str], seq: str = "seq") -> int:
        """Merge ``source`` column by column."""
        from pricemap.sources.store import upsert

        return self.change(source, lambda old, new: upsert(new.limit(0) if old is None else old, new, self.key, rules, seq))

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of ``keys``."""

        before = self.commit()
        if before["schema"] is None:
            return before["version"]
        return self.change(keys.select(*self.key), lambda old, gone: old.join(gone.distinct().hint("merge"), self.key, "left_anti"))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data folders that none of the newest ``keep`` commits names; how many went."""
        known = self.versions()[-keep:]
        live = {f.rsplit("/", 1)[0] for v in known for f in self.commit(v)["folders"].values()}
        data = self._path(f"{self.path}/data")
        gone = [s.getPath() for s in self.fs.listStatus(data) if s.getPath().toString() not in live] if self.fs.exists(data) else []
        for p in gone:
            self.fs.delete(p, True)
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path(f"{self.path}/_commits/{v:020d}.json"), False)
        return len(gone)


def extract_incrementally(table: VersionedTable, files: DataFrame, extract: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """The items of ``files`` (file_id, version): those that the table has for their version, united with newly extracted ones.

    New items are committed before the union is read, so a run that fails can be repeated.  ``extract``
    gives items with file_id; a file's newest extraction replaces its earlier ones.
    """
    old = table.read()
    wanted = files.select("file_id", F.col("version").alias("__version"))
    missing = files
    if old is not None:
        known = old.filter(F.col("extraction_version") == version).select("file_id", "version").distinct()
        missing = files.join(known.hint("merge"), ["file_id", "version"], "left_anti")
    fresh = extract(missing).join(missing.select("file_id", "version").hint("merge"), "file_id").withColumn("extraction_version", F.lit(version))
    table.replace(fresh, ["file_id"])
    return table.read().join(wanted.hint("merge"), "file_id").filter("version = __version").drop("__version")
