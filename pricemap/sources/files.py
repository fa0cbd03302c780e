"""Archives, loose files and delimited quotation files."""

from __future__ import annotations

import csv
import io
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemap.functions.text import is_budget_file, normalize_header
from pricemap.operators.order import ranked
from pricemap.work import filesystem, written

_MEMBER = ["archive", "seq", "name", "kind", "content"]
MEMBER_SCHEMA = "archive string, seq int, name string, kind string, content binary"


def _members(name: str, content: bytes):
    """(name, bytes) of an archive's files: zip members in name order, tar members in archive order."""
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
                yield info.filename, z.read(info)
    elif low.endswith((".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read()
    else:
        raise ValueError(f"{name} is neither a zip nor a gzipped tar archive")


def explode_archives(files: DataFrame) -> DataFrame:
    """Mails and quotation files in archives (name, content); other members are dropped, base names kept."""

    def explode(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"]):
                for k, (member, data) in enumerate(_members(name, bytes(content))):
                    base = member.replace("\\", "/").rsplit("/", 1)[-1]
                    rows.append((name, k, base, "mail" if base.lower().endswith(".eml") else "file", data))
            yield pd.DataFrame(rows, columns=["archive", "seq", "name", "kind", "content"])

    members = files.select("name", "content").mapInPandas(explode, MEMBER_SCHEMA)
    return members.filter((F.col("kind") == "mail") | is_budget_file(F.col("name"), "archive"))


def _named(raw: DataFrame) -> DataFrame:
    return raw.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))


#: Bytes of members that a task fetches, and that a batch of rows holds.
FETCH_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
#: Cells of a delimited file that a batch of rows holds.
BATCH_CELLS = 20_000
_ENTRY = "path string, archive string, seq int, member string, base string, kind string, bytes long"


def _open(path: str):
    where, inner = filesystem(path)
    return where.open_input_file(inner)


def _wanted(member: str) -> tuple[str, str]:
    base = member.replace("\\", "/").rsplit("/", 1)[-1]
    return base, "mail" if base.lower().endswith(".eml") else "file"


def archive_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive, seq, member, base, kind, bytes) of the zip archives below ``path``: only their directories are read."""

    def entries(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _open(p) as f, zipfile.ZipFile(f) as z:
                    for k, info in enumerate(sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)):
                        rows.append((p, p.rsplit("/", 1)[-1], k, info.filename, *_wanted(info.filename), info.file_size))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])

    # without their content, files are only listed
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    found = listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(entries, _ENTRY)
    return found.filter((F.col("kind") == "mail") | is_budget_file(F.col("base"), "archive"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of every archive below ``path`` (S1), however large an archive is.

    A zip archive's directory comes first; its members are then dealt to tasks by their bytes, and each
    is read from its own place.  A gzipped tar has no directory: one task streams it, and gives a batch of
    members at a time.  The files must be in a store that pyarrow reads; for others there is :func:`explode_archives`.
    """
    directory = written(archive_directory(spark, path), "archive-directory")
    total = directory.agg(F.sum("bytes")).first()[0] or 0

    def fetch(batches):
        for pdf in batches:
            for p, part in pdf.groupby("path", sort=False):
                rows, size = [], 0
                with _open(p) as f, zipfile.ZipFile(f) as z:
                    for r in part.itertuples():
                        rows.append((r.archive, r.seq, r.base, r.kind, z.read(r.member)))
                        size += len(rows[-1][-1])
                        if size >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=_MEMBER)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_MEMBER)

    def stream(batches):
        for pdf in batches:
            for p in pdf["path"]:
                rows, size = [], 0
                where, inner = filesystem(p)
                with where.open_input_stream(inner, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as t:
                    for k, info in enumerate(i for i in t if i.isfile()):
                        base, kind = _wanted(info.name)
                        rows.append((p.rsplit("/", 1)[-1], k, base, kind, t.extractfile(info).read()))
                        size += info.size
                        if size >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=_MEMBER)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_MEMBER)

    zipped = directory.repartition(max(spark.sparkContext.defaultParallelism, -(-total // FETCH_BYTES)), "path", "seq").mapInPandas(fetch, MEMBER_SCHEMA)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tgz,tar.gz}").load(path).select("path")
    tarred = listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(stream, MEMBER_SCHEMA)
    return zipped.unionByName(tarred.filter((F.col("kind") == "mail") | is_budget_file(F.col("name"), "archive")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Quotation files of a folder, not of those below it; the version is the time of change (S2).  Sort what is made of them by name: the contents needn't be moved for it."""
    raw = _named(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path))
    return raw.filter(is_budget_file(F.col("name"))).select("name", "path", F.col("modificationTime").alias("version"), "length", "content")


def read_quote_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cells (file_id, grid_id, row, col, text) of delimited files; the delimiter is the one its first line has most of.

    Cells in quotes may hold the delimiter and line breaks.  A quotation file is one document: one task decodes its bytes
    as it goes along, and gives a batch of cells at a time.
    """
    schema = pa.schema([("file_id", pa.string()), ("grid_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())])

    def parse(batches):
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for k in range(batch.num_rows):
                file_id, held = batch.column("file_id")[k].as_py(), batch.column("value")[k].as_buffer()
                lines = lambda: io.TextIOWrapper(pa.BufferReader(held), encoding="utf-8", newline="")
                # the first line ends where str.splitlines ends it
                first = (next(lines(), "").splitlines() or [""])[0]
                sep = max(",;\t|", key=lambda d: (first.count(d), -",;\t|".index(d)))
                made, size = [], 0
                for row, cells in enumerate(csv.reader(lines(), delimiter=sep)):
                    cells = [x.strip() for x in cells]
                    if any(cells):
                        made += [(row, col, x) for col, x in enumerate(cells)]
                        size += sum(map(len, cells))
                    if len(made) >= BATCH_CELLS or size >= BATCH_BYTES:
                        yield cells_of(file_id, made)
                        made, size = [], 0
                if made:
                    yield cells_of(file_id, made)

    def cells_of(file_id: str, made: list):
        rows, cols, texts = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([file_id] * len(made), ["csv"] * len(made), rows, cols, texts), schema.types)], schema=schema)

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), "value")
    return whole.mapInArrow(parse, "file_id string, grid_id string, row int, col int, text string")


# Header names of a master list, per field.
MASTER_ALIASES = {
    "item_no": ["item", "numero item", "n item", "num item", "numero"],
    "material_code": ["codigo", "pi", "nsn", "part number", "pn"],
    "description": ["descricao", "nomenclatura", "nome", "especificacao", "objeto", "material"],
}


def read_master(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Master rows (item_no, material_code, description, seq) of a table: an alias itself first, else all its words in the header; empty without number and description columns.

    ``order`` is the place of a row in its source, which only the source knows; without it, rows are
    put in order of what they hold, so the same list always gives the same order.
    """
    spark = df.sparkSession
    names = df.columns
    # headers are few and their normal form is needed to plan the query
    norm = [r[0] for r in spark.createDataFrame([(c,) for c in names], "c string").select(normalize_header(F.col("c"))).collect()]
    picked = {}
    for field, aliases in MASTER_ALIASES.items():
        exact = next((k for a in aliases for k, n in enumerate(norm) if n == a), None)
        loose = next((k for a in aliases for k, n in enumerate(norm) if set(a.split()) <= set(n.split())), None)
        at = exact if exact is not None else loose
        if at is not None:
            picked[field] = names[at]
    cols = [F.trim(F.col(f"`{picked[f]}`").cast("string")).alias(f) if f in picked else F.lit(None).cast("string").alias(f) for f in MASTER_ALIASES]
    if order is None:
        out = ranked(df.select(*cols).withColumn("__all", F.lit(0)), "__all", [*MASTER_ALIASES], "seq").drop("__all")
    else:
        out = df.select(*cols, order.cast("long").alias("seq"))
    return out if "item_no" in picked or "description" in picked else out.limit(0)
