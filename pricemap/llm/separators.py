"""Separator scan over flat token files without an index.

A file is nothing but ids, each document followed by the end-of-document id.  Files are read in blocks;
in each block the end ids are found at once with numpy, and documents that cross block edges are
put together from a prefix scan over the blocks' last separators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm import tokens
from pricemap.llm.store import WholeFile, filesystem, new_dir, saved
from pricemap.work import qualified
from pricemap.llm.token_files import narrow

#: Tokens that one block of the scan holds.
BLOCK_TOKENS = 1 << 20
END_ID = 50256


def write_flat_files(docs: DataFrame, path: str, vocabulary: str = tokens.BYTE_BPE, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write ids, each document followed by ``end_id``, a file per input partition; (file, path, n_bytes, doc_ids) per file.

    Documents stay where they are: nothing is shuffled, and a file holds its partition's documents in
    order.  Null and empty texts are the end id alone; repeated rows are written each; an empty table
    writes no file; other columns are not read.
    """
    path = qualified(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def write(batches):
        file = TaskContext.get().partitionId()
        name, out, ids = f"{path}/part-{file:08d}.ids", None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or WholeFile(name)
            ids += batch.column("doc_id").to_pylist()
            for own in tokens.encode_column(vocabulary, batch.column("text").to_pylist(), end_id, plain=True):
                out.write(narrow(own, width))
        if out:
            columns = [pa.array([file], pa.int32()), pa.array([name]), pa.array([out.close()], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["file", "path", "n_bytes", "doc_ids"])

    return saved(rows.mapInArrow(write, "file int, path string, n_bytes long, doc_ids array<long>"), "flat-files")


def scan_blocks(files: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents that end in each block: (file, block, base, n_ends, last_end, ends), positions in tokens of the file."""
    total = F.floor(F.col("n_bytes") / width)
    blocks = files.select("file", "path", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(total / block_tokens) - 1, F.lit(0)))).alias("block"))

    def scan(batches):
        for batch in batches:
            for file, path, total, block in zip(*(batch.column(k).to_pylist() for k in range(4))):
                where, name = filesystem(path)
                base = block * block_tokens
                with where.open_input_file(name) as f:
                    f.seek(base * width)
                    ids = np.frombuffer(f.read(min(block_tokens, total - base) * width), dtype=f"<u{width}")
                ends = base + np.flatnonzero(ids == end_id)
                row = {"file": [file], "block": [block], "total": [total], "n_ends": [len(ends)], "last_end": [int(ends[-1]) if len(ends) else None], "ends": [ends]}
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds)], list(row))

    spread = blocks.repartition("file", "block")
    return spread.mapInArrow(scan, "file int, block long, total long, n_ends long, last_end long, ends array<long>")


def document_lengths(files: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document in the files' order: file, ordinal, start, n_tokens (without the end id).

    A file that doesn't end with the end id has a last document up to its end.
    """
    scanned = saved(scan_blocks(files, end_id, width, block_tokens), "separators")
    # the prefix scan sees one narrow row per block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = scanned.select(
        "file", "block",
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("open_end"),
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal_base"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc())) == 1).alias("is_last"),
    )
    joined = scanned.join(edges.hint("shuffle_hash"), ["file", "block"])
    tail = F.when(F.col("is_last") & (F.coalesce("last_end", "open_end") < F.col("total") - 1), F.array("total")).otherwise(F.array().cast("array<long>"))
    each = joined.select("file", "open_end", "ordinal_base", F.concat("ends", tail).alias("ends")).select(
        "file", "ordinal_base", F.posexplode(F.arrays_zip(F.col("ends").alias("ends"), F.concat(F.array("open_end"), F.col("ends")).alias("prev"))).alias("k", "e")
    )
    # the zipped array has one entry more than there are ends
    return each.filter(F.col("e.ends").isNotNull()).select(
        "file", (F.col("ordinal_base") + F.col("k")).alias("ordinal"), (F.col("e.prev") + 1).alias("start"), (F.col("e.ends") - F.col("e.prev") - 1).alias("n_tokens")
    )


def token_counts(docs: DataFrame, vocabulary: str = tokens.BYTE_BPE, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, path: str | None = None) -> DataFrame:
    """Write ``docs`` as flat files and count each document's tokens from the separators alone.

    (doc_id, file, ordinal, start, n_tokens): the n-th separator of a file ends the n-th document that was written to it.
    """
    where = path or new_dir(docs.sparkSession, "flat")
    files = write_flat_files(docs, where, vocabulary, end_id)
    written = files.select(F.col("file").alias("f"), F.posexplode("doc_ids").alias("k", "doc_id"))
    lengths = document_lengths(files.drop("doc_ids"), end_id, block_tokens=block_tokens)
    joined = lengths.join(written.hint("merge"), (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("k")))
    return joined.select("doc_id", "file", "ordinal", "start", "n_tokens")
