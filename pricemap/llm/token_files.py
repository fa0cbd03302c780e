"""Token-id files: every document its own zstandard frame under one shared dictionary.

Layout of a data file: magic ``PMTOK1``, two bytes of id width, the dictionary's SHA-256 (32 bytes), the
frames, then the index (per document doc_id, tokens, crc32 of the 32-bit ids, frame offset, frame
bytes), and a footer (index offset, number of documents, magic).  A reader that wants one document
reads the footer, the index and that frame alone.  The dictionary lies beside the files under its hash.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm import tokens
from pricemap.llm.store import WholeFile, filesystem, new_dir, saved
from pricemap.work import qualified

MAGIC = b"PMTOK1"
HEADER, FOOTER = "<6sH32s", "<QQ6s"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("n_tokens", "<u4"), ("crc32", "<u4"), ("at", "<u8"), ("size", "<u4")])

#: The dictionary: its bytes, and how many documents at most it is trained on (a hash decides which).
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_TOKENS = 65536, 2000, 2_000_000
#: Documents that one file holds, about, and the most files; beyond that, files grow (they are written as a stream).
FILE_DOCUMENTS, MOST_FILES = 8192, 5000
LEVEL = 3


def narrow(ids: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widen(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> bytes:
    """A dictionary from the id arrays of a bounded hash sample of the documents; raw ids where there are too few to train.

    A bound on the hash of the doc_id leaves about twice as many documents as are wanted, whatever the
    table's size, before any text is read or moved; rows that repeat a doc_id count once, those without
    one and texts that are over the sample's room alone are passed over.
    """
    mark, known = F.xxhash64("doc_id"), docs.filter("doc_id is not null")
    n = known.count()
    least = (1 << 63) - 1 - min((1 << 64) - 1, (2 * SAMPLE_DOCUMENTS + 100 << 64) // max(1, n))
    few = known.filter(mark >= F.lit(least)).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    samples, total = [], 0
    for row in few.orderBy(mark, "doc_id").select("text").limit(SAMPLE_DOCUMENTS).toLocalIterator():
        own = next(tokens.encode_column(vocabulary, [row["text"]], end_id))
        if total + len(own) // 4 <= SAMPLE_TOKENS:
            total += len(own) // 4
            samples.append(narrow(own, width))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total * width // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def id_boundaries(docs: DataFrame, files: int) -> list[int]:
    """Ascending doc_ids that cut the documents into about ``files`` equal ranges."""
    files = min(files, MOST_FILES)
    if files < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 2 * MOST_FILES)).first()[0] or []
    return sorted(set(cuts))


def write_token_files(docs: DataFrame, path: str, vocabulary: str = tokens.BYTE_BPE, end_id: int = 2, file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """Write the ids of every whole document in ascending doc_id order; return (file, path, documents, tokens) per file.

    Each file is a range of doc_ids and one task's; the strings of special tokens count as the library counts them.
    Null texts count as empty (the end id alone); null doc_ids come first; rows that repeat a doc_id
    are all written, ordered by their ids' crc32; an empty table writes no file; other columns are not read.
    """
    path = qualified(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if tokens.encoder(vocabulary).tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
    raw_dictionary = train_dictionary(rows, vocabulary, end_id, width)
    dictionary_id = hashlib.sha256(raw_dictionary).digest()
    beside = WholeFile(f"{path}/{dictionary_id.hex()}.dict")
    beside.write(raw_dictionary)
    beside.close()
    cuts = id_boundaries(rows, -(-rows.count() // file_documents))

    def encode(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw_dictionary), write_checksum=False, write_dict_id=False)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            file = [0 if x is None else bisect_right(cuts, x) for x in ids]
            n, crc, frames = [], [], []
            for own in tokens.encode_column(vocabulary, batch.column("text").to_pylist(), end_id):
                n.append(len(own) // 4)
                crc.append(tokens.crc32(own))
                frames.append(press.compress(narrow(own, width)))
            columns = [pa.array(file, pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "n_tokens", "crc32", "frame"])

    def name(file: int) -> str:
        return f"{path}/part-{file:08d}.tok"

    def write(batches):
        out, open_file, index = None, None, []

        def close():
            table = np.array(index, dtype=INDEX)
            at = out.size
            out.write(table.tobytes())
            out.write(struct.pack(FOOTER, at, len(index), MAGIC))
            out.close()
            columns = [[open_file], [name(open_file)], [len(index)], [int(table["n_tokens"].sum())]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["file", "path", "documents", "tokens"])

        for batch in batches:
            for file, doc_id, n, crc, frame in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if file != open_file:
                    if out:
                        yield close()
                    out, open_file, index = WholeFile(name(file)), file, []
                    out.write(struct.pack(HEADER, MAGIC, width, dictionary_id))
                index.append((doc_id or 0, doc_id is not None, n, crc, out.size, len(frame)))
                out.write(frame)
        if out:
            yield close()

    encoded = rows.mapInArrow(encode, "file int, doc_id long, n_tokens long, crc32 long, frame binary")
    placed = encoded.repartitionById(len(cuts) + 1, F.col("file")).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "crc32", "n_tokens")
    return saved(placed.mapInArrow(write, "file int, path string, documents long, tokens long"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Add ``start``: the tokens of all files before (one small row per file)."""
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class TokenFile:
    """Random access to one file: the index is read at once, frames when asked for."""

    def __init__(self, path: str):
        where, name = filesystem(path)
        self.source = where.open_input_file(name)
        size = self.source.size()
        self.source.seek(size - struct.calcsize(FOOTER))
        index_at, n, magic = struct.unpack(FOOTER, self.source.read(struct.calcsize(FOOTER)))
        self.source.seek(0)
        head, self.width, self.dictionary_id = struct.unpack(HEADER, self.source.read(struct.calcsize(HEADER)))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.source.seek(index_at)
        self.index = np.frombuffer(self.source.read(n * INDEX.itemsize), dtype=INDEX)
        with where.open_input_file(f"{name.rpartition('/')[0]}/{self.dictionary_id.hex()}.dict") as f:
            raw = f.read()
        if hashlib.sha256(raw).digest() != self.dictionary_id:
            raise ValueError(f"the dictionary of {path} has another hash")
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))

    def ids(self, k: int) -> bytes:
        """The 32-bit ids of the file's k-th document."""
        entry = self.index[k]
        self.source.seek(int(entry["at"]))
        raw = self.source.read(int(entry["size"]))
        return widen(self.press.decompress(raw, max_output_size=int(entry["n_tokens"]) * self.width), self.width)

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id, by binary search of the sorted index."""
        own = np.where(self.index["known"] > 0, self.index["doc_id"], np.iinfo(np.int64).min)
        return list(range(np.searchsorted(own, doc_id, "left"), np.searchsorted(own, doc_id, "right")))


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 of the ids that were read, and the ids if asked for.

    A frame whose ids differ from the index's crc32 fails the task.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                f, own, crc = TokenFile(path), [], []
                for k in range(len(f.index)):
                    ids = f.ids(k)
                    crc.append(tokens.crc32(ids))
                    if crc[-1] != f.index["crc32"][k]:
                        raise ValueError(f"document {k} of {path} was not read as it was written")
                    if with_ids:
                        own.append(np.frombuffer(ids, "<i4"))
                n = f.index["n_tokens"].astype(np.int64)
                doc_id = pa.array(f.index["doc_id"].astype(np.int64), mask=f.index["known"] == 0)
                columns = {"doc_id": doc_id, "start": pa.array(start + np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(own, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    n = files.count()
    return with_starts(files).repartition(max(1, min(n, 1024)), "file").mapInArrow(read, schema)


def round_trip(docs: DataFrame, vocabulary: str = tokens.BYTE_BPE, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read every document back."""
    where = path or new_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, where, vocabulary, end_id))
