"""Benchmark decontamination.

The n-grams of the test items are normalised and hashed into a set that is broadcast; every task
slides over the words of its documents, looks the window hashes up, and compares the words of each
hit with the item's own before it counts.  The set is made in blocks of a bounded number of windows,
so a benchmark of any size is scanned block by block and the hits of a document are united.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemap.llm.store import drop, saved

#: Lower-cases A-Z and turns every byte that is neither a digit, a letter nor beyond ASCII into a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: Windows that one broadcast block of the benchmark may hold (about 200 bytes each).
BLOCK_WINDOWS = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a whole text; None has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` word numbers."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
        for k in range(n):
            out = out * _BASE + ids[k : k + len(out)].astype(np.uint64)
        return out ^ (out >> np.uint64(29))


class WindowSet:
    """The windows of a block of items: hashes by window length, and each window's words and items."""

    def __init__(self, items, n: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            size = min(n, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                self.items[size][own[k : k + size]].add(str(item_id))
        self.items = {size: dict(found) for size, found in self.items.items()}
        self.hashes = {size: np.unique(np.concatenate([rolling(np.array(w, dtype=np.uint64), size) for w in found])) for size, found in self.items.items()}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, the merged spans [from, to) of words inside occurring windows, and their items."""
        words, marks, items = words_of(text), [], set()
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, hashes in self.hashes.items():
            # a window with a word that no item has can't occur
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(words) >= size else ()
            if not len(at):
                continue
            for k in at[np.isin(rolling(ids, size)[at], hashes)]:
                found = self.items[size].get(tuple(ids[k : k + size].tolist()))
                if found:
                    items |= found
                    marks.append((int(k), int(k) + size))
        return len(words), merged(marks), items


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones united."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> int:
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    total = benchmark.agg(F.sum(F.greatest(words - n + 1, F.lit(1)))).first()[0] or 0
    return max(1, -(-total // block_windows))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the hit word ranges [from, to).  A null or empty text has no words and no hits; items
    without words match nothing; equal items each count under their own id; repeated document rows
    each give a row; an empty table gives no rows; other columns are not read.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<from:long,to:long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(items, n, block_windows)
    if blocks == 1:
        windows = _window_set(items, n)
        return _scanned(rows, windows, schema, final=True)
    # a row number of the documents' own would depend on the plan; equal rows scan alike, so a hash stands for them
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256))
    parts = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = saved(_scanned(keyed, _window_set(own, n), "key string, " + schema + ", items array<string>", final=False).filter("contaminated or " + str(k == 0).lower()), "leaks")
        parts = found if parts is None else parts.unionByName(found)
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    united = parts.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"),
    )

    @F.udf("n_hit long, spans array<struct<from:long,to:long>>")
    def unite(spans):
        out = merged((s["from"], s["to"]) for s in spans)
        return sum(b - a for a, b in out), out

    done = united.join(copies, "key").withColumn("u", unite("spans")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.select(
        "doc_id", "n_words", "u.n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.col("u.n_hit") > 0).alias("contaminated"), F.col("u.spans").alias("spans"),
    )


def _window_set(items: DataFrame, n: int):
    """The broadcast set of one block, whose number of windows is checked before."""
    return items.sparkSession.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in items.toLocalIterator()], n))


def _scanned(rows: DataFrame, windows, schema: str, final: bool) -> DataFrame:
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def scan(batches):
        block = windows.value
        for batch in batches:
            n_words, n_hit, n_items, sha, spans, names = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                n, own, items = block.scan(text)
                items = sorted(items)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in own))
                n_items.append(len(items))
                sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
                spans.append([{"from": a, "to": b} for a, b in own])
                names.append(items)
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()), "spans": pa.array(spans, span)}
            if not final:
                columns = {"key": batch.column("key"), **columns, "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(scan, schema)


def _window_sets(benchmark: DataFrame, n: int, block_windows: int):
    """The number of the benchmark's blocks, and an iterator of their broadcast sets."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(items, n, block_windows)
    return blocks, (_window_set(items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), n) for k in range(blocks))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without the documents in which a test window occurs; all columns stay.

    Each row is judged by its own text.  A benchmark of several blocks is scanned block by block, and
    what a block leaves is written for the next one.
    """

    def clean_of(windows):
        def clean(batches):
            block = windows.value
            for batch in batches:
                yield batch.filter(pa.array([not block.scan(t)[1] for t in batch.column("text").to_pylist()], pa.bool_()))

        return clean

    blocks, sets = _window_sets(benchmark, n, block_windows)
    for k, windows in enumerate(sets):
        before, docs = docs, docs.mapInArrow(clean_of(windows), docs.schema)
        if blocks > 1:
            docs = saved(docs, "clean")
            if k:
                drop(before)
            windows.unpersist()
    return docs


def _cut(text: str, spans) -> str:
    """``text`` without the words of the merged spans [from, to)."""
    raw = text.encode("utf-8", "replace")
    flat = raw.translate(WORD_BYTES)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*kept, raw[last:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the hit words cut out of ``text`` (again until none occurs); ``n_chars`` follows if present.

    A benchmark of several blocks is scanned block by block, and the hits of all blocks are cut together.
    """
    blocks, sets = _window_sets(benchmark, n, block_windows)
    out = docs
    if blocks == 1:
        windows = next(sets)

        @F.udf("string")
        def cut_all(text):
            while text and (spans := windows.value.scan(text)[1]):
                text = _cut(text, spans)
            return text

        out = docs.withColumn("text", cut_all("text"))
    else:
        span = "array<struct<from:int,to:int>>"
        cut = F.udf(lambda text, spans: _cut(text, merged((s["from"], s["to"]) for s in spans)) if spans else text, "string")
        hits_of = lambda windows: F.udf(lambda text: windows.value.scan(text)[1], span)
        while True:
            out = out.withColumn("__spans", F.array().cast(span))
            for windows in sets:
                out = saved(out.withColumn("__spans", F.concat("__spans", hits_of(windows)("text"))), "spans")
                windows.unpersist()
            found = not out.filter(F.size("__spans") > 0).isEmpty()
            out = saved(out.withColumn("text", cut("text", "__spans")).drop("__spans"), "cut")
            if not found:
                break
            _, sets = _window_sets(benchmark, n, block_windows)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
