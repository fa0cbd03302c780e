"""Vector best-fit packing of token pieces into sequences.

A piece's demand is the vector (tokens, documents, attention cost).  A sequence has a capacity in
each dimension; a piece goes to the open sequence that fits it in every dimension and is best by
the weighted residual norm or the weighted dot product, longest pieces first.

A demand is a function of the length alone, so pieces of one length are interchangeable.  The plan
is made on the histogram of lengths (at most ``max_tokens`` rows, whatever the corpus' size): equal
sequences are kept as one pattern with a count.  Pieces then find their place by their rank among
pieces of their length, which is counted in salted buckets, so no length is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm import tokens
from pricemap.llm.store import saved

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Rows of one length that one task ranks.
BUCKET_ROWS = 200_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how the dimensions weigh in the choice.

    ``documents`` and ``attention`` (sum of squared lengths) default to what any sequence of
    ``tokens`` tokens satisfies: they then weigh in the choice but never bind, as lower values do.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def plan_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity) -> pd.DataFrame:
    """Best-fit-decreasing on a histogram of lengths, exactly as piece by piece.

    Returns runs (length, rank, seq, per, count, offset): of the pieces of ``length``, those from
    ``rank`` on lie ``per`` to a sequence from ``offset`` on in the ``count`` sequences from ``seq`` on.
    A piece that alone exceeds a capacity raises ValueError.
    """
    if capacity.score not in ("norm", "dot"):
        raise ValueError(f"score must be 'norm' or 'dot', not {capacity.score!r}")
    caps, weight = capacity.vector(), np.array(capacity.weights, dtype=float)
    room = np.zeros((0, 3), dtype=np.int64)
    amount = np.zeros(0, dtype=np.int64)
    content: list[tuple] = []
    for k in np.argsort(-lengths, kind="stable"):
        length, left = int(lengths[k]), int(counts[k])
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity {caps.tolist()}")
        share = need / caps
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1) & (amount > 0))
            if len(fits):
                free = room[fits] / caps
                rank = -(weight * share * free).sum(axis=1) if capacity.score == "dot" else (weight * (free - share) ** 2).sum(axis=1)
                at = int(fits[np.argmin(rank)])
                # under the norm a sequence that took a piece is the best for the next equal one too, under the product the worst
                most = 1 if capacity.score == "dot" else int((room[at] // need).min())
            else:  # a new sequence is the only one that fits, until it is full
                at = len(content)
                most = int((caps // need).min())
                room, amount = np.vstack([room, caps]), np.append(amount, -(-left // most))
                content.append(())
            for per in (most, left % most):
                whole = min(int(amount[at]), left // per) if per else 0
                if not whole:
                    continue
                if whole < amount[at]:  # the others of the pattern stay as they are
                    room, amount = np.vstack([room, room[at]]), np.append(amount, amount[at] - whole)
                    content.append(content[at])
                    amount[at] = whole
                room[at] = room[at] - per * need
                content[at] = (*content[at], (length, per))
                left -= whole * per
                break
    runs, ranks, seq = [], dict.fromkeys(map(int, lengths), 0), 0
    for own, n in zip(content, map(int, amount)):
        offset = 0
        for length, per in own:
            runs.append((length, ranks[length], seq, per, n, offset))
            ranks[length] += per * n
            offset += per * length
        seq += n
    return pd.DataFrame(runs, columns=["length", "rank", "seq", "per", "count", "offset"], dtype="int64")


def token_pieces(docs: DataFrame, vocabulary: str = tokens.WORD_BPE, end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """Pieces of every document's ids: (doc_id, piece, start, length, ids_crc32).

    Null and empty texts are the end id alone; a null doc_id stays null; repeated rows are documents
    of their own; an empty table gives no rows; other columns of ``docs`` are not read.
    """

    def cut(batches):
        for batch in batches:
            rows, own = [], []
            for at, ids in enumerate(tokens.encode_column(vocabulary, batch.column("text").to_pylist(), end_id)):
                for k in range(0, len(ids), 4 * max_tokens):
                    part = ids[k : k + 4 * max_tokens]
                    own.append(at)
                    rows.append((k // (4 * max_tokens), k // 4, len(part) // 4, tokens.crc32(part)))
            piece, start, length, crc = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_fit_pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with columns doc_id, piece, length.

    Every other column stays.  ``length`` must be 1 or more.  Equal rows take different places.
    """
    n = pieces.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    salted = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = saved(counts.withColumn("__before", F.coalesce(before, F.lit(0))), "pack-counts")
    histogram = starts.groupBy("length").agg(F.sum("__n").alias("n")).toPandas()
    runs = plan_patterns(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity)
    by_length = {int(k): {c: g[c].to_numpy() for c in g} for k, g in runs.groupby("length")}

    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = (
        salted.withColumn("__rank", F.row_number().over(order) - 1)
        .join(starts.drop("__n").hint("shuffle_hash"), ["length", "__bucket"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .select(*pieces.columns, "__rank")
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length):
            own, run = np.flatnonzero(length == size), by_length[int(size)]
            at = np.searchsorted(run["rank"], rank[own], side="right") - 1
            copy, slot = np.divmod(rank[own] - run["rank"][at], run["per"][at])
            seq[own], offset[own] = run["seq"][at] + copy, run["offset"][at] + slot * size
        return pd.DataFrame({"sequence_id": seq, "offset": offset})

    return ranked.withColumn("__place", place("length", "__rank")).select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), vocabulary: str = tokens.WORD_BPE, end_id: int = 0) -> DataFrame:
    """Tokenise whole documents, cut those longer than a sequence, and pack all pieces."""
    return best_fit_pack(saved(token_pieces(docs, vocabulary, end_id, capacity.tokens), "pack-pieces"), capacity)


def sequence_rows(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order.  A sequence has at most as many as it has tokens."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"),
    )
