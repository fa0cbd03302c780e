"""Quality rules with a suffix array.

The words of a batch of documents are sorted as suffixes by prefix doubling (documents never meet:
the document number leads every key).  Neighbours' longest common prefixes give, for each place, the
longest passage from there that occurs again in the same document; the maximal repeated passages'
spans unite to the covered part.  A document is kept if the covered fraction and the longest repeat
stay below their limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the method's verdict: repeats of at least so many words count, they may cover this
#: percentage of the words, and none may be longer than this many words.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 30, 50

#: Words that are sorted at once; a longer document is sorted alone.
BATCH_WORDS = 400_000

_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"


def repeat_lengths(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each place, the number of words of the longest passage from there that occurs again in its document.

    ``doc``: ascending document number of each word; ``word``: word numbers, equal words equal.
    """
    n = len(word)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    end = np.searchsorted(doc, doc, side="right")  # where each place's document ends
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int32)
    rank[order] = _group_starts(key[order])
    # ranks[k]: equal where the next 2**k words are equal; a place's rank is the first place of its class in suffix order
    ranks, step = [rank], 1
    while True:
        live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(live):
            break
        follow = live + step
        second = np.where(follow < end[live], rank[np.minimum(follow, n - 1)].astype(np.int64) + 1, 0)
        key = rank[live] * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        old, places = rank[live][order], live[order]
        rank = rank.copy()
        rank[places] = old + (_group_starts(key[order]) - _group_starts(old))
        ranks.append(rank)
        step *= 2
    # all ranks differ now: they are the inverse of the suffix array
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    left, right = suffix[:-1], suffix[1:]
    pairs = np.flatnonzero(ranks[0][left] == ranks[0][right])
    left, right = left[pairs], right[pairs]
    i, j, common = left.copy(), right.copy(), np.zeros(len(pairs), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero((i < end[left]) & (j < end[right]))
        at = at[ranks[k][i[at]] == ranks[k][j[at]]]
        i[at] += 1 << k
        j[at] += 1 << k
        common[at] += 1 << k
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with the same value."""
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def covered(starts: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """Which words lie inside a passage of at least ``least`` words that starts at its place."""
    own = np.flatnonzero(lengths >= least)
    edge = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(edge, own, 1)
    np.add.at(edge, own + lengths[own], -1)
    return np.cumsum(edge[:-1]) > 0


def dup_lines(raw: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def measures(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat."""
    raws = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    lists = [r.split() for r in raws]
    n_words = np.array([len(x) for x in lists], dtype=np.int64)
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for own in lists for w in own), dtype=np.int64, count=int(n_words.sum()))
    doc = np.repeat(np.arange(len(lists)), n_words)
    lengths = repeat_lengths(doc, word)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=len(lists)).astype(np.int64)

    longest = np.zeros(len(lists), dtype=np.int64)
    np.maximum.at(longest, doc, lengths)
    return {
        "n_words": n_words,
        # bytes of the words less continuation bytes, which only words hold
        "word_chars": np.array([sum(map(len, own)) - len(r) + len(r.translate(None, _CONTINUES)) for own, r in zip(lists, raws)], dtype=np.int64),
        "n_symbols": np.array([len(r.translate(None, _SYMBOLS)) for r in raws], dtype=np.int64),
        "n_dup_lines": np.array([dup_lines(r) for r in raws], dtype=np.int64),
        "n_repeat_words": per_doc(covered(doc, lengths, 5)),
        "n_covered": per_doc(covered(doc, lengths, min_repeat)),
        "longest_repeat": longest,
    }


def quality_rules(
    docs: DataFrame, min_words: int = 10, max_repeat_words: int = 20, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Per document row: doc_id, the measures, base_failed and kept.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeat_words`` percent of them in
    5-word windows found twice.  ``kept``: not base_failed, at most ``max_covered`` percent of the
    words in repeats of ``min_repeat`` words or more, and no repeat of over ``max_repeat`` words.
    Null and empty texts have no words and fail.  Repeated rows each give a row; other columns are
    not read; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def measure(batches):
        for batch in batches:
            texts, parts, own, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:
                own.append(text)
                size += len(text or "") // 6
                if size >= BATCH_WORDS:
                    parts.append(measures(own, min_repeat))
                    own, size = [], 0
            parts.append(measures(own, min_repeat))
            columns = {k: np.concatenate([p[k] for p in parts]) for k in names}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[k], pa.int64()) for k in names)], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(measure, "doc_id long, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_words * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", kept)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, in one pass over the texts."""
    verdict = {"min_words": 10, "max_repeat_words": 20, "min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_repeat": MAX_REPEAT} | limits

    def good(batches):
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < BATCH_WORDS):
                    size += len(texts[to] or "") // 6
                    to += 1
                m = measures(texts[at:to], verdict["min_repeat"])
                keep = (m["n_words"] >= verdict["min_words"]) & (100 * m["n_repeat_words"] <= verdict["max_repeat_words"] * m["n_words"])
                keep &= (100 * m["n_covered"] <= verdict["max_covered"] * m["n_words"]) & (m["longest_repeat"] <= verdict["max_repeat"])
                yield batch.slice(at, to - at).filter(pa.array(keep))
                at = to

    return docs.mapInArrow(good, docs.schema)
