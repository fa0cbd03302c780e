"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding; learned filters slide over overlapping chunks that cover the whole
document; each chunk's activations are max-pooled, and the largest and the mean of the chunks' values
are combined into one probability.  The network is trained here, on a bounded sample of labelled
documents; scoring runs on every document in the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, and bytes in all, of the training sample; which ones, a hash of the doc_id decides.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 3000, 12_000_000
WIDTH, DEPTH, FILTERS = 6, 4, 24
#: Bytes of a chunk; consecutive ones overlap by a filter's width, so that every place is seen.
CHUNK = 512
STEPS, BATCH, RATE, SEED = 700, 32, 0.01, 7
#: What a document of label 0, the rarer one, counts for in training.
LOW_WEIGHT = 2.0
THRESHOLD = 0.3


class ByteCnn:
    """Embedding, filters and output weights; ``base`` alone speaks where there was nothing to learn."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = np.zeros(2 * FILTERS, dtype=np.float32)
        self.base = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.base]

    def pooled(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, max of each chunk and filter, its place in the document); short texts are padded with zeros."""
        x = np.frombuffer(raw.ljust(WIDTH, b"\0"), dtype=np.uint8)
        best, place = [], []
        step = CHUNK - WIDTH + 1
        for at in range(0, len(x) - WIDTH + 1, 64 * step):
            part = x[at : at + 64 * step + WIDTH - 1]
            e = self.embedding[part]
            n = len(part) - WIDTH + 1
            windows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DEPTH), (e.strides[0], e.strides[1]))
            act = windows @ self.filters
            starts = np.arange(0, n, step)
            top = np.maximum.reduceat(act, starts, axis=0)
            best.append(top)
            place.append((act, starts, at))
        return x, np.maximum(np.concatenate(best) + self.bias, 0), place

    def score(self, raw: bytes) -> float:
        _, top, _ = self.pooled(raw)
        z = float(np.concatenate([top.max(axis=0), top.mean(axis=0)]) @ self.out + self.base[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _gradients(net: ByteCnn, raw: bytes, label: int, sums: list[np.ndarray]) -> None:
    """Add one document's gradients; only the places that won a max-pool have any."""
    x, top, places = net.pooled(raw)
    chunks = len(top)
    features = np.concatenate([top.max(axis=0), top.mean(axis=0)])
    z = float(features @ net.out + net.base[0])
    d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
    d *= 1.0 if label else LOW_WEIGHT
    sums[3] += d * features
    sums[4] += d
    d_top = np.repeat(d * net.out[None, FILTERS:] / chunks, chunks, axis=0)
    d_top[top.argmax(axis=0), np.arange(FILTERS)] += d * net.out[:FILTERS]
    d_top *= top > 0
    k = 0
    for act, starts, at in places:
        ends = np.append(starts[1:], len(act))
        for a, b in zip(starts, ends):
            g = d_top[k]
            k += 1
            live = np.flatnonzero(g)
            if not len(live):
                continue
            where = at + a + act[a:b, live].argmax(axis=0)
            near = x[where[:, None] + np.arange(WIDTH)]
            window = net.embedding[near].reshape(len(live), WIDTH * DEPTH)
            sums[1][:, live] += (window * g[live, None]).T
            sums[2][live] += g[live]
            back = (net.filters[:, live].T * g[live, None]).reshape(-1, DEPTH)
            np.add.at(sums[0], near.ravel(), back)


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> ByteCnn:
    """Adam over a fixed number of batches in a fixed order: the same sample gives the same network."""
    net = ByteCnn(seed)
    if not texts:
        return net
    rate = min(max(sum(labels) / len(labels), 0.02), 0.98)
    net.base[0] = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        return net
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(texts))])
        own, order = order[:BATCH], order[BATCH:]
        sums = [np.zeros_like(w) for w in net.weights()]
        for k in own:
            _gradients(net, texts[k], labels[k], sums)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        for w, g, m, v in zip(net.weights(), sums, first, second):
            g /= len(own)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(doc_id) -> F.Column:
    """crc32 of the doc_id as text leaves no remainder by 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> pd.DataFrame:
    """Text and quality of at most ``documents`` labelled rows outside the held-out fold, in an order fixed by hash.

    A document with several labels counts as the lower one, one with several texts by the first in order;
    a text that is over what is left of the sample's bytes is passed over.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    # a bound on the hash leaves about twice as many as are wanted, whatever the table's size
    mark = F.xxhash64("doc_id")
    least = (1 << 63) - 1 - min((1 << 64) - 1, (2 * documents + 100 << 64) // max(1, known.count()))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(mark >= F.lit(least))
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(mark, "doc_id").limit(documents)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    out, size = [], 0
    for r in found.orderBy(mark, "doc_id").toLocalIterator():
        own = len(r["text"].encode("utf-8", "replace"))
        if size + own <= SAMPLE_BYTES:
            size += own
            out.append((r["text"], r["quality"]))
    return pd.DataFrame(out, columns=["text", "quality"])


def score_documents(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """(doc_id, score) of every whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        for batch in batches:
            values = [shared.value.score((t or "").encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the sample and score every row: doc_id, held_out, score, predicted.

    Labels, lang, source and doc_id are no inputs of a score.  Null and empty texts get the score of
    padding; repeated rows each give a row; an empty table gives none; without two classes of labels
    every score is the labels' share of 1 (one half without labels).
    """
    sample = training_sample(docs, labels)
    net = train([(t or "").encode("utf-8", "replace") for t in sample["text"]], [int(x) for x in sample["quality"]])
    scored = score_documents(docs, net)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
