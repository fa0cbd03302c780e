"""Texts whose sets of word shingles are alike, found without a miss and without comparing all pairs.

Every set is put in one order (rare shingles first).  Two sets of similarity s share a shingle among the
first size - ceil(s * size) + 1 of both, so documents meet at these; a shingle that many have in
front is replaced by pairs of itself and a later one, as such sets also share a second.  Pairs are passed
through bounds by size, place and a sketch before their texts are compared.  What is left of large
groups is compared in blocks by matrix products, which give no pairs but a spanning forest; documents
that are linked already are not compared again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.components import connected_components
from pricemap.llm.store import drop, saved

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Documents of one side of a comparison of a group's blocks.
BLOCK = 512
#: A key that so many documents have at most has its pairs listed.
PAIRED = 16
#: Bits of a shingle's hash that number its counter; counters only order shingles, so sharing one loses nothing.
COUNTER_BITS = 22
#: The largest bitmap of nodes that is broadcast (2**28 bits are 32 MB).
BITMAP_BITS = 28
#: Shingles to a bucket of a sketch, about.
SKETCHED = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; None has none."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Hashes of the different runs of ``n`` words (the whole sequence if it is shorter, none if it is empty)."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(own))
    out = np.zeros(len(own) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _ODD + own[k : k + len(out)]
        out ^= out >> np.uint64(32)
        out *= _ODD
    return np.unique(out ^ (out >> np.uint64(29))).view(np.int64)


def alike(common, a, b, similarity: float):
    """Whether sets of ``a`` and ``b`` with ``common`` members reach the similarity, in counts: 5 common >= 4 (a + b - common) is exact where a division isn't."""
    return common * (1 + similarity) >= similarity * (a + b) - 1e-3


# -- order, prefixes and sketches ----------------------------------------------------------------------


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_counts(unique: DataFrame, n: int) -> np.ndarray:
    """Documents by counter of their different shingles, over all documents: each task adds up its own in a table of fixed size.

    The tables are added up in two steps, so that no task takes those of all others.
    """
    size, parts = 1 << COUNTER_BITS, 64

    def count(batches):
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held, waiting = [], 0
            for t in batch.column("__text").to_pylist():
                held.append(_counter(shingle_hashes(t, n)))
                waiting += len(held[-1])
                if waiting > size:
                    sums += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
            if waiting:
                np.add.at(sums, np.concatenate(held), 1)
        if sums.any():
            rows = [zstd_bytes(x) for x in sums.reshape(parts, -1)]
            salt = TaskContext.get().partitionId() % 1024
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([salt] * parts, pa.int32()), pa.array(rows, pa.binary())], ["part", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(map(long_array, table.column("counts").to_pylist()))
        return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "counts": pa.array([zstd_bytes(total)], pa.binary())})

    schema = "part int, salt int, counts binary"
    found = unique.select("__text").mapInArrow(count, schema).groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    table = np.zeros((parts, size // parts), dtype=np.uint32)
    for r in found.toLocalIterator():
        table[r["part"]] = np.minimum(long_array(r["counts"]), (1 << 32) - 1)
    return table.reshape(-1)


def zstd_bytes(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8"), codec="zstd", asbytes=True) if len(counts) else b""


def long_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=8 * ((1 << COUNTER_BITS) // 64), codec="zstd", asbytes=True), "<i8")


def sketch_of(hashes: np.ndarray) -> bytes:
    """Numbers of the hashes by their first bits, in a power of two of buckets; 255 stands for any more."""
    bits = min(16, max(3, math.ceil(math.log2(max(1, len(hashes)) / SKETCHED))))
    return np.minimum(np.bincount((hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def common_bound(a: bytes, b: bytes) -> int:
    """What two sets have in common at most, by their sketches."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    x, y = (np.where(v == 255, 1 << 40, v) for v in (x, y))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())


def signatures(unique: DataFrame, n: int, similarity: float) -> DataFrame:
    """(__node, size, front, prefix, sketch) per document with words: its first shingles, of which ``front`` make sure that
    similar documents share one and one more that they share two."""
    counts = unique.sparkSession.sparkContext.broadcast(shingle_counts(unique, n))

    def sign(batches):
        for batch in batches:
            nodes, texts = batch.column("__node").to_pylist(), batch.column("__text").to_pylist()
            for k in range(0, len(texts), 500):
                rows = []
                for node, t in zip(nodes[k : k + 500], texts[k : k + 500]):
                    own = shingle_hashes(t, n)
                    if len(own):
                        front = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
                        rows.append((node, len(own), front, own[np.lexsort((own, counts.value[_counter(own)]))[: front + 1]], sketch_of(own)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["__node", "size", "front", "prefix", "sketch"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return saved(unique.select("__node", "__text").mapInArrow(sign, "__node long, size long, front long, prefix array<long>, sketch binary"), "signatures")


# -- keys at which similar documents meet ---------------------------------------------------------------


def _met(points: DataFrame, name: str) -> DataFrame:
    """The rows (point, __node, size, at) whose point another document has, with the number of them and the first one."""
    together = Window.partitionBy("point")
    counted = points.withColumns({"members": F.count("*").over(together), "head": F.min("__node").over(together)})
    return saved(counted.filter("members > 1"), name)


def first_points(signed: DataFrame) -> DataFrame:
    return signed.select("__node", "size", F.posexplode(F.slice("prefix", 1, F.col("front").cast("int"))).alias("at", "point"))


def second_points(many: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Points of the rows (__node, at) of shingles that many have in front: each with every later one of the prefix.

    Sets that need not share more than one shingle also meet at that one alone.
    """
    own = many.groupBy("__node").agg(F.collect_set("at").alias("starts"))
    joined = likely(signed.select("__node", "size", "prefix"), own.select("__node"), own.count()).join(own.hint("merge"), "__node")
    rows = joined.select("__node", "size", "prefix", F.explode("starts").alias("start"))
    first, last = F.get("prefix", F.col("start")), F.size("prefix") - 1
    later = F.transform(F.sequence(F.col("start") + 1, last), lambda k: F.struct(k.alias("at"), F.xxhash64(first, F.get("prefix", k)).alias("point")))
    alone = F.struct(F.col("start").alias("at"), F.xxhash64(first, first).alias("point"))
    none = F.array().cast("array<struct<at:int,point:bigint>>")
    points = F.concat(F.when(F.col("start") < last, later).otherwise(none), F.when(F.col("size") * similarity <= 1 + 1e-9, F.array(alone)).otherwise(none))
    return rows.select("__node", "size", F.inline(points))


def _pairs(met: DataFrame, shared: int, similarity: float) -> DataFrame:
    """Pairs (src, dst) that meet at a point that few have, where the sizes and what is left after their ``shared`` first common shingles allow the similarity."""
    a = met.filter(F.col("members") <= PAIRED)
    b = a.select("point", F.col("__node").alias("dst"), F.col("size").alias("dst_size"), F.col("at").alias("dst_at"))
    most = shared + F.least(F.col("size") - F.col("at") - 1, F.col("dst_size") - F.col("dst_at") - 1)
    fits = F.least("size", "dst_size") >= similarity * F.greatest("size", "dst_size") - 1e-3
    possible = (F.col("__node") < F.col("dst")) & fits & alike(most, F.col("size"), F.col("dst_size"), similarity)
    return a.join(b.hint("merge"), "point").filter(possible).select(F.col("__node").alias("src"), "dst").distinct()


def _sketched(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity."""

    def keep(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            own = [alike(common_bound(p, q), m, n, similarity) for p, q, m, n in zip(a, b, x, y)]
            yield batch.select(["src", "dst"]).filter(pa.array(own, pa.bool_()))

    of = lambda key, size, name: signed.select(F.col("__node").alias(key), F.col("size").alias(size), F.col("sketch").alias(name)).hint("merge")
    return pairs.join(of("dst", "y", "b"), "dst").join(of("src", "x", "a"), "src").mapInArrow(keep, "src long, dst long")


def likely(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The rows whose ``__node`` is in a bitmap of ``nodes``: all that are among the ``n`` nodes, and some others.

    The bitmap has eight bits a node and never more than 2**BITMAP_BITS, which bounds the broadcast.
    """
    bits = min(BITMAP_BITS, max(15, math.ceil(math.log2(8 * n + 1))))
    low = F.col("__node").bitwiseAND(F.lit((1 << bits) - 1))
    parts = nodes.groupBy(F.shiftright(low, 15).alias("part")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros((1 << (bits - 15), 4096), dtype=np.uint8)
    for r in parts.toLocalIterator():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def likely(batches):
        known = shared.value
        for batch in batches:
            at = batch.column("__node").to_numpy() & ((1 << bits) - 1)
            yield batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return rows.mapInArrow(likely, rows.schema)


# -- comparison of texts ---------------------------------------------------------------------------------


def _texts_of(unique: DataFrame, nodes: DataFrame) -> DataFrame:
    nodes = saved(nodes.distinct(), "compared-nodes")
    texts = likely(unique.select("__node", "__text"), nodes, nodes.count()).join(nodes.hint("merge"), "__node", "left_semi")
    return saved(texts, "compared-texts")


def verified_links(pairs: DataFrame, unique: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of a written table whose texts are alike.

    Texts are shuffled, not their shingles: those take twice the room and can't be compressed.
    """

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = shingle_hashes(x, n), shingle_hashes(y, n)
                keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts_of(unique, pairs.select(F.explode(F.array("src", "dst")).alias("__node")))
    text_of = lambda key, name: texts.select(F.col("__node").alias(key), F.col("__text").alias(name)).hint("merge")
    met = pairs.join(text_of("dst", "b"), "dst").join(text_of("src", "a"), "src").select("src", "dst", "a", "b")
    out = saved(met.mapInArrow(verify, "src long, dst long"), "verified")
    drop(texts)
    return out


def forest_of(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the sets that are alike: the sets that share nothing with others cost no comparison."""
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[number] > 1
    order = np.cumsum(count > 1) - 1
    number, owner = order[number[shared]], owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    size, step = int((count > 1).sum()), 8192
    by = np.argsort(number, kind="stable")
    number, owner = number[by], owner[by]
    for at in range(0, size, step):
        a, b = np.searchsorted(number, [at, at + step])
        part = np.zeros((len(sets), min(step, size - at)), dtype=np.float32)
        part[owner[a:b], number[a:b] - at] = 1
        common += part @ part.T
    linked = alike(common, n[:, None], n[None], similarity)
    links, left = [], np.ones(len(sets), dtype=bool)
    for k in range(len(sets)):
        if not left[k]:
            continue
        left[k], edge = False, [k]
        while edge:
            x = edge.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            links += [(x, int(y)) for y in new]
            edge += new.tolist()
    return links


def _compared_groups(groups: DataFrame, classes: DataFrame, unique: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links within each group (node, root), whose members' known ``classes`` (node, root) need no comparison of their own.

    A class of BLOCK members or more is dealt into blocks of its own, which meet all blocks but those of
    the same class; the others share blocks, each of which also meets itself.  A pair of blocks is one task's.
    """
    own = groups.join(classes.select("node", F.col("root").alias("class")).hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = own.groupBy("root", "class").agg(F.count("*").alias("m"))
    small = sizes.filter(F.col("m") < BLOCK).groupBy("root").agg(F.ceil(F.sum("m") / BLOCK).alias("mixed"))
    known = own.join(sizes.hint("merge"), ["root", "class"]).join(small.hint("merge"), "root", "left")
    large = F.col("m") >= BLOCK
    block = F.when(large, F.xxhash64("root", "class", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)))).otherwise(F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("mixed"))))
    dealt = saved(known.select("root", "node", block.alias("block"), F.when(large, F.col("class")).alias("class"), "mixed"), "dealt")
    blocks = dealt.groupBy("root", "block").agg(F.first("class").alias("class"), F.first("mixed").alias("mixed"))
    x = blocks.select("root", F.col("block").alias("x"), F.col("class").alias("x_class"), "mixed")
    y = blocks.select("root", F.col("block").alias("y"), F.col("class").alias("y_class"))
    apart = F.col("x_class").isNull() | F.col("y_class").isNull() | (F.col("x_class") != F.col("y_class"))
    pairs = x.join(y.hint("merge"), "root").filter((F.col("x") <= F.col("y")) & apart)
    # groups of one block share a task, as many as make about a block
    tasks = max(1, dealt.count() // BLOCK)
    alone = (F.col("x") == F.col("y")) & (F.coalesce("mixed", F.lit(0)) == 1)
    task = F.when(alone, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("x", "y"))
    pairs = pairs.select("root", "x", "y", F.xxhash64("x", "y").alias("pair"), task.alias("task"))
    meets = pairs.select("root", "pair", "task", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    members = dealt.select("root", "block", F.col("node").alias("__node")).join(meets.hint("merge"), ["root", "block"]).select("__node", "pair", "task")
    texts = _texts_of(unique, groups.select(F.col("node").alias("__node")))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair")
        nodes, pair = table.column("__node").to_numpy(), table.column("pair").to_numpy()
        texts, links = table.column("__text").to_pylist(), []
        edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            links += [(a + x, a + y) for x, y in forest_of([shingle_hashes(t, n) for t in texts[a:b]], similarity)]
        x, y = zip(*links) if links else ((), ())
        return pa.table({"src": pa.array(nodes[list(x)], pa.int64()), "dst": pa.array(nodes[list(y)], pa.int64())})

    out = saved(members.join(texts.hint("merge"), "__node").groupBy("task").applyInArrow(compare, "src long, dst long"), "group-links")
    drop(texts, dealt)
    return out


def similar_links(unique: DataFrame, n: int, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Links (src, dst) that connect the rows (__node, __text) whose ``n``-word shingle sets have that Jaccard similarity or more.

    ``known`` links are among them, and pairs that these connect aren't compared again.
    First, each node is compared with the smallest it meets; then only pairs that the links so far
    don't connect: copies of one text are compared once each, not all with all.
    """
    signed = signatures(unique, n, similarity)
    one = _met(first_points(signed), "first-points")
    pairs = saved(_sketched(_pairs(one, 1, similarity), signed, similarity), "first-pairs")
    heads = one.filter((F.col("members") > PAIRED) & (F.col("__node") != F.col("head"))).groupBy(F.col("__node").alias("dst")).agg(F.min("head").alias("src"))
    forest = pairs.groupBy("dst").agg(F.min("src").alias("src")).unionByName(_sketched(heads, signed, similarity).select("dst", "src")).distinct()
    if known is not None:
        forest = forest.join(known.hint("merge"), ["src", "dst"], "left_anti")
    forest = saved(forest, "first-compared")
    first = verified_links(forest, unique, n, similarity)
    if known is not None:
        first = first.unionByName(known)
    classes = saved(connected_components(first), "first-classes")
    class_of = lambda key, name: classes.select(F.col("node").alias(key), F.col("root").alias(name)).hint("merge")

    def unlike(met: DataFrame) -> DataFrame:
        """The rows of points that many documents of more than one class have."""
        own = met.filter(F.col("members") > PAIRED).join(class_of("__node", "class"), "__node", "left").withColumn("class", F.coalesce("class", "__node"))
        at_point = Window.partitionBy("point")
        return own.withColumns({"low": F.min("class").over(at_point), "high": F.max("class").over(at_point)}).filter("low <> high")

    many = saved(unlike(one).select("__node", "at"), "many-have")
    two = _met(second_points(many, signed, similarity), "second-points")
    more = pairs.unionByName(_pairs(two, 2, similarity)).distinct().join(forest.hint("merge"), ["src", "dst"], "left_anti")
    more = more.join(class_of("dst", "y"), "dst", "left").join(class_of("src", "x"), "src", "left").filter("x is null or y is null or x <> y").select("src", "dst")
    more = saved(_sketched(more, signed, similarity), "second-compared")
    heads = unlike(two).filter(F.col("__node") != F.col("head")).select(F.col("__node").alias("src"), F.col("head").alias("dst")).distinct()
    groups = saved(connected_components(heads), "groups")
    drop(signed, one, two, many, pairs)
    links = first.unionByName(verified_links(more, unique, n, similarity))
    if not groups.isEmpty():
        links = links.unionByName(_compared_groups(groups, classes, unique, n, similarity))
    return links
