"""SimHash near-duplicates with multi-index hashing.

Fingerprints are cut into segments, with a table for each: it files a fingerprint under its value of that
segment.  Of two fingerprints at distance 2 or less, some segment differs in at most 2 // segments
bits, so each fingerprint looks up the small Hamming ball of its own value in every segment's table,
and the complete distance of what it fetches is verified.  A value that many fingerprints have, as
in a large group of near copies, is looked up in tables of the other segments' halves within it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.components import connected_components
from pricemap.llm.similar import likely, similar_links, verified_links, words_of
from pricemap.llm.store import drop, saved

SEED = 42
#: Bits in which linked fingerprints differ at most.
DISTANCE = 2
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """Every run of ``n`` words, repeats included; the whole sequence if it is shorter, none if it is empty."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    to = np.cumsum(sizes + 1) - 1
    start = to - sizes
    return [joined[a:b] for a, b in zip(start[: len(words) - n + 1].tolist(), to[n - 1 :].tolist())]


def majority_bits(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; 0 if there are none."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint(text: str | None, n: int = 3) -> int:
    own = shingles_of(words_of(text), n)
    return majority_bits(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), dtype=np.uint64, count=len(own)))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's 64 bits as a signed long."""

    def prints(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(prints, "doc_id long, fp long")


#: Parts that the members of one component are joined in.
SALTS = 32
#: Fingerprints whose rows one task makes.
TASK_PRINTS = 20_000
#: Rows that meet at one value of a segment; beyond, the value has tables of its own.
BUCKET = 256


def _part(low: int, bits: int) -> Column:
    """``bits`` bits of the fingerprint from bit ``low`` on."""
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits: int, radius: int) -> Column:
    """The values at distance ``radius`` (0 or 1) or less."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return F.concat(F.array(value), flipped) if radius else F.array(value)


def _tables(rows: DataFrame, windows: list[tuple[int, int]], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the fingerprints file (dst) and look up (src) under ``keep``, part and value of each of ``windows`` (low, bits)."""
    radius = DISTANCE // len(windows)
    place = lambda k: lambda v: F.struct(F.lit(k).alias("part"), v.alias("value"))
    filed = F.array(*[place(k)(_part(*w)) for k, w in enumerate(windows)])
    asked = F.concat(*[F.transform(_ball(_part(*w), w[1], radius), place(k)) for k, w in enumerate(windows)])
    return rows.select(*keep, F.col("fp").alias("dst"), F.inline(filed)), rows.select(*keep, F.col("fp").alias("src"), F.inline(asked))


def near_links(prints: DataFrame, segments: int = 2, verify: bool = True) -> DataFrame:
    """(part, src, dst) of all different fingerprints ``fp`` at distance 2 or less, by the segments' tables in which they meet.

    Without ``verify``, all that is fetched.  The tables' rows are hashed, those that look up stream by.
    """
    size, half = 64 // segments, 64 // segments // 2
    key, within = ["part", "value"], ["of_part", "of_value", "part", "value"]
    near = (F.col("src") > F.col("dst")) & ((F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE) | F.lit(not verify))
    # a fingerprint becomes some 70 rows: few of them to a task
    prints = prints.select("fp").repartition(max(1, -(-prints.count() // TASK_PRINTS)), "fp")
    filed, asked = _tables(prints, [(k * size, size) for k in range(segments)], [])
    many = saved(filed.groupBy(*key).count().filter(F.col("count") > BUCKET).select(*key), "many-of-a-value")
    # a value that many have is one row without a fingerprint: who meets it looks on in the tables within it
    few = filed.join(many.hint("merge"), key, "left_anti").unionByName(many.withColumn("dst", F.lit(None).cast("long")))
    met = saved(asked.join(few.hint("shuffle_hash"), key).filter(near | F.col("dst").isNull()), "met-in-segments")
    found = met.filter("dst is not null").select("part", "src", "dst")
    for k in range(segments):
        others = [(j * size + low, half) for j in range(segments) if j != k for low in (0, half)]
        rows = lambda df, name, k=k: df.filter(F.col("part") == k).select(F.col("part").alias("of_part"), F.col("value").alias("of_value"), F.col(name).alias("fp"))
        entries, _ = _tables(rows(filed.join(many.hint("merge"), key, "left_semi"), "dst"), others, within[:2])
        _, lookups = _tables(rows(met.filter("dst is null"), "src"), others, within[:2])
        found = found.unionByName(lookups.join(entries.hint("shuffle_hash"), within).filter(near).select(F.col("of_part").alias("part"), "src", "dst"))
    return found.distinct()


def near_duplicates(docs: DataFrame, n: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    Equal fingerprints and those at distance 2 or less link; component_id is the smallest doc_id that is
    reached (null only where no member has one).  Null and empty texts have fingerprint zero and link
    like any other; repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    rows = saved(fingerprints(docs, n), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints-distinct")
    links = saved(near_links(distinct, segments).select("src", "dst").distinct(), "fingerprint-links")
    linked = connected_components(links).withColumnRenamed("node", "fp")
    member = linked.join(distinct.hint("merge"), "fp")
    # the one row of a component is joined to its members by salt, so a large one is many tasks' work
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    renamed = salted.join(smallest.hint("merge"), ["root", "salt"]).select("fp", "component_id")
    of_print = distinct.join(renamed.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    of_print = saved(of_print, "fingerprint-components")
    # a fingerprint that many copies share is split by adaptive execution: its other side is one row
    joined = rows.join(of_print.hint("merge"), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near-duplicates by similarity: one document of each group stays ---------------------------------

def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row per different word sequence (the smallest doc_id's): ``__node`` and ``__row``, the row as it was.

    Copies meet in a partial aggregation before they are shuffled.
    """

    def digests(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), "text").cast(pa.string()).to_pylist()
            own = [np.frombuffer(hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest(), "<i8").tolist() for t in texts]
            node, twin = zip(*own) if own else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(node, pa.int64()), pa.array(twin, pa.int64())], ["row", "node", "twin"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = whole.withColumns({"node": F.lit(0).cast("long"), "twin": F.lit(0).cast("long")}).schema
    marked = whole.mapInArrow(digests, schema)
    first = F.min_by("row", F.struct(F.col("row.doc_id").isNull(), "row.doc_id"))
    return marked.groupBy("node", "twin").agg(first.alias("__row")).select(F.col("node").alias("__node"), "__row")


def fingerprint_links(unique: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links (src, dst) of the rows (__node, __text) whose fingerprints the segments' tables bring together and whose shingles are alike.

    A node is compared with the smallest one of its fingerprint, and a fingerprint's smallest node with the smallest that it meets.
    """
    rows = saved(fingerprints(unique.select(F.col("__node").alias("doc_id"), F.col("__text").alias("text")), n), "fingerprints")
    first = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints-distinct")
    same = rows.join(first.hint("merge"), "fp").filter("doc_id <> first").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    of = lambda c, name: first.select(F.col("fp").alias(c), F.col("first").alias(name)).hint("merge")
    near = near_links(first).select("src", "dst").join(of("src", "x"), "src").join(of("dst", "y"), "dst")
    near = near.groupBy(F.greatest("x", "y").alias("dst")).agg(F.min(F.least("x", "y")).alias("src")).select("src", "dst")
    return verified_links(saved(same.unionByName(near), "fingerprint-pairs"), unique, n, similarity)


def one_of_each_group(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies (the smallest doc_id), all columns as they were.

    Links come by fingerprints first, each with an exact check; what fingerprints of 64 bits can't bring together, or leave
    apart, the join on rare shingles completes.  Texts without words are copies of each other; a row with a null doc_id stays only where no copy has
    one; an empty table gives none; columns of any name are kept.
    """
    whole = saved(distinct_documents(docs), "distinct-documents")
    unique = whole.select("__node", F.col("__row.doc_id").cast("long").alias("__id"), F.col("__row.text").cast("string").alias("__text"))
    known = fingerprint_links(unique, n, similarity)
    groups = saved(connected_components(similar_links(unique, n, similarity, known)), "similar-groups")
    ids = likely(unique.select("__node", "__id"), groups.select(F.col("node").alias("__node")), groups.count())
    own = groups.join(ids.withColumnRenamed("__node", "node").hint("merge"), "node")
    stays = own.groupBy("root").agg(F.min_by("node", F.struct(F.col("__id").isNull(), "__id", "node")).alias("stays"))
    leave = saved(groups.join(stays.hint("merge"), "root").filter("node <> stays").select(F.col("node").alias("__node")), "leaving")
    return whole.join(leave.hint("merge"), "__node", "left_anti").select("__row.*")
