"""Merkle manifest of a dataset: a content-addressed graph of digests, and every row's proof by descent.

Each language is a binary tree over its rows in order of doc_id; the languages' roots are the leaves of
one more tree.  A tree is kept as records from a digest to its children, in packs of ten levels that are
found by the digest at their top.  Proofs come from the root down: the requests of all leaves below a
digest travel together, a pack is fetched by that digest, the digits of the leaf's rank pick a child at
each level, and the children not picked are collected.  The collected path, reversed, is the proof.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemap.llm.order import ranked
from pricemap.llm.store import saved

#: Levels of a pack, and the leaves that it spans.
LEVELS = 10
SPAN = 1 << LEVELS
#: Copies of a pack that many equal subtrees share, so that fetching it is many tasks' work.
SALTS = 16
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Packs hold up to a hundred thousand bytes: few to a batch of rows.
BATCH = 64

_PACK = "tree string, seg long, digest string, records array<struct<digest: string, children: array<string>>>"
_REQUEST = "tree string, seg long, digest string, size long, path array<string>, top string, root string"


def joined_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) per row; tampered is the digest after n_chars + 1, null where it isn't tampered with."""

    def digest(n_chars: Column) -> Column:
        own = {c: F.col(c) for c in FIELDS} | {"n_chars": n_chars}
        return F.sha2(F.concat(*[field(own[c]) for c in FIELDS]), 256)

    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    # null is the first of languages, then bytes decide
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("n_chars")).alias("leaf"), F.when(hit, digest(more)).alias("tampered"))


def levels_of(size: int) -> int:
    return (size - 1).bit_length()


def folded(nodes: list[str], levels: int) -> tuple[str, dict[str, list[str]]]:
    """The digest over ``nodes`` after ``levels`` levels, and every digest's children; a node without a partner is hashed alone."""
    records: dict[str, list[str]] = {}
    for _ in range(levels):
        runs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
        nodes = [joined_digest(r) for r in runs]
        records.update(zip(nodes, runs))
    return nodes[0], records


def _packs(segments: DataFrame) -> DataFrame:
    """The packs of ``segments`` (tree, seg, size of the level, nodes in order)."""

    def build(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                top, records = folded(r["nodes"], min(LEVELS, levels_of(r["size"])))
                out.append({"tree": r["tree"], "seg": r["seg"], "digest": top, "records": [{"digest": d, "children": c} for d, c in records.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=_PACK_ARROW)

    return segments.select("tree", "seg", "size", "nodes").mapInArrow(build, _PACK)


_RECORD = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])
_PACK_ARROW = pa.schema([("tree", pa.string()), ("seg", pa.int64()), ("digest", pa.string()), ("records", pa.list_(_RECORD))])
_REQUEST_ARROW = pa.schema([("tree", pa.string()), ("seg", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("path", pa.list_(pa.string())), ("top", pa.string()), ("root", pa.string())])


def _salt(c: str = "seg") -> Column:
    return F.pmod(F.col(c), F.lit(SALTS)).cast("int")


@dataclass
class Forest:
    """Trees over ranked leaves: the leaves by segment, the packs of each tier, and the trees' roots (tree, digest, size)."""

    segments: DataFrame
    packs: list[DataFrame]
    roots: DataFrame


def forest(leaves: DataFrame, by: list, node: str) -> Forest:
    """Build the trees of ``leaves`` (tree, ``node`` and others), which ascend by ``by`` in their tree."""
    own = ranked(leaves, "tree", by)
    rest = [c for c in own.columns if c not in ("tree", "size")]
    entry = F.struct(F.col("rank"), *[F.col(c) for c in rest if c != "rank"])
    seg = F.shiftright("rank", LEVELS).alias("seg")
    # at most SPAN entries a segment
    segments = saved(own.groupBy("tree", seg).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(entry)).alias("entries")), "merkle-leaves")
    level = segments.select("tree", "seg", "size", F.col(f"entries.{node}").alias("nodes"))
    packs, roots = [], []
    while True:
        packs.append(saved(_packs(level), "merkle-packs"))
        tops = packs[-1].select("tree", "seg", "digest").join(level.select("tree", "seg", "size").hint("merge"), ["tree", "seg"])
        roots.append(tops.filter(F.col("size") <= SPAN).select("tree", "digest"))
        above = tops.filter(F.col("size") > SPAN).select("tree", F.col("seg").alias("rank"), "digest", F.ceil(F.col("size") / SPAN).alias("size"))
        if above.isEmpty():
            break
        nodes = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        level = saved(above.groupBy("tree", seg).agg(F.first("size").alias("size"), nodes.alias("nodes")), "merkle-levels")
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    sizes = segments.filter("seg = 0").select("tree", "size")
    return Forest(segments, packs, saved(every.join(sizes.hint("merge"), "tree"), "merkle-roots"))


def turns(digest: str, records: dict[str, list[str]], rank: int, levels: int) -> tuple[str, list[str]]:
    """Where the digits of ``rank`` lead below ``digest``, and what they leave aside: side and digest, or nothing beside a lone child."""
    path = []
    for k in range(levels - 1, -1, -1):
        children, digit = records[digest], rank >> k & 1
        path.append("" if len(children) == 1 else ("L" + children[0] if digit else "R" + children[1]))
        digest = children[digit]
    return digest, path


def fetched(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """``requests`` with the records that their digest tops."""
    store = packs.withColumn("salt", _salt()).groupBy("digest", "salt").agg(F.first("records").alias("records"))
    return requests.withColumn("salt", _salt()).join(store.hint("merge"), ["digest", "salt"]).drop("salt")


def _descend(requests: DataFrame, packs: DataFrame, tier: int) -> DataFrame:
    """Requests for the tops of tier ``tier``'s packs become requests for what lies a pack lower."""
    scale = SPAN**tier

    def go(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, BATCH):
                out = []
                for r in batch.slice(part, BATCH).to_pylist():
                    size = -(-r["size"] // scale)
                    records = {x["digest"]: x["children"] for x in r["records"]}
                    for k in range(r["seg"] * SPAN, min(size, (r["seg"] + 1) * SPAN)):
                        digest, path = turns(r["digest"], records, k % SPAN, min(LEVELS, levels_of(size)))
                        out.append({"tree": r["tree"], "seg": k, "digest": digest, "size": r["size"], "path": r["path"] + path, "top": r["top"], "root": r["root"]})
                yield pa.RecordBatch.from_pylist(out, schema=_REQUEST_ARROW)

    columns = ["tree", "seg", "digest", "size", "path", "top", "root"]
    return fetched(requests, packs).select(*columns, "records").mapInArrow(go, _REQUEST)


def descend(own: Forest, starts: DataFrame) -> DataFrame:
    """The leaf segments of ``own`` with what a request from the root has met so far: top digest, path, subroot, root, records.

    ``starts``: tree, path from the root to the tree's top, root.
    """
    at_top = own.roots.join(starts.hint("merge"), "tree")
    at_top = at_top.select("tree", F.lit(0).cast("long").alias("seg"), "digest", "size", "path", F.col("digest").alias("top"), "root")
    requests = None
    for tier in range(len(own.packs) - 1, -1, -1):
        low, high = (SPAN**tier if tier else 0), SPAN ** (tier + 1)
        mine = at_top.filter((F.col("size") > low) & (F.col("size") <= high))
        requests = mine if requests is None else requests.unionByName(mine)
        if tier:
            requests = saved(_descend(requests, own.packs[tier], tier), "merkle-requests")
    whole = fetched(requests, own.packs[0])
    return whole.join(own.segments.select("tree", "seg", "entries").hint("merge"), ["tree", "seg"])


def fold(leaf: str, siblings: list[str]) -> str:
    """The root over ``leaf`` and its siblings from the leaf's level up."""
    for s in siblings:
        leaf = joined_digest([s[1:], leaf] if s[:1] == "L" else [leaf, s[1:]])
    return leaf


@dataclass
class Manifest:
    """Both kinds of trees: the languages' over documents, and the one over the languages' roots."""

    documents: Forest
    top: Forest


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text); other columns aren't hashed."""
    own = saved(leaves(docs), "merkle-hashes")
    documents = forest(own, ["doc_id", "leaf"], "leaf")
    top = forest(documents.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of_tree"), "digest"), ["of_tree"], "digest")
    return Manifest(documents, top)


_STARTS = "tree string, path array<string>, root string"


def _starts(top: Forest) -> DataFrame:
    """For each language its tree, the path from the root to it and the root."""

    def go(batches):
        for batch in batches:
            for r in batch.to_pylist():
                records = {x["digest"]: x["children"] for x in r["records"]}
                levels = min(LEVELS, levels_of(r["size"]))
                out = [(e["of_tree"], r["path"] + turns(r["digest"], records, e["rank"] % SPAN, levels)[1], r["root"]) for e in r["entries"]]
                tree, path, root = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(path, pa.list_(pa.string())), pa.array(root, pa.string())], ["tree", "path", "root"])

    from_root = top.roots.select("tree", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    return descend(top, from_root).mapInArrow(go, _STARTS)


_PROOF = "doc_id long, leaf string, subroot string, root string, siblings array<string>, proof_sha256 string, folded_root string, verified boolean"


def proofs(of: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, siblings (from the leaf's level up; side and digest, empty beside a lone node), proof_sha256, folded_root, verified.

    folded_root is computed from the tampered leaf where there is one.  Null languages are one tree, null
    values hash as ``-``; null doc_ids come first and aren't tampered with; rows of one doc_id come in order
    of their leaves; an empty table gives none.
    """

    def go(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, BATCH):
                rows = []
                for r in batch.slice(part, BATCH).to_pylist():
                    records = {x["digest"]: x["children"] for x in r["records"]}
                    levels = min(LEVELS, levels_of(r["size"]))
                    for e in r["entries"]:
                        leaf, path = turns(r["digest"], records, e["rank"] % SPAN, levels)
                        siblings = (r["path"] + path)[::-1]
                        root = fold(e["tampered"] or leaf, siblings)
                        rows.append((e["doc_id"], leaf, r["top"], r["root"], siblings, joined_digest([s[1:] for s in siblings]), root, root == r["root"]))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "leaf", "subroot", "root", "siblings", "proof_sha256", "folded_root", "verified"])

    starts = saved(_starts(of.top), "merkle-starts")
    return descend(of.documents, starts).mapInArrow(go, _PROOF)
