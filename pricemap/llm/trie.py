"""Prefix trie of conversations, in balanced parentheses.

Conversations are sorted by their turns and dealt into shards by range, so that the members of each prefix
follow each other.  A shard writes its part of the trie as balanced parentheses: ``findclose``, over blocks
with their least excess, delimits every node's subtree, the rank of leaf pairs counts its leaves, and cumulative arrays
over the nodes give its members and savings.  Only the nodes above a shard's first and last
conversation, its spines, can go on in the next shards: they are merged by what they spell.

A conversation is cut into pages of turns, so no row holds a whole long one; the part of the trie below a
page's end hangs on the node there, and pages are worked from the last one up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.order import ranked
from pricemap.llm.store import drop, saved

#: Conversations of a family share the first turns of the one whose number divides by FAMILY; at most HEADS - 1 of them.
FAMILY, HEADS = 5, 9
#: Turns of a page.
PAGE = 1 << 15
#: Turns of a shard, about.
SHARD_TURNS = 500_000
#: Parentheses of a block with one least excess.
BLOCK = 64
#: Opens whose blocks are looked at together.
AT_ONCE = 1 << 14
#: Bytes of a turn's digest.
DIGEST = 16
FAR = np.iinfo(np.int64).max


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis where its closing one is: the first place after it with less excess."""
    goal, at = excess[opens] - 1, np.full(len(opens), -1, dtype=np.int64)
    blocks = np.full(-(-len(excess) // BLOCK) * BLOCK, FAR)
    blocks[: len(excess)] = excess
    blocks = blocks.reshape(-1, BLOCK)
    levels = [blocks.min(axis=1)]
    while len(levels[-1]) > 1:
        low = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], FAR)
        levels[-1] = low
        levels.append(low.reshape(-1, 2).min(axis=1))

    def within(which: np.ndarray, block: np.ndarray, after: np.ndarray) -> None:
        for k in range(0, len(which), AT_ONCE):
            w, b = which[k : k + AT_ONCE], block[k : k + AT_ONCE]
            low = (blocks[b] <= goal[w, None]) & (np.arange(BLOCK) > after[k : k + AT_ONCE, None])
            first = low.argmax(axis=1)
            hit = low[np.arange(len(w)), first]
            at[w[hit]] = b[hit] * BLOCK + first[hit]

    within(np.arange(len(opens)), opens // BLOCK, opens % BLOCK)
    rest = np.flatnonzero(at < 0)
    node, level = opens[rest] // BLOCK + 1, np.full(len(rest), -1)
    for k, low in enumerate(levels):
        # up: a right child is looked at by itself, a left one with its parent
        look = (level < 0) & ((node % 2 == 1) | (k == len(levels) - 1))
        hit = np.flatnonzero(look)[low[np.minimum(node[look], len(low) - 1)] <= goal[rest[look]]]
        level[hit] = k
        up = level < 0
        node[up] = (node[up] + 1) // 2
    for k in range(len(levels) - 2, -1, -1):
        down = level > k
        left = 2 * node[down]
        node[down] = np.where(levels[k][left] <= goal[rest[down]], left, left + 1)
    within(rest, node, np.full(len(rest), -1))
    return at


def common_turns(digests: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many first turns each conversation shares with the one before it; the first shares none."""
    sizes = np.diff(offsets)
    least = np.minimum(sizes[1:], sizes[:-1])
    pair = np.repeat(np.arange(1, len(sizes)), least)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(least) - least, least)
    apart = np.flatnonzero((digests[offsets[pair] + turn] != digests[offsets[pair - 1] + turn]).any(axis=1))
    shared = np.concatenate([[0], least])
    who, first = np.unique(pair[apart], return_index=True)
    shared[who] = turn[apart[first]]
    return shared


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def shard_nodes(rows: dict[str, list]) -> dict[str, list]:
    """The nodes of sorted rows (anchor, key, sizes, conv_id, ends, next_anchor, below_leaves, below_saved, below_children).

    ``below_leaves`` is -1 where the conversation ends in this page.  A node of a spine has ``key`` and what
    the shard adds to it; any other is complete, but for parent_conv_id where ``parent_key`` names a spine's node.
    """
    keys, convs = rows["key"], np.asarray(rows["conv_id"], dtype=np.int64)
    n, sizes = len(keys), np.array([len(k) // DIGEST for k in keys], dtype=np.int64)
    offsets = running(sizes)
    digests = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    texts = np.fromiter((s for own in rows["sizes"] for s in own), dtype=np.int64, count=offsets[-1])
    shared = common_turns(digests, offsets)
    fresh = np.array([k == 0 or rows["anchor"][k] != rows["anchor"][k - 1] for k in range(n)])
    shared[fresh] = -1  # a trie of its own, from its root on

    opened = sizes - shared
    closed = np.concatenate([[0], sizes[:-1] - shared[1:]])
    bits = np.repeat(np.tile(np.array([0, 1], dtype=np.int8), n), np.stack([closed, opened], axis=1).ravel())
    bits = np.concatenate([bits, np.zeros(sizes[-1] + 1, dtype=np.int8)])
    opens = np.flatnonzero(bits)
    closes = find_close(np.cumsum(2 * bits.astype(np.int64) - 1), opens)
    count = len(opens)
    after = np.arange(count) + (closes - opens + 1) // 2  # the node that follows a subtree
    first = np.repeat(np.arange(n), opened)
    depth = shared[first] + 1 + np.arange(count) - np.repeat(running(opened)[:-1], opened)
    bytes_of = np.where(depth > 0, texts[np.maximum(offsets[first] + depth - 1, 0)] if len(texts) else 0, 0)
    end = np.cumsum(opened) - 1  # the node at which each row's turns end

    within = lambda values: (total := running(values))[after] - total[:-1]
    pairs = running((bits[:-1] == 1) & (bits[1:] == 0))
    members = within(np.bincount(end, minlength=count))
    hung = np.full(count, -1, dtype=np.int64)
    hung_saved, hung_children = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    for into, c in ((hung, "below_leaves"), (hung_saved, "below_saved"), (hung_children, "below_children")):
        np.maximum.at(into, end, rows[c])  # some rows may end at the node, others go on
    below = hung >= 0
    own_leaves = np.where(below, hung, 0)
    leaves = pairs[closes] - pairs[opens] + within(np.where(below, hung - 1, 0))
    own_saved = (members - 1) * bytes_of
    saved_here = within(own_saved + hung_saved)
    smallest = np.minimum.reduceat(np.append(convs, FAR), np.stack([first, first + members], axis=1).ravel())[::2]
    place = np.lexsort((np.arange(count), depth))
    rank = depth * count + np.arange(count)
    parent = place[np.maximum(np.searchsorted(rank[place], rank - count) - 1, 0)]
    parent = np.where(depth > 0, parent, -1)
    children = np.bincount(parent[parent >= 0], minlength=count) + hung_children

    spine = np.zeros(count, dtype=bool)
    spine[: sizes[0] + 1] = True
    spine |= (opens <= opens[end[-1]]) & (closes >= closes[end[-1]])
    lower = np.flatnonzero(spine & (parent >= 0))
    sums = lambda values: np.bincount(parent[lower], weights=None if values is None else values[lower], minlength=count).astype(np.int64)
    part_leaves = leaves - sums(leaves) - np.where((depth >= 0) & (after == np.arange(count) + 1) & ~below, 1, 0) - own_leaves
    part_saved = saved_here - own_saved - hung_saved - sums(saved_here)
    part_children = children - hung_children - sums(None)

    names: list[bytes | None] = [None] * count
    for path in (np.arange(sizes[0] + 1), np.flatnonzero((opens <= opens[end[-1]]) & (closes >= closes[end[-1]]))):
        key, spelt = keys[first[path[-1]]], hashlib.md5()
        for d, k in enumerate(path.tolist()):
            if d:
                spelt.update(key[(d - 1) * DIGEST : d * DIGEST])
            names[k] = spelt.digest()
    ids: dict[int, list[str]] = {}
    for k, c in zip(end[rows["ends"]].tolist(), convs[rows["ends"]].tolist()):
        ids.setdefault(k, []).append(str(c))
    nothing = hashlib.sha256(b"").hexdigest()
    last = {k: a for k, a in zip(end.tolist(), rows["next_anchor"]) if a is not None}
    return {
        "anchor": [rows["anchor"][k] for k in first.tolist()], "key": names, "depth": depth.tolist(), "conv_id": smallest.tolist(),
        "parent_key": [None if p < 0 else names[p] for p in parent.tolist()], "parent_conv_id": [None if p < 0 else int(smallest[p]) for p in parent.tolist()],
        "n_convs": members.tolist(), "n_children": np.where(spine, part_children, children).tolist(), "n_leaves": np.where(spine, part_leaves, leaves).tolist(),
        "saved_tokens": np.where(spine, part_saved, saved_here).tolist(), "bytes": bytes_of.tolist(), "below_leaves": hung.tolist(), "below_saved": hung_saved.tolist(),
        "below_children": hung_children.tolist(), "next_anchor": [last.get(k) for k in range(count)], "ids": [",".join(ids[k]) if k in ids and spine[k] else None for k in range(count)],
        "ends_sha256": [hashlib.sha256(",".join(ids[k]).encode()).hexdigest() if k in ids else nothing for k in range(count)],
    }


_NODE = "shard int, anchor string, key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, below_leaves long, below_saved long, below_children long, next_anchor string, ids string, ends_sha256 string"
_ROW = ("anchor", "key", "sizes", "conv_id", "ends", "next_anchor", "below_leaves", "below_saved", "below_children")
_MERGED = "anchor string, key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, next_anchor string"


def merged_spines(parts: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one trie's spines from what each shard adds: at most two paths a shard."""
    nodes: dict[bytes, dict] = {}
    for r in parts.to_dict("records"):
        own = nodes.setdefault(r["key"], r | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "below_leaves": -1})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            own[c] += r[c]
        own["conv_id"] = min(own["conv_id"], r["conv_id"])
        if r["below_leaves"] >= 0:
            own |= {c: r[c] for c in ("below_leaves", "below_saved", "below_children", "next_anchor")}
    for own in sorted(nodes.values(), key=lambda x: -x["depth"]):
        if own["below_leaves"] >= 0:
            own["n_leaves"] += own["below_leaves"]
            own["n_children"] += own["below_children"]
            own["saved_tokens"] += own["below_saved"]
        own["n_leaves"] = own["n_leaves"] or 1
        own["saved_tokens"] += (own["n_convs"] - 1) * own["bytes"]
        if own["depth"]:
            above = nodes[own["parent_key"]]
            above["n_children"] += 1
            above["n_leaves"] += own["n_leaves"]
            above["saved_tokens"] += own["saved_tokens"]
    for own in nodes.values():
        own["parent_conv_id"] = nodes[own["parent_key"]]["conv_id"] if own["depth"] else None
    out = pd.DataFrame(nodes.values(), columns=[c.split()[0] for c in _MERGED.split(", ")])
    return out.astype({"parent_conv_id": "Int64"})


def page_nodes(rows: DataFrame, shards: int) -> DataFrame:
    """The nodes of the tries of one page's ``rows``: anchor, next_anchor, depth within the page and the figures."""

    def go(batches):
        whole = [b for b in batches if b.num_rows]
        if whole:
            table = pa.Table.from_batches(whole)
            shard = table.column("shard")[0].as_py()
            own = shard_nodes({c: table.column(c).to_pylist() for c in _ROW})
            schema = pa.schema([(c, t) for c, t in _NODE_ARROW if c != "shard"])
            nodes = pa.table(own, schema=schema).add_column(0, "shard", pa.array([shard] * len(own["key"]), pa.int32()))
            yield from nodes.to_batches(10_000)

    order = ["anchor", "key", "conv_id"]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    nodes = saved(dealt.select("shard", *_ROW).mapInArrow(go, _NODE), "trie-nodes")
    parts = nodes.filter("key is not null")
    spines = saved(parts.drop("ids", "ends_sha256").groupBy("anchor").applyInPandas(merged_spines, _MERGED), "trie-spines")

    def digests(batches):
        # one node's numbers come one after another, shard by shard, and are hashed as they come
        at, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["anchor"], r["key"]):
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"anchor": at[0], "key": at[1], "ends_sha256": state.hexdigest()}])
                    at, state = (r["anchor"], r["key"]), hashlib.sha256(r["ids"].encode())
                else:
                    state.update(b"," + r["ids"].encode())
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"anchor": at[0], "key": at[1], "ends_sha256": state.hexdigest()}])

    ends = parts.filter("ids is not null").select("anchor", "key", "shard", "ids").repartition("anchor", "key").sortWithinPartitions("anchor", "key", "shard")
    ends = ends.mapInArrow(digests, "anchor string, key binary, ends_sha256 string")
    figures = ["anchor", "next_anchor", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = spines.join(ends.hint("merge"), ["anchor", "key"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    # a spine's node may have many children: each shard gets its own spines' smallest members
    of_shard = parts.select("shard", "anchor", "key").join(spines.select("anchor", "key", "conv_id").hint("merge"), ["anchor", "key"])
    of_shard = of_shard.select("shard", "anchor", F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent")).distinct()
    inner = nodes.filter("key is null").join(of_shard.hint("merge"), ["shard", "anchor", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("__parent", "parent_conv_id"))
    return saved(merged.select(*figures).unionByName(inner.select(*figures)), "trie-page")


_LONG = dict.fromkeys(("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes", "below_leaves", "below_saved", "below_children"), pa.int64())
_NODE_ARROW = [(c.split()[0], _LONG.get(c.split()[0]) or {"shard": pa.int32(), "key": pa.binary(), "parent_key": pa.binary()}.get(c.split()[0], pa.string())) for c in _NODE.split(", ")]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv_id, place (from 0), digest and bytes of each rebuilt turn; conv_id and length of each conversation.

    A turn is told by a digest of its role and text, so texts aren't moved.  Turns that tie come in order of it.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).alias("bytes"))
    turns = saved(ranked(own, "conv_id", ["turn", "digest"]), "conversation-turns")
    convs = turns.filter("rank = 0").select("conv_id", "size", (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    of_base = convs.filter("conv_id = base").select("base", F.col("size").alias("base_size"))
    head = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = convs.join(of_base.hint("merge"), "base", "left").withColumn("head", head)
    convs = saved(convs.withColumn("length", F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "conversations")
    later = turns.join(convs.select("conv_id", "h", "head").hint("merge"), "conv_id").filter("rank >= h")
    later = later.select("conv_id", (F.col("head") + F.col("rank") - F.col("h")).alias("place"), "digest", "bytes")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < HEADS - 1)).select(F.col("conv_id").alias("base"), "rank", "digest", "bytes")
    heads = heads.join(convs.select("base", "conv_id", "h").hint("merge"), "base").filter("rank < h").select("conv_id", F.col("rank").alias("place"), "digest", "bytes")
    return later.unionByName(heads), convs.select("conv_id", "length")


def pages_of(turns: DataFrame, lengths: DataFrame, page: int) -> DataFrame:
    """A row for each page of each conversation: its turns' digests and bytes, the page's anchor (what the pages before spell) and the next one's."""
    entries = F.array_sort(F.collect_list(F.struct("place", "digest", "bytes")))
    own = turns.groupBy("conv_id", F.floor(F.col("place") / page).alias("page")).agg(entries.alias("e"))
    own = own.select("conv_id", "page", F.unhex(F.array_join("e.digest", "")).alias("key"), F.col("e.bytes").alias("sizes"))
    none = lengths.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("page"), F.lit(b"").alias("key"), F.array().cast("array<int>").alias("sizes"))
    whole = own.unionByName(none).join(lengths.hint("merge"), "conv_id").withColumn("more", F.col("length") > (F.col("page") + 1) * page)
    short = whole.filter(F.col("length") <= page).withColumns({"anchor": F.lit(""), "next_anchor": F.lit(None).cast("string")})
    # only long conversations have anchors to make
    w = Window.partitionBy("conv_id").orderBy("page")
    so_far = F.collect_list(F.md5("key")).over(w)
    spelt = F.md5(F.array_join(so_far, ""))
    long_ones = whole.filter(F.col("length") > page).withColumn("spelt", spelt)
    long_ones = long_ones.withColumns({"anchor": F.coalesce(F.lag("spelt").over(w), F.lit("")), "next_anchor": F.when(F.col("more"), F.col("spelt"))}).drop("spelt")
    return short.unionByName(long_ones).withColumn("ends", ~F.col("more"))


def prefix_trie(conversations: DataFrame, page: int = PAGE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turns come first; rows without conv_id belong to no conversation;
    repeated rows are turns of their own; an empty table gives no node; other columns aren't read.
    """
    turns, lengths = rebuilt(conversations)
    rows = saved(pages_of(turns, lengths, page), "conversation-pages")
    last, total = rows.agg(F.max("page"), F.sum(F.size("sizes"))).first()
    least = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, hung = [], None
    for k in range((last or 0), -1, -1):
        own = rows.filter(F.col("page") == k)
        if hung is None:
            own = own.withColumns({"below_leaves": F.lit(-1).cast("long"), "below_saved": F.lit(0).cast("long"), "below_children": F.lit(0).cast("long")})
        else:
            own = own.join(hung.hint("merge"), "next_anchor", "left").withColumns({"below_leaves": F.coalesce("below_leaves", F.lit(-1)), "below_saved": F.coalesce("below_saved", F.lit(0)), "below_children": F.coalesce("below_children", F.lit(0))})
        nodes = page_nodes(own, max(least, -(-(total or 0) // shard_turns)))
        roots = nodes.filter("depth = 0")
        hung = roots.select(F.col("anchor").alias("next_anchor"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"), F.col("n_children").alias("below_children"))
        out.append(nodes.withColumn("page", F.lit(k)))
    whole = out[-1]
    if len(out) > 1:
        later = out[0]
        for nodes in out[1:-1]:
            later = later.unionByName(nodes)
        # the root of a later page is the node at the end of the page before
        ends = whole
        for nodes in out[:-1]:
            ends = ends.unionByName(nodes)
        ends = ends.filter("next_anchor is not null").select(F.col("next_anchor").alias("anchor"), F.col("conv_id").alias("__above"))
        later = later.filter("depth > 0").join(ends.hint("merge"), "anchor", "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("__above")).otherwise(F.col("parent_conv_id")))
        whole = whole.unionByName(later.drop("__above"))
    depth = F.col("page") * F.lit(page).cast("long") + F.col("depth")
    return whole.select("conv_id", depth.alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
