"""Merkle manifest, document fingerprints and prefix trie against plain versions, with the hard rows in one table."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pricemap.llm import fingerprints, langid, merkle, trie

LONG = " ".join(f"word{k % 700}" for k in range(30_000))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, salt int, key string, rank int"
TEXTS = [None, "", " \n ", "one", "Two words", "a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i k", LONG, "é ½ 😀 x\x00y", LONG + " end"]
ROWS = [(k * 7 - 3, t, [None, "en", "fr", "é"][k % 4], [None, "s"][k % 2], [None, 5, 2**63 - 1][k % 3], "x", "x", 1, "x", 1) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5], (ROWS[5][0], "another text of one id", "fr", "s", 9, None, None, None, None, None), (None, "no id", "en", None, 5, None, None, None, None, None)]
ROWS += [(1000 + k, f"text {k} of many in one language", "de", "s", k, None, None, None, None, None) for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# -- Merkle manifest -----------------------------------------------------------------------------------


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    field = lambda v: b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode())
    return hashlib.sha256(b"".join(field(v) for v in (doc_id, source, lang, n_chars, text))).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_proofs(rows):
    own = sorted((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(*r[:5]), r) for r in rows)
    groups = [[x[4:] for x in g] for _, g in itertools.groupby(own, key=lambda x: x[:2])]
    trees = [plain_tree([leaf for leaf, _ in g]) for g in groups]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(groups):
        for p, (leaf, (doc_id, text, lang, source, n_chars, *_)) in enumerate(g):
            hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            h, siblings = plain_leaf(doc_id, text, lang, source, n_chars + hit) if hit else leaf, []
            for levels, at in ((trees[k], p), (top, k)):
                for nodes in levels[:-1]:
                    other = nodes[at ^ 1 : (at ^ 1) + 1]
                    h = joined(other + [h] if at & 1 else [h] + other)
                    siblings += other
                    at >>= 1
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], joined(siblings), h, h == top[-1][0]))
    return out


def test_merkle_proofs_against_plain_trees(docs, nothing, monkeypatch):
    # packs of two levels, so that there are several tiers
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SPAN", 4)
    got = [tuple(r) for r in merkle.proofs(merkle.manifest(docs)).drop("siblings").collect()]
    assert sorted(got, key=str) == sorted(plain_proofs(ROWS), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_and_empty_tables(docs, nothing):
    assert merkle.proofs(merkle.manifest(nothing)).collect() == []
    one = docs.filter("doc_id = 4")
    got = [tuple(r) for r in merkle.proofs(merkle.manifest(one)).drop("siblings").collect()]
    assert got == plain_proofs([r for r in ROWS if r[0] == 4])


@given(st.lists(st.sampled_from([joined([str(k)]) for k in range(6)]), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_merkle_descent_meets_what_the_fold_left_aside(leaves):
    levels = merkle.levels_of(len(leaves))
    root, records = merkle.folded(leaves, levels)
    assert root == plain_tree(leaves)[-1][0]
    for k, leaf in enumerate(leaves):
        found, path = merkle.turns(root, records, k, levels)
        assert found == leaf and merkle.fold(leaf, path[::-1]) == root


# -- document fingerprints -----------------------------------------------------------------------------


def test_fingerprints_against_edited_texts(docs, nothing):
    got = fingerprints.document_fingerprints(docs).collect()
    assert len(got) == len(ROWS) and fingerprints.document_fingerprints(nothing).collect() == []
    ids = sorted({r[0] for r in ROWS if r[0] is not None}, reverse=True) + [None]
    of_id = defaultdict(set)
    for r in ROWS:
        of_id[r[0]].add(r[1] or "")
    shown = {r[1] or "" for r in ROWS}
    allowed = defaultdict(set)  # a doc_id of several texts lends any one of them
    for k, i in enumerate(ids):
        for t in of_id[i]:
            n = len(t) // 3
            for other in of_id[ids[(k + 1) % len(ids)]]:
                allowed[(i, len(t))].add(hashlib.sha256((t[: len(t) - n] + other[:n]).encode()).hexdigest())
    assert all(r["edited_sha256"] in allowed[(r["doc_id"], r["n_chars"])] for r in got)
    assert {(r["doc_id"], r["n_chars"]) for r in got} == {(r[0], len(r[1] or "")) for r in ROWS}
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] != ROWS[5][0]}
    assert prints[ROWS[0][0]] == prints[ROWS[1][0]] == prints[ROWS[2][0]] == "0" * 16  # null, empty, only white space
    assert len(shown) >= len({r["fingerprint"] for r in got})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = next(r["fingerprint"] for r in got if r["n_chars"] == 19 and r["doc_id"] == ROWS[6][0])
    assert any(r["fingerprint"] == same for r in got if r["doc_id"] == ROWS[5][0])  # equal texts
    values = [int(r["fingerprint"], 16) for r in got]
    for r in got:
        asks = r["doc_id"] is not None and r["doc_id"] % 50 == 0
        assert r["n_within"] == (sum((int(r["fingerprint"], 16) ^ v).bit_count() <= fingerprints.RADIUS for v in values) if asks else None)


def test_fingerprint_bits_are_the_weighted_votes(spark):
    text = "The quick brown fox, the quick brown dog and a extraordinarily long word"
    got = fingerprints.fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()["fp"] & (2**64 - 1)
    words = text.lower().split()
    pairs = list(zip(words, words[1:] + [None]))
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    votes = np.zeros(64, dtype=int)
    for (a, b), (h,) in zip(pairs, df.selectExpr("xxhash64(a, b)").collect()):
        weight = min(4, 1 + (len(a) + len(b or "")) // 6)
        votes += weight * np.array([1 if h >> k & 1 else -1 for k in range(64)])
    assert got == sum(1 << k for k in range(64) if votes[k] > 0)


@pytest.mark.parametrize("radius,blocks", [(3, 5), (2, 4), (1, 3)])
def test_block_tables_find_every_near_fingerprint_once(spark, radius, blocks):
    rng = random.Random(radius)
    values = {0, 2**64 - 1, 1 << 63}
    for _ in range(25):
        v = rng.getrandbits(64)
        values |= {v} | {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(6)}
    values = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [tuple(r) for r in fingerprints.within_radius(df, df, radius, blocks).collect()]
    mask = (1 << 64) - 1
    assert sorted(got) == sorted((a, b) for a in values for b in values if ((a ^ b) & mask).bit_count() <= radius)


# -- prefix trie ---------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    built = {c: tuple(own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + turns[h:]) for c, turns in own.items()}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def conversations():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "éé", "", None])) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(7, None, "u", "first"), (7, 0, "u", "tie"), (7, 0, "u", "tie"), (None, 1, "u", "no conversation")]
    rows += [(c, t, "u", "long " * 50) for c, n in ((101, 40), (102, 44), (103, 40)) for t in range(n)]
    return rows + [(200 + c, t, "u", f"turn {t}") for c in range(25) for t in range(12)]


CONVERSATION_SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(conversations(), CONVERSATION_SCHEMA).selectExpr("*", "'x' as key", "1 as page", "'y' as anchor").repartition(3)


@pytest.mark.parametrize("page,shard_turns", [(trie.PAGE, trie.SHARD_TURNS), (13, 60)])
def test_trie_against_plain_prefixes(chats, page, shard_turns):
    got = [tuple(r) for r in trie.prefix_trie(chats, page, shard_turns).collect()]
    assert sorted(got) == plain_trie(conversations())


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATION_SCHEMA)).collect() == []


@given(st.lists(st.integers(0, 3), min_size=1, max_size=400), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_find_close_in_random_parentheses(moves, deep):
    bits, open_now = [], 0
    for m in moves:
        if m <= deep or not open_now:
            bits.append(1)
            open_now += 1
        else:
            bits.append(0)
            open_now -= 1
    bits += [0] * open_now
    stack, close = [], {}
    for k, b in enumerate(bits):
        if b:
            stack.append(k)
        else:
            close[stack.pop()] = k
    excess = np.cumsum(2 * np.array(bits) - 1)
    opens = np.flatnonzero(np.array(bits))
    assert trie.find_close(excess, opens).tolist() == [close[k] for k in opens.tolist()]


# -- language models without the row itself ------------------------------------------------------------


def test_a_row_is_judged_without_its_own_text(spark):
    rng = random.Random(8)
    words = {"aa": ["casa", "perro", "grande", "cielo", "verde"], "bb": ["haus", "grün", "himmel", "schnell", "buch"]}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(40))
    rows = [(k, text(x), x) for k, x in enumerate(["aa", "bb"] * 20)]
    alone = (100, "zzyx qwvj xqzw jvqk " * 30, "aa")  # like nothing else
    swapped = (101, text("aa"), "bb")
    df = spark.createDataFrame([*rows, alone, swapped], "doc_id long, text string, lang string")
    shares = langid.language_shares(df)
    model = langid.train_text_model(df, list(shares))
    assert model.likelihood(alone[1])[1].argmax() == 0
    fresh = langid.train_text_model(df.filter("doc_id <> 100"), list(shares))
    assert np.allclose(model.likelihood(alone[1], "aa")[1][0], fresh.likelihood(alone[1])[1][0], rtol=1e-4)
    assert model.likelihood(swapped[1], "bb")[1].argmax() == 0  # told by its text, not by its label
    got = langid.keep_identified(df.withColumn("source", F.lit("s")), languages=["bb"])
    assert {r.doc_id for r in got.collect()} == {k for k, _, x in rows if x == "bb"}
