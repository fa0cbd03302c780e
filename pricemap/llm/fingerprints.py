"""Document fingerprints: weighted terms vote on 64 signed bits, and permuted block tables find what is near.

Everything here is DataFrame functions.  A term is two neighbouring words, its weight grows with its length
and its occurrences add up.  A fingerprint's bit is 1 where the weights for it outweigh those against it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.order import numbered
from pricemap.llm.store import saved

BITS, LANES = 64, 32
SEEDS = (11, 29)
#: Fingerprints differ in at most RADIUS bits to be near; they are cut into BLOCKS blocks, of which BLOCKS - RADIUS then agree.
RADIUS, BLOCKS = 3, 5
#: Ids divisible by this are searched for.
EVERY = 50
#: Parts that the rows of one doc_id are dealt to.
SALTS = 16


def terms(text: Column) -> Column:
    """The lower-cased words of ``text``."""
    return F.array_remove(F.split(F.lower(text), r"[ \t-\r]+"), "")


def weighted(words: Column) -> Column:
    """Every pair of neighbouring words (the last word also alone): its hash and weight, 1 to 4 by its bytes."""
    size = lambda w: F.coalesce(F.octet_length(w), F.lit(0))
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), F.least(F.lit(4), F.lit(1) + F.floor((size(a) + size(b)) / 6)).cast("long").alias("weight"))
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), pair)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, fp) per different ``key`` of ``texts``; rows of one key have one text.

    A text's votes are two counters to a long: bits k and k + 32 of a hash, shifted down and masked, are
    added to 32 sums, in the memory of the map side.  A text without words has fingerprint zero.
    """
    words = texts.select(*key, terms(F.col(text)).alias("words"))
    votes = words.select(*key, F.inline_outer(weighted(F.col("words"))))
    mask = F.lit((1 << 32) + 1)
    lanes = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(mask) * F.col("weight")).alias(f"lane{k}") for k in range(LANES)]
    sums = votes.groupBy(*key).agg(F.sum("weight").alias("total"), *lanes)
    low = lambda k: F.col(f"lane{k}").bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda k: F.shiftrightunsigned(f"lane{k}", 32)
    bit = lambda count, k: F.when(2 * count > F.col("total"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
    bits = [bit(low(k), k) for k in range(LANES)] + [bit(high(k), k + LANES) for k in range(LANES)]
    return sums.select(*key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of bits in which two fingerprints agree."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


# -- search ------------------------------------------------------------------------------------------


def _masks(blocks: int) -> list[int]:
    """The bits of each block, as signed longs."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    whole = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in whole]


def within_radius(asked: DataFrame, held: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(asked, held) of all fingerprints ``fp`` of the two tables at distance ``radius`` or less, each pair once.

    Near fingerprints agree in at least blocks - radius blocks.  There is a table for each choice of so
    many: it has those blocks in front, and is looked up by them.  A pair counts in the table of
    the first blocks in which it agrees.  More blocks make longer keys and more tables.
    """
    masks = _masks(blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    front = lambda fp: F.array(*[F.struct(F.lit(k).alias("place"), fp.bitwiseAND(F.lit(sum(masks[b] for b in t))).alias("front")) for k, t in enumerate(tables)])
    look = asked.select(F.col("fp").alias("asked"), F.inline(front(F.col("fp"))))
    file = held.select(F.col("fp").alias("held"), F.inline(front(F.col("fp"))))
    apart = F.col("asked").bitwiseXOR(F.col("held"))
    # blocks before the last one of the table that aren't its own must differ, or an earlier table has the pair
    first = F.lit(False)
    for k, t in enumerate(tables):
        own = F.col("place") == k
        for b in range(t[-1]):
            if b not in t:
                own = own & (apart.bitwiseAND(F.lit(masks[b])) != 0)
        first = first | own
    met = look.join(file.hint("shuffle_hash"), (look["place"] == file["place"]) & (look["front"] == file["front"]) & (F.bit_count(apart) <= radius)).select(look["place"].alias("place"), "asked", "held")
    return met.filter(first).select("asked", "held")


# -- the edited text ---------------------------------------------------------------------------------


def followed(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, first: what is known of it) with that of the next doc_id, in descending order and round: ``next``.

    Ids are sorted in ranges; a range's last id goes on with the first of the next range that has any.
    """
    table = numbered(ids.withColumn("__one", F.lit(0)), "__one", [F.col("doc_id").desc_nulls_last()])
    here = Window.partitionBy("__part").orderBy("__pos")
    # one row a range
    heads = table.filter("__pos = 0").select("__part", F.struct("doc_id", "first").alias("head"))
    order = Window.orderBy("__part")
    heads = heads.withColumn("head", F.coalesce(F.lead("head").over(order), F.first("head").over(order)))
    within = table.withColumn("__next", F.lead(F.struct("doc_id", "first")).over(here))
    joined = within.join(heads.hint("merge"), "__part")
    return joined.select("doc_id", "first", F.coalesce("__next", "head").alias("next"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    The edited text has its last third replaced by the beginning of the next document, in descending order
    of doc_id and round; of rows that share a doc_id, the one of the least digest is who others' next is, and
    they have the next one in common; a null doc_id comes last.  n_within counts the documents whose fingerprint is
    within ``radius`` bits, for doc_ids that divide by 50 (else null).  Null texts are empty; texts
    without words have fingerprint zero; an empty table gives none; other columns aren't read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # a text is told by two hashes
    whole = whole.withColumns({f"d{k}": F.xxhash64(F.lit(s), "text") for k, s in enumerate(SEEDS)})
    digest = ["d0", "d1"]
    index = saved(whole.select("doc_id", *digest, F.length("text").alias("n_chars")), "document-digests")
    prints = saved(fingerprints(whole, digest), "document-prints")

    # who asks whom for how many characters; a doc_id of many rows asks once for each salt
    salted = index.withColumn("salt", F.pmod("d0", F.lit(SALTS)).cast("int"))
    order = saved(followed(index.groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("first"))), "document-order")
    askers = salted.groupBy("doc_id", "salt").agg(F.max(F.floor(F.col("n_chars") / 3)).cast("int").alias("k"))
    asks = askers.join(order.hint("merge"), _same(askers, order, "doc_id")).select(askers["doc_id"].alias("for_id"), askers["salt"].alias("for_salt"), "k", F.col("next.doc_id").alias("doc_id"), F.col("next.first.d0").alias("d0"), F.col("next.first.d1").alias("d1"))
    asks = saved(asks.withColumn("salt", F.pmod("d0", F.lit(SALTS)).cast("int")), "document-asks")

    # Whole texts are shuffled once, by one key for both joins; what is asked for is shuffled once more.  The rest
    # is compared as no key of a join, or each join would deal the texts by its own.
    key = lambda i, salt: F.xxhash64(F.coalesce(i, F.lit(0)), F.col(i).isNull(), salt).alias("key")
    alike = lambda a, b: a.bitwiseXOR(b) == 0
    same_id = lambda a, b: alike(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))) & alike(a.isNull().cast("int"), b.isNull().cast("int"))
    dealt = whole.withColumn("salt", F.pmod("d0", F.lit(SALTS)).cast("int"))
    dealt = dealt.withColumn("key", key("doc_id", "salt")).repartition("key")
    asking = asks.withColumn("key", key("doc_id", "salt")).hint("shuffle_hash")
    same_text = reduce(lambda x, y: x & y, [alike(dealt[c], asking[c]) for c in ("salt", *digest)])
    met = dealt.join(asking, (dealt["key"] == asking["key"]) & same_id(dealt["doc_id"], asking["doc_id"]) & same_text)
    # rows may repeat: one of them answers
    given = met.select("for_id", "for_salt", F.expr("substring(text, 1, k)").alias("piece")).withColumn("key", key("for_id", "for_salt"))
    given = given.repartition("key").dropDuplicates(["key", "for_id", "for_salt"]).hint("shuffle_hash")
    paired = dealt.join(given, (dealt["key"] == given["key"]) & same_id(dealt["doc_id"], given["for_id"]) & alike(dealt["salt"], given["for_salt"]))
    n = F.length("text")
    k = F.floor(n / 3)
    edited = F.concat(F.substring("text", F.lit(1), (n - k).cast("int")), F.substring("piece", F.lit(1), k.cast("int")))
    changed = paired.select(dealt["doc_id"].alias("doc_id"), *digest, edited.alias("text"))
    # the digest of the edited text goes along as four longs
    sha = F.sha2("text", 256)
    longs = {f"s{j}": F.conv(F.substring(sha, 16 * j + 1, 16), 16, -10).cast("long") for j in range(4)}
    changed = changed.withColumns(longs)
    edited_prints = saved(fingerprints(changed, ["doc_id", *digest, *longs]), "edited-prints")

    # narrow rows from here on
    hexed = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in longs])
    edited_prints = edited_prints.select("doc_id", *digest, hexed.alias("edited_sha256"), F.col("fp").alias("edited_fp"))
    next_print = order.select("doc_id", F.col("next.first.d0").alias("d0"), F.col("next.first.d1").alias("d1")).join(prints.hint("merge"), digest).select("doc_id", F.col("fp").alias("next_fp"))
    rows = index.join(prints.hint("merge"), digest)
    rows = rows.join(edited_prints.hint("merge"), _same(rows, edited_prints, "doc_id", *digest)).select(rows["*"], "edited_sha256", "edited_fp")
    rows = rows.join(next_print.hint("merge"), _same(rows, next_print, "doc_id")).select(rows["*"], "next_fp")
    counts = saved(index.join(prints.hint("merge"), digest).groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))).alias("asks")), "different-prints")
    found = within_radius(counts.filter("asks"), counts, radius, blocks)
    near = found.join(counts.hint("merge"), found["held"] == counts["fp"]).groupBy("asked").agg(F.sum("n").alias("n_within"))
    asks_too = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    asking_rows = rows.filter(asks_too).join(near.hint("merge"), F.col("fp") == F.col("asked")).drop("asked")
    rows = asking_rows.unionByName(rows.filter(~asks_too).withColumn("n_within", F.lit(None).cast("long")))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
