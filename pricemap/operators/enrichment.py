"""Contact data and item fields that other documents fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.functions.contacts import PHONE, TAX_ID_STRICT, format_tax_id, digits, name_tokens, normalize_name, phone_valid, strong_phone, strong_tax_id, tax_id_valid
from pricemap.functions.normalize import unit_and_quantity
from pricemap.work import spread, written


def filled(col: Column) -> Column:
    """The text, null where it is blank."""
    return F.when(F.trim(F.coalesce(col, F.lit(""))) != "", F.trim(col))


#: Characters of the pieces over which a text meets those that contain it; shorter texts meet as they are.
GRAM = 8


def containing(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """Different pairs (whole, part) of the two tables' texts, where ``whole`` contains ``part`` anywhere; blank parts have none.

    A part meets the texts that hold its rarest piece; a piece that no text holds rules it out.  Pieces go by
    a hash, as the texts are compared where they meet.
    """
    wholes, parts = spread(wholes.select("whole"), "whole").distinct(), spread(parts.select("part").filter("part <> ''"), "part").distinct()
    lengths = [r[0] for r in parts.select(F.least(F.length("part"), F.lit(GRAM))).distinct().collect()] or [GRAM]

    def pieces(text: str, n) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.xxhash64(F.substr(text, k, n)))).otherwise(F.array().cast("array<long>"))

    held = wholes.select("whole", F.explode(F.array_distinct(F.concat(*[pieces("whole", F.lit(n)) for n in lengths]))).alias("piece"))
    own = parts.withColumn("pieces", F.array_distinct(pieces("part", F.least(F.length("part"), F.lit(GRAM)))))
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    met = own.select("part", F.size("pieces").alias("all"), F.explode("pieces").alias("piece")).join(counts.hint("merge"), "piece")
    # of plain values, which need no sort
    rarest = met.groupBy("part", "all").agg(F.count("*").alias("found"), F.min_by("piece", "n").alias("piece")).filter("found = all")
    return rarest.select("part", "piece").join(held.hint("merge"), "piece").filter(F.col("whole").contains(F.col("part"))).select("whole", "part")


def name_match(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of ids whose names (column ``name``) are likely the same company.

    One name contains the other, or 60 % of either's words are common, or two words are.  With one common
    word, 60 % takes a name of one word: names meet over two words, the only word, or a part of the
    name.  A name without a word of its own is only contained at the edges of words.
    """

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        own = spread(df.select(key, "name")).select(key, normalize_name(F.col("name")).alias(f"{p}n"), F.array_sort(name_tokens(F.col("name"))).alias(f"{p}t"))
        # written, as every way to meet reads the names
        return written(own, "names").filter(F.col(f"{p}n") != "")

    own_a, own_b = side(a, a_id, "a"), side(b, b_id, "b")
    # equal names have equal words
    names_a, names_b = (written(spread(own.select(f"{p}n", f"{p}t"), f"{p}n").dropDuplicates([f"{p}n"]), "different-names") for own, p in ((own_a, "a"), (own_b, "b")))

    def words(names: DataFrame, p: str, which: str) -> DataFrame:
        return names.filter(F.size(f"{p}t") > 1 if which == "several" else F.size(f"{p}t") == 1 if which == "one" else F.lit(True)).select(f"{p}n", F.explode(f"{p}t").alias("t"))

    def two_words(names: DataFrame, p: str) -> DataFrame:
        return names.select(f"{p}n", F.posexplode(f"{p}t").alias("k", "w"), f"{p}t").select(f"{p}n", "w", F.explode(F.slice(f"{p}t", F.col("k") + 2, F.greatest(F.size(f"{p}t"), F.lit(1)))).alias("t"))

    met = two_words(names_a, "a").join(two_words(names_b, "b").hint("merge"), ["w", "t"]).select("an", "bn")
    met = met.unionByName(words(names_a, "a", "one").join(words(names_b, "b", "all").hint("merge"), "t").select("an", "bn"))
    met = met.unionByName(words(names_a, "a", "several").join(words(names_b, "b", "one").hint("merge"), "t").select("an", "bn"))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    whole_words = (F.size(name_tokens(F.col("part"))) > 0) | padded("whole").contains(padded("part"))
    for wholes, parts in (("an", "bn"), ("bn", "an")):
        source = {"an": names_a, "bn": names_b}
        inside = containing(source[wholes].select(F.col(wholes).alias("whole")), source[parts].select(F.col(parts).alias("part"))).filter(whole_words)
        met = met.unionByName(inside.select(F.col("whole").alias(wholes), F.col("part").alias(parts)).select("an", "bn"))
    words_of = lambda names, p: names.select(f"{p}n", f"{p}t").hint("merge")
    met = met.distinct().join(words_of(names_a, "a"), "an").join(words_of(names_b, "b"), "bn").select("an", "bn", F.size(F.array_intersect("at", "bt")).alias("n_common"))
    met = met.join(own_a.select(a_id, "an").hint("merge"), "an").join(own_b.select(b_id, "bn").hint("merge"), "bn")
    return met.select(a_id, b_id, "n_common").dropDuplicates([a_id, b_id])


def backfill_contacts_from_mail(suppliers: DataFrame, messages: DataFrame) -> DataFrame:
    """Suppliers (email, tax_id, phone) with missing data from their newest message that has any."""
    lacking = suppliers.filter(filled(F.col("tax_id")).isNull() | filled(F.col("phone")).isNull())
    wanted = messages.select(F.lower("from_email").alias("__email"), "ingest_seq", "body").join(lacking.select(F.lower("email").alias("__email")).distinct().hint("merge"), "__email", "left_semi")
    # written, or the filter would be planned on the patterns again
    own = written(wanted.select("__email", "ingest_seq", strong_tax_id(F.col("body")).alias("t"), strong_phone(F.col("body")).alias("p")), "contacts-found")
    newest = own.filter("t is not null or p is not null").groupBy("__email").agg(F.max_by(F.struct("t", "p"), "ingest_seq").alias("c"))
    joined = suppliers.join(newest, F.lower("email") == F.col("__email"), "left")
    return joined.withColumns({"tax_id": F.coalesce(filled(F.col("tax_id")), "c.t"), "phone": F.coalesce(filled(F.col("phone")), "c.p")}).drop("__email", "c")


def enrich_contacts(links: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Contact of each linked file: the cached one if valid, else the pages' text; and whether an outside lookup is due."""
    text = pages.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("__text"))
    joined = links.join(documents.select("file_id", F.col("tax_id").alias("__t"), F.col("phone").alias("__p")), "file_id", "left").join(text, "file_id", "left")
    tax = F.coalesce(F.when(tax_id_valid(F.col("__t")), format_tax_id(digits(F.col("__t")))), strong_tax_id(F.col("__text")))
    phone = F.coalesce(F.when(phone_valid(F.col("__p")), F.col("__p")), strong_phone(F.col("__text")))
    several = lambda pattern: F.size(F.array_distinct(F.transform(F.coalesce(F.regexp_extract_all("__text", F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>")), digits))) > 1
    out = joined.withColumns({"tax_id": tax, "phone": phone, "needs_lookup": several(TAX_ID_STRICT) | several(PHONE)})
    return out.withColumn("needs_lookup", F.col("needs_lookup") | (F.col("tax_id").isNull() & F.col("phone").isNull())).drop("__t", "__p", "__text")


def match_members(links: DataFrame, files: DataFrame) -> DataFrame:
    """Archive member of each linked file name: the same or a suffix of one another, else one inside the other; the first.

    File names are base names in lower case; a blank one has no member.
    """
    base = lambda name: F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
    a, b = links.withColumn("__a", base("file_name")), files.select("seq", "name", base("name").alias("__b"))
    inside = containing(a.select(F.col("__a").alias("whole")), b.select(F.col("__b").alias("part"))).select(F.col("whole").alias("__a"), F.col("part").alias("__b"))
    around = containing(b.select(F.col("__b").alias("whole")), a.select(F.col("__a").alias("part"))).select(F.col("part").alias("__a"), F.col("whole").alias("__b"))
    met = a.join(inside.union(around).distinct().hint("merge"), "__a").join(b.hint("merge"), "__b")
    rank = F.when(F.col("__a").endswith(F.col("__b")) | F.col("__b").endswith(F.col("__a")), 0).when(F.col("__a").contains(F.col("__b")) | F.col("__b").contains(F.col("__a")), 1)
    best = met.withColumn("__rank", rank).filter("__rank is not null").groupBy("file_id").agg(F.min(F.struct("__rank", "seq", "name")).alias("m"))
    return links.join(best.select("file_id", F.col("m.name").alias("member")), "file_id", "left")


def propose_contact_updates(suppliers: DataFrame, contacts: DataFrame) -> DataFrame:
    """What name matching would fill in, without writing it (J19): supplier id, field, value.

    ``suppliers``: supplier_id, name, tax_id, phone; ``contacts``: contact_id, name, tax_id, phone.
    """
    pairs = name_match(suppliers, contacts, "supplier_id", "contact_id")
    joined = pairs.join(suppliers.select("supplier_id", "tax_id", "phone"), "supplier_id").join(contacts.select("contact_id", F.col("tax_id").alias("new_tax_id"), F.col("phone").alias("new_phone")), "contact_id")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.when(filled(F.col(f)).isNull(), filled(F.col(f"new_{f}"))).alias("value")) for f in ("tax_id", "phone")])
    return joined.select("supplier_id", "contact_id", F.explode(fields).alias("u")).select("supplier_id", "contact_id", "u.*").filter("value is not null")


def candidate_lines(items: DataFrame, lines: DataFrame, best: int = 5) -> DataFrame:
    """Each item's lines of most common words, five at most, each with the lines after and before it (K2).

    ``lines``: file_id, pos, text, and others that the result keeps.  A line that names the item's number counts five, each of the first
    six words of four letters or more of the description one.
    """
    words = F.slice(F.filter(F.regexp_extract_all(F.lower("description"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= 4), 1, 6)
    # a text is cut once, not for each item that meets it; an item without words or number has no line
    own = items.select("file_id", "seq", "item_no", words.alias("words")).filter(F.col("item_no").isNotNull() | (F.size("words") > 0))
    cut = lines.select("file_id", "pos", "text", F.lower("text").alias("low"), F.split("text", r"[^\p{L}\p{N}_]+").alias("parts"))
    joined = own.join(cut.hint("merge"), "file_id")
    numbered = F.when(F.col("item_no").isNotNull() & F.array_contains("parts", F.col("item_no")), 5).otherwise(0)
    score = numbered + F.size(F.filter("words", lambda w: F.col("low").contains(w)))
    order = Window.partitionBy("file_id", "seq").orderBy(F.desc("score"), F.desc("pos"), F.desc("text"))
    top = joined.select("file_id", "seq", "pos", "text", score.alias("score")).filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    near = top.select("file_id", "seq", F.posexplode(F.array(F.col("pos"), F.col("pos") + 1, F.col("pos") - 1)).alias("k", "pos"), "rank")
    first = near.groupBy("file_id", "seq", "pos").agg(F.min(F.col("rank") * 3 + F.col("k")).alias("place"))
    return first.join(lines.hint("merge"), ["file_id", "pos"]).drop("pos")


def fill_from_lines(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items with a missing unit or quantity filled from their best line that has both."""
    missing = items.filter("unit is null or quantity is null")
    unit, quantity = unit_and_quantity(F.col("text"))
    # written, as a line is a candidate of many items and the filter would be planned on the patterns again
    measured = written(spread(lines).select("file_id", "pos", "text", unit.alias("u"), quantity.alias("q")), "measured-lines")
    found = candidate_lines(missing, measured).filter("u is not null and q is not null")
    best = found.groupBy("file_id", "seq").agg(F.min_by(F.struct("u", "q"), "place").alias("f"))
    joined = items.join(best, ["file_id", "seq"], "left")
    return joined.withColumns({"unit": F.coalesce("unit", "f.u"), "quantity": F.coalesce("quantity", "f.q")}).drop("f")
