"""From one document's extractions to its item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.functions.similarity import item_similarity, levenshtein_score, token_sorted, weighted_similarity
from pricemap.work import drop, written


def prefilter_lines(pages: DataFrame, least_repeats: int = 3, long_line: int = 150) -> DataFrame:
    """Texts (doc_id, text) without blank lines, long lines without a digit, and all but the first of lines that repeat."""
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw")).filter("line <> ''")
    lines = lines.filter((F.length("line") <= long_line) | F.col("line").rlike("[0-9]"))
    same = Window.partitionBy("doc_id", "line")
    marked = lines.withColumns({"n": F.count("*").over(same), "k": F.row_number().over(same.orderBy("pos"))})
    kept = marked.filter((F.length("line") <= 10) | (F.col("n") < least_repeats) | (F.col("k") == 1))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def document_kind(docs: DataFrame) -> DataFrame:
    """Text or scanned by the share of pages with text."""
    text = F.col("pages_with_text") >= F.greatest(F.lit(1), F.floor(F.col("pages") / 2))
    return docs.withColumn("kind", F.when(text, "pdf_texto").otherwise("pdf_escaneado"))


def structural_confidence(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Score from 0 to 100 of each document's extraction.

    ``docs``: file_id, found_table, found_columns, item_blocks.  The price format's ten points are
    constant, as formatted numbers always have it.
    """
    checkable = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("total_price").isNotNull()
    expected = F.col("unit_price") * F.col("quantity")
    right = checkable & (expected != 0) & (F.abs(F.col("total_price") - expected) / F.abs(expected) <= 0.05)
    own = items.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(checkable).alias("valid"), F.count_if(right).alias("right"))
    joined = docs.join(own, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows, blocks = F.col("n"), F.coalesce(F.col("item_blocks"), F.lit(0))
    lines = (rows > 0) & ((blocks == 0) | (F.least(rows, blocks) / F.greatest(rows, blocks) >= 0.6))
    sums = (rows > 0) & ((F.col("valid") == 0) | (F.try_divide(F.col("right"), F.col("valid")) >= 0.8))
    points = [(F.col("found_table"), 40), (F.col("found_columns"), 25), (lines, 15), (F.lit(True), 10), (sums, 10)]
    score = sum((F.when(F.coalesce(test, F.lit(False)), p).otherwise(0) for test, p in points), F.lit(0))
    return joined.withColumns({"n_items": rows.cast("long"), "confidence": score.cast("int")}).drop("n", "valid", "right")


def route_documents(docs: DataFrame, high: int = 85, low: int = 40) -> DataFrame:
    """Route of each document by confidence; a scanned one has ten points less."""
    score = F.greatest(F.col("confidence") - F.when(F.col("kind") == "scanned", 10).otherwise(0), F.lit(0))
    route = F.when(F.col("n_items") == 0, "alternate").when(score >= high, "structural").when(score < low, "alternate").otherwise("reconcile")
    return docs.withColumns({"effective_confidence": score.cast("int"), "route": route})


def first_nonempty_source(items: DataFrame) -> DataFrame:
    """Items of each file's first source that has any; ``rank`` orders the sources."""
    best = items.groupBy("file_id").agg(F.min("rank").alias("best"))
    return items.join(best.hint("merge"), "file_id").filter("rank = best").drop("best")


def attempts_usage(attempts: DataFrame) -> DataFrame:
    """(file_id, rank, n_attempts, n_items and summed tokens and cost) of each file: the source whose items are taken, and what all attempts used.

    ``attempts``: file_id, rank, n_items (null where the source failed), prompt_tokens, completion_tokens, cost, estimated.
    A file all of whose sources failed or were empty keeps its last one; a cost is estimated if any part is.
    """
    good = F.col("n_items") > 0
    taken = F.coalesce(F.min(F.when(good, F.col("rank"))), F.max("rank")).alias("rank")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost")]
    n_items = F.coalesce(F.min_by("n_items", F.when(good, F.col("rank"))), F.lit(0)).alias("n_items")
    return attempts.groupBy("file_id").agg(taken, F.count("*").alias("n_attempts"), n_items, *sums, F.coalesce(F.bool_or("estimated"), F.lit(False)).alias("estimated"))


def choose_extraction(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Items found in tables, or those found in lines where these are more."""
    n_tables = tables.groupBy("file_id").agg(F.count("*").alias("t"))
    n_lines = lines.groupBy("file_id").agg(F.count("*").alias("l"))
    winner = n_tables.join(n_lines, "file_id", "full_outer").select("file_id", (F.coalesce("l", F.lit(0)) > F.coalesce("t", F.lit(0))).alias("by_lines"))
    a = tables.join(winner.filter("not by_lines").select("file_id"), "file_id", "left_semi")
    return a.unionByName(lines.join(winner.filter("by_lines").select("file_id"), "file_id", "left_semi"), allowMissingColumns=True)


def document_supplier(alternate: Column, legal: Column, file_stem: Column) -> Column:
    """Name that the alternate source gives, else the legal name in the text, else the file's."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled(alternate), filled(legal), file_stem)


#: Items of both extractions of a document that one task pairs; the pairs of larger documents are taken in rounds.
LOCAL_ITEMS = 100


def _by_document(a: DataFrame, b: DataFrame, names: list[str], local: int) -> tuple[DataFrame, DataFrame]:
    """(file_id, a, b, taken) of each document of up to ``local`` items: either side's, and the pairs (the negative score, a_seq, b_seq) that are taken; the ids of larger documents.

    All pairs are gone through from the best one down, and taken where neither item is yet.
    """
    # words are sorted once an item, not once a pair
    item = F.struct(*names, token_sorted(F.col("description")).alias("words"))
    side = lambda df, c: df.filter("file_id is not null").select("file_id", item.alias(c))
    both = side(a, "a").unionByName(side(b, "b"), allowMissingColumns=True)
    large = written(both.groupBy("file_id").count().filter(F.col("count") > local).select("file_id"), "large-documents")
    small = both if large.isEmpty() else both.join(large.hint("merge"), "file_id", "left_anti")
    grouped = small.groupBy("file_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def scored(x: Column, y: Column) -> Column:
        score = weighted_similarity(x["item_no"], y["item_no"], levenshtein_score(x["words"], y["words"]), x["unit"], y["unit"], x["quantity"], y["quantity"])
        return F.struct((-F.round(score, 4)).alias("low"), x["seq"].alias("a_seq"), y["seq"].alias("b_seq"))

    pairs = F.sort_array(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: scored(x, y)))))
    used = lambda taken, p: F.exists(taken, lambda t: (t["a_seq"] == p["a_seq"]) | (t["b_seq"] == p["b_seq"]))
    taken = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda taken, p: F.when(used(taken, p), taken).otherwise(F.array_append(taken, p)))
    return grouped.withColumn("pairs", pairs).withColumn("taken", taken).drop("pairs"), large


def _of(df: DataFrame, documents: DataFrame) -> DataFrame:
    return df.join(documents.hint("merge"), "file_id", "left_semi")


def reconcile(a: DataFrame, b: DataFrame, local: int = LOCAL_ITEMS) -> DataFrame:
    """One-to-one pairs of two extractions of a document, greedy by similarity.

    A document of up to ``local`` items is one task's, a larger one goes in rounds.
    ``a`` and ``b``: file_id, seq, item_no, description, unit, quantity.
    """
    small, large = _by_document(a, b, ["seq", "item_no", "unit", "quantity"], local)
    taken = small.select("file_id", F.inline("taken")).select("file_id", "a_seq", "b_seq", (-F.col("low")).alias("score"))
    return taken if large.isEmpty() else taken.unionByName(_reconcile_by_rounds(_of(a, large), _of(b, large)).select(*taken.columns))


def _reconcile_by_rounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same in rounds: each takes all pairs that are the best of both their items."""
    left = a.select("file_id", *[F.col(c).alias(f"a_{c}") for c in ("seq", "item_no", "description", "unit", "quantity")])
    right = b.select("file_id", *[F.col(c).alias(f"b_{c}") for c in ("seq", "item_no", "description", "unit", "quantity")])
    pair = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    score = item_similarity(*pair("item_no"), *pair("description"), *pair("unit"), *pair("quantity"))
    scored = written(left.join(right.hint("merge"), "file_id").select("file_id", "a_seq", "b_seq", F.round(score, 4).alias("score")), "reconcile")
    taken, rounds = None, [scored]
    while True:
        of_a = scored.groupBy("file_id", "a_seq").agg(F.min(F.struct(-F.col("score"), "b_seq")).alias("p")).select("file_id", "a_seq", "p.b_seq")
        of_b = scored.groupBy("file_id", "b_seq").agg(F.min(F.struct(-F.col("score"), "a_seq")).alias("p")).select("file_id", "p.a_seq", "b_seq", (-F.col("p.col1")).alias("score"))
        best = written(of_a.join(of_b.hint("merge"), ["file_id", "a_seq", "b_seq"]), "reconcile-best")
        if best.isEmpty():
            drop(*rounds)
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        rest = scored.join(best.select("file_id", "a_seq").hint("merge"), ["file_id", "a_seq"], "left_anti").join(best.select("file_id", "b_seq").hint("merge"), ["file_id", "b_seq"], "left_anti")
        scored = written(rest, "reconcile")
        drop(rounds.pop())
        rounds.append(scored)


def reconciled(a: DataFrame, b: DataFrame, local: int = LOCAL_ITEMS) -> DataFrame:
    """Items of two extractions of a document: pairs merged, the rest of either side as it is (J5, G7); ``side`` tells whose ``seq`` it is."""
    names = ["seq", "description", "unit", "quantity", "unit_price"]
    small, large = _by_document(a, b, [*names, "item_no"], local)
    entry = lambda x, y, score, side: F.struct(x.alias("a"), y.alias("b"), score.cast("double").alias("score"), F.lit(side).alias("side"))
    of_pair = lambda x, t: F.transform(F.filter("b", lambda y: y["seq"] == t["b_seq"]), lambda y: entry(x, y, -t["low"], "a"))
    pairs = F.flatten(F.flatten(F.transform("a", lambda x: F.transform(F.filter("taken", lambda t: t["a_seq"] == x["seq"]), lambda t: of_pair(x, t)))))
    alone = lambda c, x: ~F.coalesce(F.exists("taken", lambda t: t[f"{c}_seq"] == x["seq"]), F.lit(False))
    rest = lambda c: F.transform(F.filter(c, lambda x: alone(c, x)), lambda x: entry(x, F.get(F.slice(c, 1, 0), F.lit(0)), F.lit(None), c))
    made = small.select("file_id", F.inline(F.concat(pairs, rest("a"), rest("b"))))
    side_of = lambda p: [F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in names]
    parts = [made.select("file_id", *side_of("a"), *side_of("b"), "score", "side")]
    # items of no document have no partner
    left, right = (df.select("file_id", *[F.col(c).alias(f"{p}_{c}") for c in names]) for df, p in ((a, "a"), (b, "b")))
    as_a = lambda df: df.withColumnsRenamed({f"b_{c}": f"a_{c}" for c in names})
    parts += [df.filter("file_id is null").withColumn("side", F.lit(p)) for df, p in ((left, "a"), (as_a(right), "b"))]
    if not large.isEmpty():
        left, right, taken = _of(left, large), _of(right, large), _reconcile_by_rounds(_of(a, large), _of(b, large))
        parts += [left.join(taken.hint("merge"), ["file_id", "a_seq"]).join(right.hint("merge"), ["file_id", "b_seq"]).withColumn("side", F.lit("a"))]
        parts += [left.join(taken.select("file_id", "a_seq").hint("merge"), ["file_id", "a_seq"], "left_anti").withColumn("side", F.lit("a"))]
        parts += [as_a(right.join(taken.select("file_id", "b_seq").hint("merge"), ["file_id", "b_seq"], "left_anti")).withColumn("side", F.lit("b"))]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return merge_pair(whole).withColumnRenamed("a_seq", "seq")


def merge_pair(pairs: DataFrame) -> DataFrame:
    """Reconciled items: a's values, the longer description, blanks from b, confidence and conflict.

    ``pairs`` has score and a_/b_ columns description, unit, quantity, unit_price; b's are null for unmatched items.
    """
    price_a, price_b = F.col("a_unit_price"), F.col("b_unit_price")
    gap = F.when((price_a == 0) & (price_b == 0), 0.0).otherwise(F.try_divide(F.abs(price_a - price_b), F.greatest(F.abs(price_a), F.abs(price_b))))
    alone = F.col("b_description").isNull()
    agrees = F.coalesce(gap < 0.01, price_a.isNull() & price_b.isNull())
    longer = F.length(F.coalesce("b_description", F.lit(""))) > F.length(F.coalesce("a_description", F.lit("")))
    return pairs.select(
        "file_id", "a_seq", *[c for c in ("side",) if c in pairs.columns],
        F.when(longer, F.col("b_description")).otherwise(F.col("a_description")).alias("description"),
        F.coalesce("a_unit", "b_unit").alias("unit"), F.coalesce("a_quantity", "b_quantity").alias("quantity"), F.coalesce(price_a, price_b).alias("unit_price"),
        F.when(alone, "média").when((F.col("score") >= 70) & agrees, "alta").otherwise("baixa").alias("item_confidence"),
        (alone | (F.col("score") < 70) | ~agrees).alias("conflict"),
    )


def item_page(items: DataFrame, pages: DataFrame) -> DataFrame:
    """First page of the file that names the item's number or the start of its description, else 1."""
    start = F.lower(F.substring("description", 1, 40))
    joined = items.join(pages.select("file_id", "page", F.lower("text").alias("page_text")), "file_id", "left")
    numbered = F.col("item_no").isNotNull() & F.array_contains(F.split("page_text", r"[^\p{L}\p{N}_]+"), F.lower("item_no"))
    hit = numbered | ((start != "") & F.col("page_text").contains(start))
    return joined.groupBy("file_id", "seq").agg(F.coalesce(F.min(F.when(hit, F.col("page"))), F.lit(1)).alias("page"))
