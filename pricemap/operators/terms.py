"""Approximate look-up of words in a list of terms, by what is left of both after deletions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemap.functions.similarity import matcher_ratio_of

#: Entries of an index that are sent to all tasks; a larger one is joined by shuffle.
BROADCAST_ENTRIES = 200_000


def _most_deleted(n: int, others: set[int], least: float) -> int:
    """How many letters a word of ``n`` may lose, where words of ``n`` and of a length in ``others`` reach ``least``; -1 if none does.

    A ratio of 2 M / (a + b) >= least leaves at most (1 - least) (a + b) letters without a partner on both sides.
    """
    best = -1
    for b in others:
        both = (int((1 - least) * (n + b) + 1e-9) - (n - b)) // 2
        if both >= 0 and n - b + both >= 0:
            best = max(best, n - b + both)
    return best


def _one_less(words: Column) -> Column:
    """Every word of the array without one of its letters."""
    without = lambda w, k: F.concat(F.substring(w, F.lit(1), k), F.substring(w, k + 2, F.length(w)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda k: without(w, k)))))


def near_terms(tokens: DataFrame, terms: list[str], least: float) -> DataFrame:
    """(token, term, ratio) of all pairs whose matcher ratio (0 to 1) is ``least`` or more.

    Both sides are filed under what they leave after deletions; words that can reach ``least`` meet at a
    common remainder, and only those that meet get a ratio.  ``tokens``: token; null and empty ones meet nothing.
    """
    spark = tokens.sparkSession
    lengths = {len(t) for t in terms}
    reach = int(max(lengths) * (2 / least - 1) + 1e-9)
    most = {n: k for n in range(1, reach + 1) if (k := _most_deleted(n, lengths, least)) >= 0}
    entries = set()
    for t in set(terms):
        for d in range(_most_deleted(len(t), set(most), least) + 1):
            entries |= {("".join(c for k, c in enumerate(t) if k not in gone), t) for gone in combinations(range(len(t)), d)}
    index = spark.createDataFrame(sorted(entries), "rest string, term string")
    index = index.hint("broadcast" if len(entries) <= BROADCAST_ENTRIES else "shuffle_hash")
    own = tokens.select("token").filter("token <> ''").distinct().withColumn("n", F.length("token"))
    level, rests = own.filter(F.col("n").isin(list(most))).withColumn("rests", F.array("token")), None
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("n"))
    for d in range(max(most.values()) + 1):
        if d:
            level = level.filter(allowed >= d).withColumn("rests", _one_less(F.col("rests")))
        step = level.select("token", F.explode("rests").alias("rest"))
        rests = step if rests is None else rests.unionByName(step)
    met = rests.join(index, "rest").select("token", "term").distinct()
    scored = met.withColumn("ratio", matcher_ratio_of(F.col("token"), F.col("term")) / 100)
    return scored.filter(F.col("ratio") >= least)


def best_term(tokens: DataFrame, terms: list[str], least: float) -> DataFrame:
    """(token, term, ratio) of the best of the terms that reach ``least``, the first by name on ties."""
    return near_terms(tokens, terms, least).groupBy("token").agg(F.max("ratio").alias("ratio"), F.min_by("term", F.struct(-F.col("ratio"), "term")).alias("term"))
