"""Approximate terms, as-of joins, run counters and report figures against plain loops."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pricemap.operators import asof, attachments, report, terms


def plain_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def misspelt(rng, word):
    word = list(word)
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(word) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            word.insert(k, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        elif len(word) > 1 and kind == 1:
            word.pop(k - 1)
        elif len(word) > 1 and kind == 2:
            word[k - 1] = rng.choice("aeiou")
        elif len(word) > 2:
            k = rng.randrange(len(word) - 1)
            word[k], word[k + 1] = word[k + 1], word[k]
    return "".join(word)


@pytest.mark.parametrize("words,least", [(attachments.NEGATIVE, 0.85), (attachments.POSITIVE, 0.82), (["ab", "abc", "a"], 0.6)])
def test_near_terms_lose_no_word(spark, words, least):
    rng = random.Random(len(words))
    tokens = sorted({misspelt(rng, rng.choice(words)) for _ in range(300)} | set(words) | {"x" * 30, "q"})
    got = {(r.token, r.term): r.ratio for r in terms.near_terms(spark.createDataFrame([(t,) for t in tokens] + [("",), (None,)], "token string"), words, least).collect()}
    want = {(t, w): plain_ratio(t, w) for t in tokens for w in words if plain_ratio(t, w) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {r.token: (r.term, r.ratio) for r in terms.best_term(spark.createDataFrame([(t,) for t in tokens], "token string"), words, least).collect()}
    for t in {t for t, _ in want}:
        top = max(want[t, w] for w in words if (t, w) in want)
        assert best[t] == (min(w for w in words if want.get((t, w)) == top), pytest.approx(top))


def plain_score(name, mime, kind):
    low = (name or "").lower()
    if not low.endswith((".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv")):
        return -99
    if (mime or "").lower().startswith("image/") or low.startswith(tuple(attachments.NEGATIVE_PREFIXES)):
        return -10
    tokens = set(re.split(r"[^a-z0-9]+", low.rsplit(".", 1)[0])) - {""}
    hits = lambda words, least: sum(t in words or max(plain_ratio(t, w) for w in words) >= least for t in tokens)
    negative, positive = hits(attachments.NEGATIVE, 0.85), hits(attachments.POSITIVE, 0.82)
    if negative and negative >= positive:
        return -3 * negative
    score = (2 if low.endswith((".docx", ".doc")) else 3) + 3 * positive
    score += 2 * (low.endswith(".pdf") and bool(tokens & set(attachments.PDF_WORDS)))
    score += {"orcamento_recebido": 3, "pedido_orcamento": -2}.get(kind, 0)
    return -1 if not positive and kind != "orcamento_recebido" else score


def test_attachment_scores_of_misspelt_names(spark):
    rng = random.Random(9)
    every = attachments.POSITIVE + attachments.NEGATIVE + ["final", "2024", "v2"]
    rows = [(k, "_".join(misspelt(rng, rng.choice(every)) for _ in range(rng.randrange(1, 4))) + rng.choice([".pdf", ".PDF", ".docx", ".xlsx", ".png", ""]), rng.choice([None, "image/png", "application/pdf"]), rng.choice([None, "orcamento_recebido", "pedido_orcamento", "duvida"])) for k in range(250)]
    rows += [(900, None, None, None), (901, "", "x", "duvida"), (902, ".pdf", None, "orcamento_recebido")]
    got = {r.k: r.score for r in attachments.scored_attachments(spark.createDataFrame(rows, "k int, name string, mime string, message_type string")).collect()}
    assert got == {k: plain_score(n, m, t) for k, n, m, t in rows}


@pytest.mark.parametrize("else_latest", [False, True])
def test_asof_join(spark, else_latest):
    rng = random.Random(3)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(10)])) for k in range(60)]
    right = [(rng.choice(["a", "b", "c"]), rng.choice([None, *range(2, 9)]), v) for v in range(25)]
    got = asof.asof_join(spark.createDataFrame(left, "k int, g string, t int"), spark.createDataFrame(right, "g string, t int, v int"), ["g"], "t", "v", "found", else_latest)
    assert got.columns == ["k", "g", "t", "found"]
    for r in got.collect():
        own = [(t, v) for g, t, v in right if g == r.g and t is not None]
        before = [x for x in own if r.t is not None and x[0] <= r.t]
        assert r.found == (max(before)[1] if before else max(own)[1] if own and else_latest else None)
    assert got.count() == len(left)


def test_counters_are_taken_while_tables_are_written(spark):
    run = report.Run()
    messages = spark.createDataFrame([("p", "a", 1, None, "x"), ("p", "a", 2, None, "x"), ("p", "b", 3, "r", None), ("p", "c", 4, None, None), (None, "d", 5, None, "x")], "process_id string, message_id string, ingest_seq long, rule_type string, label string")
    kept = run.messages(messages, messages.filter("message_id = 'c'"))
    run.attachments(spark.createDataFrame([(d,) for d in ("accepted", "rejected", "template", "duplicate", None)], "disposition string"))
    run.files(spark.createDataFrame([("f", "1"), ("g", "1")], "file_id string, version string"), spark.createDataFrame([("f", "1", "5", "11", "")], "file_id string, version string, extraction_version string, tax_id string, phone string"))
    run.enriched(spark.createDataFrame([("s", "phone"), ("s", "tax_id")], "supplier_id string, field string"))
    assert {r.counter: r.n for r in run.counters(spark).collect()} == {
        "messages_new": 3, "messages_duplicate": 2, "messages_labelled_outside": 2, "attachments_total": 5, "attachments_approved": 1, "attachments_filtered": 2, "attachments_duplicate": 1,
        "files_cached": 1, "files_new": 1, "suppliers_enriched": 1,
    }
    assert kept.filter("is_new").count() == 3


def test_figures_of_nothing(spark):
    messages = spark.createDataFrame([], "process_id string, type string, from_email string")
    part = spark.createDataFrame([], "process_id string, sent_quote boolean, declined boolean, first_reply_at timestamp, read_ok boolean")
    cells = spark.createDataFrame([], "process_id string, supplier string, unit_price double, row_id string")
    got = report.figures(messages, part, cells).collect()
    assert all(r.process_id is None and r.n == 0 for r in got)
