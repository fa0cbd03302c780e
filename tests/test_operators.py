"""Operators on hand-made rows, and their properties."""

import random

import pytest
from pyspark.sql import functions as F

from pricemap.operators import attachments, coverage, documents, grids, participation, prices, resolve
from pricemap.sources import store

CELL = "process_id string, row_id string, supplier string, unit_price double, quantity double, unit string, file_id string, confidence string, seq long"


def cells(spark, given):
    return spark.createDataFrame([("p", "r", f"s{k}", float(v) if v is not None else None, 1.0, None, "f", "alta", k) for k, v in enumerate(given)], CELL)


def test_quartiles_leave_the_middle_out(spark):
    get = lambda v: tuple(spark.range(1).select(*prices.quartiles(F.lit([float(x) for x in v]))).first())
    assert get([1, 2, 3, 4, 100]) == (1.5, 52.0) and get([1, 2, 3, 50]) == (1.5, 26.5)
    assert prices.price_outliers(cells(spark, [1, 1000])).count() == 0
    assert [r.supplier for r in prices.price_outliers(cells(spark, [10, 11, 12, 11, 10, 12, 11, 500])).collect()] == ["s7"]


def test_cells_and_minimum(spark):
    rows = [("p", "r", "a", 5.0, 1), ("p", "r", "a", None, 2), ("p", "r", "b", 4.0, 3), ("p", "r", "c", 4.0, 4)]
    df = spark.createDataFrame(rows, "process_id string, row_id string, supplier string, unit_price double, seq long").selectExpr("*", "1.0 AS quantity", "'UN' AS unit", "'f' AS file_id", "'alta' AS confidence")
    last = {r.supplier: r.unit_price for r in prices.price_cells(df).collect()}
    assert last == {"a": None, "b": 4.0, "c": 4.0}
    assert {r.supplier: r.unit_price for r in prices.price_cells(df, prefer_priced=True).collect()}["a"] == 5.0
    best = prices.min_price(prices.price_cells(df)).first()
    assert (best.min_price, best.min_supplier, best.n_quotes) == (4.0, "b", 2)
    wide = prices.wide_map(prices.price_cells(df), ["a", "b", "c"]).first()
    assert (wide.a, wide.b, wide.min_supplier) == (None, 4.0, "b")


def test_coverage(spark):
    rows = spark.createDataFrame([("p", f"r{n}") for n in (0, 1, 2, 3, 5)], "process_id string, row_id string")
    priced = spark.createDataFrame([("p", f"r{n}", f"s{k}", 1.0) for n in (1, 2, 3, 5) for k in range(n)], "process_id string, row_id string, supplier string, unit_price double")
    cov = coverage.coverage(rows, priced)
    assert {r.row_id: r.pct for r in cov.collect()} == {"r0": 0.0, "r1": 33.3, "r2": 66.7, "r3": 100.0, "r5": 100.0}
    s = coverage.coverage_summary(cov).first()
    assert s.n_none + s.n_some + s.n_full == s.n_rows == 5
    assert coverage.coverage_summary(cov.limit(0)).first().pct_full == 0.0


def test_canonical_description(spark):
    def of(*given):
        df = spark.createDataFrame([("p", "r", k, d, p, None, None, None, None) for k, (d, p) in enumerate(given)], "process_id string, row_id string, seq long, description string, unit_price double, quantity double, unit string, item_no string, material_code string")
        return resolve.canonical_rows(df).first().description

    assert of(("long long name", None), ("short", 1.0)) == "short"
    assert of(("long long name", None), ("short", 1.0), ("short name", 2.0)) == "short name"
    assert of(("short", 1.0), ("a much longer one", None)) == "short"
    assert of(("a", None), ("longer", None)) == "longer"


def lfmis(n, edges):
    near = {k: set() for k in range(n)}
    for a, b in edges:
        near[max(a, b)].add(min(a, b))
    leads, out = set(), {}
    for k in range(n):
        heads = sorted(near[k] & leads)
        out[k] = heads[0] if heads else k
        if not heads:
            leads.add(k)
    return out


def test_leaders_equal_the_sequential_loop(spark):
    rng = random.Random(2)
    nodes, edges, want = [], [], {}
    for g in range(30):
        n = rng.randrange(1, 12)
        own = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(0, 14))} if n > 1 else set()
        nodes += [(f"{g}:{k:02d}", g * 100 + k) for k in range(n)]
        edges += [(f"{g}:{b:02d}", f"{g}:{a:02d}") for a, b in own]
        want |= {f"{g}:{k:02d}": f"{g}:{v:02d}" for k, v in lfmis(n, own).items()}
    got = resolve.leaders(spark.createDataFrame(nodes, "id string, seq long"), spark.createDataFrame(edges, "later string, earlier string"))
    assert {r.id: r.leader for r in got.collect()} == want


def item(seq, supplier, no=None, code=None, desc="x", unit=None, qty=1.0, price=1.0):
    return ("p", "f", supplier, seq, no, code, desc, unit, qty, price, None)


ITEM = "process_id string, file_id string, supplier string, seq long, item_no string, material_code string, description string, unit string, quantity double, unit_price double, total_price double"


def test_resolution(spark):
    rows = [
        item(1, "a", "1", "ABCD-1", "bomba"), item(2, "b", None, "abcd1", "outra coisa"), item(3, "c", "1", None, "bomba"),
        item(4, "a", None, None, "parafuso inox 10mm", "UN"), item(5, "b", None, None, "parafuso inoxx 10mm", "und"), item(6, "c", None, None, "parafuso inox 10mm", "KG"),
        item(7, "c", None, None, "cabo de aco", None),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = {r.seq: r.row_id for r in resolve.resolve_items(df).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and len({got[1], got[4], got[7]}) == 3
    again = {r.seq: r.row_id for r in resolve.resolve_items(df.repartition(3, "supplier")).collect()}
    assert got == again


def test_resolution_equals_a_plain_loop(spark, small):
    from pricemap.plans.bindings import items

    df = items(spark, small).filter("process_id in ('P1', 'P2')").dropDuplicates(["seq"])
    rows = resolve.description_rows(df)
    pairs = {(r.process_id, r.a_row_id, r.b_row_id) for r in resolve.fuzzy_pairs(rows).collect()}
    got = {r.row_id for r in resolve.resolve_items(df).filter("row_id like 'D:%'").select("row_id").collect()}
    heads: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.process_id, r.row_seq)):
        own = heads.setdefault(r.process_id, [])
        if not any((r.process_id, r.row_id, h) in pairs for h in own):
            own.append(r.row_id)
    assert got == {h for own in heads.values() for h in own}


def test_bands_lose_no_pair(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([("p", f"r{k}", k, t, None) for k, t in enumerate(texts)], "process_id string, row_id string, row_seq long, text string, unit string")
    for metric, least in (("levenshtein", 77.0), ("levenshtein", 60.0), ("difflib", 77.0)):
        got = {(r.a_row_id, r.b_row_id) for r in resolve.scored_pairs(df, least, metric).collect()}
        from pricemap.functions import similarity as s

        x = df.select(F.col("row_id").alias("a"), F.col("row_seq").alias("i"), s.token_sorted(F.col("text")).alias("x"))
        y = x.toDF("b", "j", "y")
        score = s.levenshtein_score(F.col("x"), F.col("y")) if metric == "levenshtein" else s.token_sort_ratio(F.col("x"), F.col("y"))
        want = {(r.a, r.b) for r in x.crossJoin(y).filter("i > j").withColumn("s", score).filter(F.col("s") >= least).collect()}
        assert got == want, metric


def test_corrections_win(spark):
    pairs = spark.createDataFrame([("Bomba A", "bomba b", True), ("x", "y", False), ("q", "w", True)], "a_text string, b_text string, matched boolean")
    saved = spark.createDataFrame([("BOMBA B", "bomba  a", "nao_casar", 2), ("bomba a", "bomba b", "casar", 1), ("y", "x", "casar", 1)], "desc_a string, desc_b string, decision string, created_at long")
    assert {r.a_text: r.matched for r in resolve.apply_corrections(pairs, saved).collect()} == {"Bomba A": False, "x": True, "q": True}


def test_verdicts(spark):
    pairs = spark.createDataFrame([(1, "p", "a", "b"), (2, "p", "b", "c"), (3, "p", "d", "e"), (4, "p", "f", "g")], "pair_id long, process_id string, row_a string, row_b string")
    verdicts = spark.createDataFrame([(1, True, 90.0), (2, True, 90.0), (3, True, 69.0), (4, True, 90.0)], "pair_id long, same_item boolean, confidence double")
    own = spark.createDataFrame([("p", r, s) for r, s in (("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "6"), ("g", "6"))], "process_id string, row_id string, supplier string")
    assert {r.row_id: r.merged_into for r in resolve.apply_verdicts(pairs, verdicts, own).collect()} == {"b": "a", "c": "a"}


def test_consensus(spark):
    rows = [item(k, f"s{k}", "1", None, d) for k, d in enumerate(["bomba de agua", "bomba de agua", "bomba da agua", "outra coisa"])]
    got = resolve.consensus_master(spark.createDataFrame(rows, ITEM)).collect()
    assert [(r.description, r.n_agree) for r in got] == [("bomba de agua", 3)]


@pytest.mark.parametrize("name, kind, want", [("cotacao.pdf", "orcamento_recebido", (11, "candidato_valido")), ("catalogo.pdf", "orcamento_recebido", (-3, "sinal_negativo")), ("123.xlsx", "duvida", (-1, "sem_indicio_textual")), ("img_1.pdf", "orcamento_recebido", (-10, "prefixo_negativo")), ("x.zip", None, (-99, "extensao_nao_suportada"))])
def test_attachment_scores(spark, name, kind, want):
    score, reason = attachments.attachment_score(F.lit(name), F.lit("application/pdf"), F.lit(kind).cast("string"))
    assert tuple(spark.range(1).select(score, reason).first()) == want


def test_best_attachment_prefers_a_quoted_pdf(spark):
    df = spark.createDataFrame([(1, "cotacao.xlsx", 0, 9), (1, "cotacao.pdf", 1, 5), (2, "a.pdf", 0, 3), (2, "b.pdf", 1, 3), (3, "x.pdf", 0, -1)], "message_id long, name string, pos int, score int")
    assert {r.message_id: r.name for r in attachments.best_attachment(df).collect()} == {1: "cotacao.pdf", 2: "a.pdf"}


def test_participation(spark):
    rows = [("p", "m1", 2, "2024-05-02", "a@x.com", "orcamento_recebido"), ("p", "m2", 1, "2024-05-03", "a@x.com", "duvida"), ("p", "m3", 3, "2024-05-01", "b@y.mil.br", "pedido_orcamento"), ("p", "m1", 4, "2024-05-02", "a@x.com", "declinio")]
    df = spark.createDataFrame(rows, "process_id string, message_id string, ingest_seq long, sent_at string, from_email string, type string").withColumn("sent_at", F.to_timestamp("sent_at"))
    new = participation.new_messages(df, df.limit(0))
    assert new.count() == 3
    part = participation.participations(new)
    a = part.filter("from_email = 'a@x.com'").first()
    assert a.first_reply_at.day == 3 and a.sent_quote and not a.declined and a.requested_at is None
    assert participation.participations(new, exclude_institutional=True).count() == 1
    assert participation.status_counts(part).first().n_read_effective == 1


def test_structural_confidence(spark):
    docs = spark.createDataFrame([("f", True, True, 0), ("g", False, False, 0)], "file_id string, found_table boolean, found_columns boolean, item_blocks int")
    items = spark.createDataFrame([("f", 2.0, 5.0, 10.0)], "file_id string, quantity double, unit_price double, total_price double")
    assert {r.file_id: r.confidence for r in documents.structural_confidence(docs, items).collect()} == {"f": 100, "g": 10}


def test_reconcile_equals_global_greedy(spark):
    rng = random.Random(8)
    sides = [[("f", k, rng.choice([None, "1", "2"]), rng.choice(["bomba", "bomba dagua", "cabo", "tubo pvc"]), rng.choice(["UN", None]), float(rng.randrange(1, 4))) for k in range(n)] for n in (7, 5)]
    schema = "file_id string, seq long, item_no string, description string, unit string, quantity double"
    a, b = (spark.createDataFrame(s, schema) for s in sides)
    got = {(r.a_seq, r.b_seq) for r in documents.reconcile(a, b).collect()}
    from pricemap.functions.similarity import item_similarity

    both = a.toDF("f", *[f"a_{c}" for c in ("seq", "no", "d", "u", "q")]).crossJoin(b.toDF("g", *[f"b_{c}" for c in ("seq", "no", "d", "u", "q")]))
    pair = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    scored = both.select("a_seq", "b_seq", F.round(item_similarity(*pair("no"), *pair("d"), *pair("u"), *pair("q")), 4).alias("s")).collect()
    want, used_a, used_b = set(), set(), set()
    for r in sorted(scored, key=lambda r: (-r.s, r.a_seq, r.b_seq)):
        if r.a_seq not in used_a and r.b_seq not in used_b:
            want.add((r.a_seq, r.b_seq))
            used_a.add(r.a_seq)
            used_b.add(r.b_seq)
    assert got == want


def test_header_of_unit_price_is_not_total(spark):
    head = spark.createDataFrame([("f", "g", k, t) for k, t in enumerate(["Item", "Descrição", "Valor Unitário", "Valor Total", "QTD"])], "file_id string, grid_id string, col int, text string")
    assert {r.field: r.col for r in grids.map_columns(head).collect()} == {"item_no": 0, "description": 1, "unit_price": 2, "total_price": 3, "quantity": 4}


def test_upserts_and_increments(spark):
    schema = "k string, seq long, name string, n long, phone string"
    a, b = spark.createDataFrame([("x", 1, "", 1, "p1")], schema), spark.createDataFrame([("x", 2, "nome", 2, "p2"), ("y", 3, "z", 5, "p3")], schema)
    rules = {"name": "fill", "n": "add", "phone": "last"}
    got = {r.k: (r.name, r.n, r.phone) for r in store.upsert(a, b, ["k"], rules).collect()}
    assert got == {"x": ("nome", 3, "p2"), "y": ("z", 5, "p3")}
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "file_id string, version string")
    cache = spark.createDataFrame([("a", "1", "5", "1", ""), ("b", "0", "5", "1", ""), ("c", "1", "4", "1", ""), ("d", "1", "5", "", None)], "file_id string, version string, extraction_version string, tax_id string, phone string")
    assert sorted(r.file_id for r in store.incremental(files, cache).collect()) == ["b", "c", "d"]


def test_save_items_replaces_only_its_files(spark, tmp_path):
    path = str(tmp_path / "items")
    store.save_items(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_id string, seq int"), path)
    store.save_items(spark.createDataFrame([("a", 9)], "file_id string, seq int"), path)
    assert sorted((r.file_id, r.seq) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 1)]


def test_reconcile_of_many_documents_is_one_pass_and_the_same_in_rounds(spark):
    from pricemap.operators.documents import _reconcile_by_rounds

    rng = random.Random(5)
    row = lambda f, k: (f, k, rng.choice([None, "1"]), rng.choice(["bomba", "bomba dagua", "cabo", "tubo pvc", None]), rng.choice(["UN", None]), rng.choice([0.0, 2.0, None]), rng.choice([1.0, None]))
    schema = "file_id string, seq long, item_no string, description string, unit string, quantity double, unit_price double"
    a, b = (spark.createDataFrame([row(f"f{f}", k) for f in range(n) for k in range(rng.randrange(1, 7))] + [row(None, 99)], schema) for n in (4, 5))
    pairs = lambda df: sorted((r.file_id, r.a_seq, r.b_seq, r.score) for r in df.collect())
    want = pairs(_reconcile_by_rounds(a, b))
    assert pairs(documents.reconcile(a, b)) == pairs(documents.reconcile(a, b, local=6)) == want
    items = lambda df: sorted(map(repr, df.collect()))
    whole = items(documents.reconciled(a, b))
    assert whole == items(documents.reconciled(a, b, local=6)) and len(whole) == a.count() + b.count() - len(want)
    # no document is paired by a join of all items
    assert "SortMergeJoin" not in documents.reconcile(a, b)._jdf.queryExecution().executedPlan().toString()


def test_uncapped_gray_zone_shuffles_no_pairs(spark):
    texts = [f"peca de aco {k % 7} lisa {k}" for k in range(40)]
    rows = spark.createDataFrame([("p", f"D:{t}", k, t, None) for k, t in enumerate(texts)], "process_id string, row_id string, row_seq long, text string, unit string")
    cells = spark.createDataFrame([("p", f"D:{t}", s) for k, t in enumerate(texts[:35]) for s in (f"s{k % 5}", None)], "process_id string, row_id string, supplier string")
    gray = resolve.gray_zone_pairs(rows, cells, cap=None)
    every = resolve.scored_pairs(rows, 60.0).filter("score < 85").collect()
    seller = {f"D:{t}": k % 5 for k, t in enumerate(texts[:35])}
    want = sorted((r.a_row_id, r.b_row_id) for r in every if seller.get(r.a_row_id, "a") != seller.get(r.b_row_id, "b"))
    assert sorted((r.a_row_id, r.b_row_id) for r in gray.collect()) == want and 0 < len(want) < len(every)
    # one join, whose pairs nothing shuffles
    assert gray._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1 and "Join Left" not in gray._jdf.queryExecution().optimizedPlan().toString()
