"""Contacts and fields from other documents, and the whole map."""

from pyspark.sql import functions as F

from pricemap.operators import enrichment
from pricemap.plans import price_map
from pricemap.sources.schemas import TABLES


def test_name_match(spark):
    a = spark.createDataFrame([(1, "Acme Bombas LTDA"), (2, "Casa Silva"), (3, "ME")], "a long, name string")
    b = spark.createDataFrame([(7, "acme bombas"), (8, "Silva e Filhos Materiais"), (9, "Outra Loja"), (10, "me")], "b long, name string")
    assert {(r.a, r.b) for r in enrichment.name_match(a, b, "a", "b").collect()} == {(1, 7), (3, 10)}


def test_name_match_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["supplier", "solar", "solartec", "brasil", "tec", "arte", "ltda", "comercio", "bombas", "industriais", "casa", "nova", "7"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(160)} | {"solar", "solartec brasil", "industriais bombas"})
    stop = {"ltda", "comercio"}
    tokens = {n: {w for w in n.split() if len(w) >= 3 and w not in stop} for n in names}

    def alike(x, y):
        common = len(tokens[x] & tokens[y])
        inside = any(p in w and (tokens[p] or f" {p} " in f" {w} ") for p, w in ((x, y), (y, x)))
        return bool(inside or common >= 2 or any(t and common / len(t) >= 0.6 for t in (tokens[x], tokens[y])))

    a, b = list(enumerate(names[::2])), list(enumerate(names[1::2] + ["solar", "solartec brasil"]))
    got = enrichment.name_match(spark.createDataFrame(a, "a long, name string"), spark.createDataFrame(b, "b long, name string"), "a", "b").collect()
    assert sorted((r.a, r.b, r.n_common) for r in got) == sorted((i, j, len(tokens[x] & tokens[y])) for i, x in a for j, y in b if alike(x, y))


def test_all_customers_meet_all_suppliers(spark, small):
    from pricemap.plans import queries

    got = {r.c_custkey for r in queries.name_match(spark, small).collect()}
    assert {r.s_suppkey for r in spark.read.parquet(f"{small}/supplier.parquet").collect()} <= got


def test_contacts_from_mail(spark):
    suppliers = spark.createDataFrame([("A@x.com", "", None), ("b@x.com", "1", "2")], "email string, tax_id string, phone string")
    mails = spark.createDataFrame([("a@x.com", 1, "CNPJ 11.222.333/0001-81"), ("a@x.com", 3, "oi"), ("a@x.com", 2, "Telefone (21) 3456-7890")], "from_email string, ingest_seq long, body string")
    got = {r.email: (r.tax_id, r.phone) for r in enrichment.backfill_contacts_from_mail(suppliers, mails).collect()}
    assert got == {"A@x.com": (None, "(21) 3456-7890"), "b@x.com": ("1", "2")}


def test_enrichment(spark):
    links = spark.createDataFrame([("f",), ("g",), ("h",)], "file_id string")
    docs = spark.createDataFrame([("f", "11222333000181", "bad")], "file_id string, tax_id string, phone string")
    pages = spark.createDataFrame([("g", 1, "CNPJ 11.222.333/0001-81 fone (21) 3456-7890")], "file_id string, page int, text string")
    got = {r.file_id: (r.tax_id, r.phone, r.needs_lookup) for r in enrichment.enrich_contacts(links, docs, pages).collect()}
    assert got["f"][0] == "11.222.333/0001-81" and got["g"][:2] == ("11.222.333/0001-81", "(21) 3456-7890") and got["h"] == (None, None, True)


def test_members(spark):
    links = spark.createDataFrame([("1", "x/cotacao loja.pdf"), ("2", "nada.pdf")], "file_id string, file_name string")
    files = spark.createDataFrame([(1, "cotacao loja.pdf"), (2, "loja.pdf")], "seq int, name string")
    assert {r.file_id: r.member for r in enrichment.match_members(links, files).collect()} == {"1": "cotacao loja.pdf", "2": None}


def test_members_inside_names(spark):
    names = ["1.pdf", "nf1.pdf", "cotacao", "a_cotacao_1.pdf", "x/Proposta Final.PDF", "proposta final.pdf.zip", "b", "outra.doc"]
    files = ["nf1.pdf", "1.pdf", "a_cotacao_1.pdf", "cotacao", "sta fin", "final.pdf", "nada"]

    def first(n):
        n = n.rsplit("/", 1)[-1].lower()
        return next((m for m in files if n.endswith(m) or m.endswith(n)), next((m for m in files if m in n or n in m), None))

    links = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "file_id string, file_name string")
    members = spark.createDataFrame(list(enumerate(files)), "seq int, name string")
    assert {r.file_id: r.member for r in enrichment.match_members(links, members).collect()} == {str(k): first(n) for k, n in enumerate(names)}


def test_proposed_updates(spark):
    s = spark.createDataFrame([(1, "Acme Bombas", "", "9")], "supplier_id long, name string, tax_id string, phone string")
    c = spark.createDataFrame([(5, "ACME BOMBAS LTDA", "t", "p")], "contact_id long, name string, tax_id string, phone string")
    assert [(r.field, r.value) for r in enrichment.propose_contact_updates(s, c).collect()] == [("tax_id", "t")]


def test_fields_from_lines(spark):
    items = spark.createDataFrame([("f", 1, "12", "bomba centrifuga", None, None), ("f", 2, None, "cabo", "M", 3.0)], "file_id string, seq long, item_no string, description string, unit string, quantity double")
    lines = spark.createDataFrame([("f", 0, "Proposta"), ("f", 1, "12 bomba centrifuga inox"), ("f", 2, "UN | 5"), ("f", 3, "outra coisa KG 7")], "file_id string, pos int, text string")
    got = {r.seq: (r.unit, r.quantity) for r in enrichment.fill_from_lines(items, lines).collect()}
    assert got == {1: ("UN", 5.0), 2: ("M", 3.0)}


def test_whole_map(spark, small):
    from pricemap.plans.bindings import items

    own = items(spark, small).filter("process_id = 'P3'")
    master = spark.createDataFrame([("P3", "999999", None, "item sem cotacao", 1)], "process_id string, item_no string, material_code string, description string, seq long")
    tables = price_map.build_map(price_map.with_master(own, master))
    cov = tables["coverage"]
    assert cov.filter("item_no = '999999'").first().n_quotes == 0 and cov.count() == tables["rows"].count()
    assert tables["cells"].count() <= own.count() and tables["minima"].count() <= cov.count()
    links = own.select("process_id", "file_id").distinct()
    docs = links.select("file_id", F.lit("loja").alias("supplier"))
    assert price_map.rebuild_map(links, docs, own)["cells"].count() == price_map.build_map(own)["cells"].count()


def test_schemas_parse(spark):
    for name, ddl in TABLES.items():
        assert spark.createDataFrame([], ddl).columns, name
