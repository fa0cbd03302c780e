"""Hand-computed values of the column functions."""

from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pricemap.functions import classify, contacts, dates, normalize, similarity, text


@pytest.fixture(scope="module")
def value(spark):
    """The value of a function of literal arguments."""

    def of(function, *args, **more):
        cols = [F.lit(a) if a is not None else F.lit(None).cast("string") for a in args]
        out = function(*cols, **more)
        out = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(out)]) if isinstance(out, tuple) else out
        got = spark.range(1).select(out.alias("v")).first().v
        return tuple(got) if hasattr(got, "asDict") else got

    return of


@pytest.mark.parametrize("given, want", [("PÇ", "UN"), ("caixas", "CX"), ("lt", "L"), ("conjunto", "KIT"), ("R$ 5", None), ("M2", None), ("GALAO", "GALAO"), ("EMBALAGEM GRANDE", None), ("", None), (None, None), (" und ", "UN")])
def test_unit(value, given, want):
    assert value(normalize.normalize_unit, given) == want


@pytest.mark.parametrize("given, want", [("5305-01-234-5678", "5305012345678"), ("5305.01.234.5678", "5305012345678"), ("N/A", None), ("0", None), ("A-1", None), ("ab 12/3", "AB123"), (None, None)])
def test_code(value, given, want):
    assert value(normalize.normalize_code, given) == want


@pytest.mark.parametrize("given, want", [("R$ 1.234,56", 1234.56), ("25,90", 25.9), ("7", 7.0), ("abc", None), ("1234,56", 1234.56), ("10.5", 10.5), ("-5,00", -5.0), ("1.234", 1234.0), ("0,1234", 0.1234), (None, None)])
def test_money(value, given, want):
    assert value(normalize.parse_brl, given) == want


@pytest.mark.parametrize("given, want", [("1.234,5", 1234.5), ("1,5", 1.5), ("1.5", 1.5), ("x", None)])
def test_number(value, given, want):
    assert value(normalize.parse_number, given) == want


def test_derived_price(spark):
    rows = [(None, 10.0, 4.0, 2.5), (10.0, 10.0, 4.0, 2.5), (3.0, 10.0, 4.0, 3.0), (None, 10.0, 0.0, None), (5.0, None, None, 5.0)]
    df = spark.createDataFrame(rows, "u double, t double, q double, want double")
    for r in df.select(normalize.derived_unit_price(F.col("u"), F.col("t"), F.col("q")).alias("got"), "want").collect():
        assert r.got == r.want


def test_unit_and_quantity(value):
    assert value(normalize.unit_and_quantity, "12 | parafuso | UN | 5,0") == ("UN", 5.0)
    assert value(normalize.unit_and_quantity, "7 | CX") == ("CX", 7.0)
    assert value(normalize.unit_and_quantity, "entrega de 5 UN hoje") == ("UN", 5.0)
    assert value(normalize.unit_and_quantity, "kg 2,5 de cobre") == ("KG", 2.5)
    assert value(normalize.unit_and_quantity, "nada") == (None, None)


def test_quantity_diverges(spark):
    row = spark.range(1).select(*[normalize.quantity_diverges(F.lit(a).cast("double"), F.lit(b).cast("double")) for a, b in ((1, 3), (1, 2), (0, 9), (None, 1))]).first()
    assert list(row) == [True, False, False, False]


VALID = "11222333000181"


def test_tax_ids(value):
    assert value(contacts.tax_id_valid, VALID) and value(contacts.tax_id_valid, "11.222.333/0001-81")
    assert not value(contacts.tax_id_valid, "11222333000182") and not value(contacts.tax_id_valid, "0" * 14) and not value(contacts.tax_id_valid, None)
    assert value(contacts.first_tax_id, "x 11222333000182 y") == "11.222.333/0001-82"
    assert value(contacts.strong_tax_id, "CNPJ: 11.222.333/0001-81") == "11.222.333/0001-81"
    assert value(contacts.strong_tax_id, "9911222333000181") == "11.222.333/0001-81"
    assert value(contacts.strong_tax_id, "nada 123") is None


def test_phones(value):
    assert value(contacts.first_phone, "fone +55 (21) 98765-4321") == "(21) 98765-4321"
    assert value(contacts.first_phone, "2134567890") == "(21) 3456-7890"
    assert value(contacts.phone_valid, "(21) 98765-4321") and not value(contacts.phone_valid, "20 98765-4321")
    assert value(contacts.strong_phone, "pedido 123456 Telefone: (21) 3456-7890") == "(21) 3456-7890"
    assert value(contacts.strong_phone, "nada") is None


def test_names(value):
    assert value(contacts.company_from_email, "a@mail.acme.com.br") == "Acme"
    assert value(contacts.company_from_email, "a@gmail.com") is None
    assert value(contacts.company_from_email, "a@foo-bar.com") == "Foo Bar"
    assert value(contacts.preferred_name, "joao.silva@gmail.com", "") == "Joao.silva"
    assert value(contacts.legal_name, "Acme Comércio Ltda\nRua 1\nCNPJ 11.222.333/0001-81") == "Acme Comércio Ltda"
    assert value(contacts.legal_name, "sem nada") is None


def test_process_numbers(value):
    assert value(classify.process_number, "Pregão 12/2024") == "12/2024"
    assert value(classify.process_number, "NUP 60650.000123/2024-01") == "60650.000123/2024-01"
    assert value(classify.process_number, "Processo AB-1.2/2023 x") == "AB-1.2/2023"
    assert value(classify.process_number, "nada") is None


def test_rules_in_order(value):
    rule = lambda s, b, f, m=False: value(classify.classify_rules, s, b, f, m)
    assert rule("x", "lamentamos, segue proposta", "a@b.c") == "declinio"
    assert rule("x", "solicita, lamentamos", "a@x.mil.br") == "pedido_orcamento"
    assert rule("x", "segue proposta", "a@b.c", True) == "confirmacao_leitura"
    assert rule("Lida: x", "segue proposta", "a@b.c") == "confirmacao_leitura"
    assert rule("x", "bom dia", "a@b.c") is None and rule(None, None, None, None) is None
    assert rule("x", "a" * 1500 + "lamentamos", "a@b.c") is None


def test_dates(value):
    day = datetime(2024, 1, 23, 14, 37)
    for given in ("Tue, 23 Jan 2024 14:37:00 +0000", "23/01/2024 14:37", "23/01/24 14:37", "23/01/2024 2:37 PM", "23 de janeiro de 2024 14:37", "Tue, 23 Jan 2024 11:37:00 -0300"):
        assert value(dates.parse_date, given) == day, given
    assert value(dates.parse_date, "23/01/2024") == datetime(2024, 1, 23) and value(dates.parse_date, "31/02/2024") is None and value(dates.parse_date, "ontem") is None
    body = "ok\nEm 23/01/2026 10:30, Fulano escreveu:\n> x\nOn Jan 5 2026 Bob wrote:\nEnviado em: 1/2/2026\n"
    assert value(dates.history_dates, body) == ["23/01/2026 10:30", "Jan 5 2026 Bob", "1/2/2026"]
    may = [datetime(2024, 5, 1), datetime(2024, 5, 5)]
    picked = lambda days, reply: value(lambda *c: dates.request_date(F.array(*c[:-1]), c[-1]), *days, reply)
    assert picked(may, datetime(2024, 5, 3)) == may[0] and picked(may[1:], datetime(2024, 5, 3)) == may[1]
    assert value(dates.elapsed_text, datetime(2024, 1, 1), datetime(2024, 1, 3, 5)) == "2d 5h"
    assert value(dates.elapsed_text, datetime(2024, 1, 1), datetime(2024, 1, 1, 5, 7)) == "5h 7min"


def test_texts(value):
    assert value(text.strip_accents, "ÀçãoñÜ") == "AcaonU"
    assert value(text.clean_text, "a\r\n\n\n\n b\x00\t c ") == "a\n\n b c"
    assert value(text.html_to_text, "<p>a&nbsp;b &amp; c</p>") == "a b & c"
    assert value(text.normalize_header, "Nº do Ítem") == "n do item"
    assert value(text.file_tokens, "Cotação_2024-v1.PDF") == ["cotacao", "2024", "v1"]
    assert value(text.file_kind, "a.XLSX") == "planilha" and value(text.file_kind, "x") == "desconhecido"
    assert value(text.is_budget_file, "a.csv") and not value(lambda c: text.is_budget_file(c, "archive"), "a.csv") and value(lambda c: text.is_budget_file(c, "archive"), "a.PNG")
    assert value(text.is_poor_text, "curto") and not value(text.is_poor_text, "um texto bem mais longo que o outro, sem erro")
    assert value(text.display_name, "/x/minha_loja.pdf") == "minha loja"


def test_bounds_hold(spark):
    words = ["parafuso inox", "porca inox m8", "arruela lisa", "PARAFUSO sextavado inox", "", "cabo 10mm"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    a, b = similarity.token_sorted(F.col("a")), similarity.token_sorted(F.col("b"))
    m, n = (similarity.marks(a), similarity.marks(b)), (F.length(a), F.length(b))
    possible = [F.struct(F.lit(float(p)).alias("p"), similarity.levenshtein_possible(*m, *n, p).alias("lev"), similarity.ratio_possible(*m, *n, p).alias("r")) for p in range(5, 101, 5)]
    out = df.select(a.alias("x"), b.alias("y"), similarity.levenshtein_score(a, b).alias("lev"), similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("r"), similarity.token_set_ratio(F.col("a"), F.col("b")).alias("s"), F.array(*possible).alias("possible"))
    for r in out.collect():
        want = SequenceMatcher(None, r.x, r.y).ratio() * 100 if r.x or r.y else 100.0
        assert abs(r.r - want) < 1e-9 and r.s >= 0
        for p in r.possible:
            assert (p.lev or r.lev < p.p) and (p.r or r.r < p.p), (r, p)
    assert not all(p.lev for r in out.collect() for p in r.possible)
