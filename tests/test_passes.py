"""How often large queries read their tables, over how many tasks they spread their work, and what they leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemap.operators import edits, enrichment, resolve
from pricemap.plans import field_queries, queries
from pricemap.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# F3, F10
def test_items_of_one_seq_stay_two(spark):
    rows = [("P1", 1, "PN-100", None, "broca"), ("P1", 1, "PN-100", None, "broca"), ("P1", 2, None, None, "trena"), ("P1", 3, None, "7", "prumo")]
    items = spark.createDataFrame(rows, "process_id string, seq long, material_code string, item_no string, description string")
    items = items.withColumns({"supplier": F.lit("A"), "unit": F.lit("UN"), "quantity": F.lit(1.0), "unit_price": F.lit(2.0), "total_price": F.lit(2.0)})
    assert sorted(r.row_id for r in resolve.resolve_items(items).collect()) == ["D:trena", "K:1", "K:1", "K:3"]


# F10, F15
def test_edits_of_pairs_that_can_be_near():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé "), n)) for n in [0, 1, 5, 9, 30, 63, 64, 65, 130, 131]]
    full, low = edits.distances(texts, texts[::-1]), edits.fewest(texts, texts[::-1])
    assert (low <= full).all() and (low > 0).any()
    at = np.nonzero(low <= 40)
    assert (edits.distances(texts, texts[::-1], at) == full[at]).all()


# F7
def test_a_line_is_measured_once(spark, small):
    assert "RLIKE" not in plan(field_queries.fill_from_lines(spark, small))


# F8, F17
@pytest.mark.parametrize("name", ["items_per_company", "incremental_items"])
def test_items_are_read_from_one_table(spark, small, name):
    assert "Relation [l_orderkey" not in plan(queries.QUERIES[name](spark, small))


# F11, F13
@pytest.mark.parametrize("name", ["long_map", "quantity_reviews"])
def test_items_are_read_once(spark, small, name):
    assert plan(queries.QUERIES[name](spark, small)).count("Relation [l_orderkey") == 1


# F14, F19
@pytest.mark.parametrize("name", ["unit_and_quantity", "contact_extract", "contacts_of_files", "legal_name"])
def test_patterns_are_spread(spark, small, name):
    assert queries.QUERIES[name](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


# F16
def test_csv_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BATCH_CELLS", 3)
    (tmp_path / "a.csv").write_bytes("é;\"x;\r\ny\"\r\n ; \r\n1;2\n3;4".encode())
    (tmp_path / "b.csv").write_bytes(b"")
    got = files.read_quote_csv(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.text) for r in got] == [(0, 0, "é"), (0, 1, "x;\r\ny"), (2, 0, "1"), (2, 1, "2"), (3, 0, "3"), (3, 1, "4")]


# F12, F18
def test_names_are_normalised_once(spark):
    a, b = (spark.createDataFrame([(1, "Álfa Norte"), (2, "")], f"{k} long, name string") for k in "ab")
    found = enrichment.name_match(a, b, "a", "b")
    assert "coalesce(name#" not in plan(found) and [tuple(r) for r in found.collect()] == [(1, 1, 2)]


# F9
def test_pieces_are_numbers(spark):
    wholes, parts = spark.createDataFrame([("xx_cotacao_1.pdf",)], "whole string"), spark.createDataFrame([("cotacao_1.pdf",), ("1.p",), ("",)], "part string")
    found = enrichment.containing(wholes, parts)
    assert "xxhash64" in plan(found) and {r.part for r in found.collect()} == {"cotacao_1.pdf", "1.p"}


# F20
def test_blank_rows_carry_no_file(spark, small):
    assert "file_id" not in plan(queries.blank_priced_rows(spark, small))
