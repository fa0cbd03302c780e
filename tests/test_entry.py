"""The driver's contract."""

import __spark_entry__ as entry


def test_names_agree():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) >= 50


def test_flagship(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["process_id", "row_id", "min_price", "min_supplier", "n_quotes"] and df.count() > 0
