"""Price cells, minima, outliers, and the figures that the methodology names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.functions.normalize import derived_unit_price, normalize_code, normalize_unit
from pricemap.functions.text import normalize_desc

ROW = ["process_id", "row_id"]


def price_cells(assigned: DataFrame, prefer_priced: bool = False) -> DataFrame:
    """One cell per row and supplier: its last item by ``seq``, even without a price, or its last priced one if asked for."""
    order = F.struct(F.col("unit_price").isNotNull().cast("int"), "seq") if prefer_priced else F.col("seq")
    value = F.struct("unit_price", "quantity", "unit", "file_id", "confidence", "seq")
    return assigned.groupBy(*ROW, "supplier").agg(F.max_by(value, order).alias("v")).select(*ROW, "supplier", "v.*")


def assigned_by_code(items: DataFrame) -> DataFrame:
    """Items with their unit price derived and the row that code, else number, else description names (first stage of J1)."""
    code = normalize_code(F.col("material_code"))
    row = F.when(code.isNotNull(), F.concat(F.lit("C:"), code)).when(F.col("item_no").isNotNull(), F.concat(F.lit("N:"), "item_no")).otherwise(F.concat(F.lit("D:"), normalize_desc(F.col("description"))))
    return items.withColumns(
        {
            "unit_price": derived_unit_price(F.col("unit_price"), F.col("total_price"), F.col("quantity")),
            "unit": normalize_unit(F.col("unit")),
            "row_id": row,
            "confidence": F.when(code.isNotNull() | F.col("item_no").isNotNull(), "alta").otherwise("média"),
        }
    )


def min_price(cells: DataFrame) -> DataFrame:
    """Lowest price of each row with its supplier; the first by name on ties."""
    best = F.min(F.when(F.col("unit_price").isNotNull(), F.struct("unit_price", "supplier")))
    return cells.groupBy(*ROW).agg(best.alias("b"), F.count("unit_price").alias("n_quotes")).select(*ROW, F.col("b.unit_price").alias("min_price"), F.col("b.supplier").alias("min_supplier"), "n_quotes")


def _median(values: Column, size: Column) -> Column:
    low, high = F.floor((size + 1) / 2).cast("int"), (F.floor(size / 2) + 1).cast("int")
    return (F.element_at(values, low) + F.element_at(values, high)) / 2


def quartiles(prices: Column) -> tuple[Column, Column]:
    """Medians of the lower and the upper half of a sorted array, the middle one excluded."""
    n = F.size(prices)
    half = F.floor(n / 2).cast("int")
    return _median(F.slice(prices, F.lit(1), half), half), _median(F.slice(prices, n - half + 1, half), half)


def _row_prices(cells: DataFrame) -> DataFrame:
    """The priced cells of each row in order of price, one for each supplier."""
    own = F.array_sort(F.collect_list(F.struct("unit_price", "supplier")))
    return cells.filter(F.col("unit_price").isNotNull()).groupBy(*ROW).agg(own.alias("c")).withColumn("p", F.col("c.unit_price"))


def price_outliers(cells: DataFrame, factor: float = 1.5, least: int = 3) -> DataFrame:
    """Priced cells outside Q1 - factor IQR ... Q3 + factor IQR of a row with ``least`` prices or more."""
    q1, q3 = quartiles(F.col("p"))
    rows = _row_prices(cells).filter(F.size("p") >= least).select(*ROW, "c", q1.alias("q1"), q3.alias("q3"))
    low, high = F.col("q1") - factor * (F.col("q3") - F.col("q1")), F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    outside = F.filter("c", lambda x: (x["unit_price"] < low) | (x["unit_price"] > high))
    return rows.select(*ROW, "q1", "q3", F.inline(outside)).select(*ROW, "supplier", "unit_price", "q1", "q3")


def price_amplitude(cells: DataFrame) -> DataFrame:
    """Spread of the prices of each row."""
    low, high = F.min("unit_price"), F.max("unit_price")
    return cells.filter(F.col("unit_price").isNotNull()).groupBy(*ROW).agg((high - low).alias("amplitude"), F.try_divide(high, low).alias("ratio"), F.count("*").alias("n_prices"))


def supplier_concentration(cells: DataFrame) -> DataFrame:
    """Share of each supplier in a process' priced cells, and the sum of the squared shares."""
    own = cells.filter(F.col("unit_price").isNotNull()).groupBy("process_id", "supplier").agg(F.count("*").alias("n_cells"))
    whole = Window.partitionBy("process_id")
    shares = own.withColumn("total", F.sum("n_cells").over(whole))
    return shares.select(
        "process_id", "supplier", "n_cells",
        F.round(F.col("n_cells") / F.col("total"), 6).alias("share"),
        F.round(F.sum(F.col("n_cells") * F.col("n_cells")).over(whole) / (F.col("total") * F.col("total")), 6).alias("hhi"),
    )


def ratio_outliers(cells: DataFrame, factor: float = 3.0) -> DataFrame:
    """Priced cells of ``factor`` times their row's median or more."""
    rows = _row_prices(cells).filter(F.size("p") >= 2).select(*ROW, "c", _median(F.col("p"), F.size("p")).alias("median_price"))
    above = F.filter("c", lambda x: x["unit_price"] >= factor * F.col("median_price"))
    return rows.select(*ROW, "median_price", F.inline(above)).select(*ROW, "supplier", "unit_price", "median_price")


def suppliers(cells: DataFrame) -> DataFrame:
    """Distinct suppliers in order."""
    return cells.select("supplier").distinct().orderBy("supplier")


def display_rows(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with unit and quantity from the first supplier by name that has them; the unit is UN without any."""
    own = cells.groupBy(*ROW).agg(
        F.min(F.when(F.col("unit").isNotNull(), F.struct("supplier", "unit"))).alias("u"),
        F.min(F.when(F.col("quantity").isNotNull(), F.struct("supplier", "quantity"))).alias("q"),
    )
    joined = rows.join(own.hint("merge"), ROW, "left")
    return joined.withColumns({"unit": F.coalesce("unit", "u.unit", F.lit("UN")), "quantity": F.coalesce("quantity", "q.quantity")}).drop("u", "q")


#: What a row takes from the first item that has it, and what a cell takes from its last item.
OF_ROW, OF_CELL = ("quantity", "unit", "item_no", "material_code"), ("unit_price", "quantity", "unit", "file_id", "confidence", "seq")


def map_rows(assigned: DataFrame, of_row: tuple[str, ...] = OF_ROW, of_cell: tuple[str, ...] = OF_CELL) -> DataFrame:
    """One pass from assigned items to the map: each row's attributes (as ``canonical_rows``) and its ``cells`` (as ``price_cells``).

    Items meet by row and supplier first, so a row with many items is many tasks' work until one row a supplier is left.  Who reads few columns names them: the rest isn't carried.
    """
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(f"first_{c}")
    text = F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("seq")).alias("s"), "description")
    value, names = F.struct(*of_cell), of_row
    of_supplier = assigned.groupBy(*ROW, "supplier").agg(
        F.max_by(value, "seq").alias("cell"), F.min("seq").alias("row_seq"), *[known(c) for c in names],
        F.max(F.when(F.col("unit_price").isNotNull(), text)).alias("priced_text"), F.max(text).alias("any_text"),
    )
    cell = F.when(F.col("supplier").isNotNull(), F.struct("supplier", "cell.*"))
    whole = of_supplier.groupBy(*ROW).agg(
        F.min("row_seq").alias("row_seq"), *[F.min(f"first_{c}").alias(f"first_{c}") for c in names],
        F.max("priced_text").alias("priced_text"), F.max("any_text").alias("any_text"), F.array_sort(F.collect_list(cell)).alias("cells"),
    )
    return whole.select(*ROW, "row_seq", *[F.col(f"first_{c}.v").alias(c) for c in names], F.coalesce("priced_text.description", "any_text.description").alias("description"), "cells")


def shown_rows(mapped: DataFrame) -> DataFrame:
    """Mapped rows with the unit and quantity that a reader sees (W12), from the row or the first supplier by name that has them."""
    first = lambda c: F.get(F.filter(F.col(f"cells.{c}"), lambda x: x.isNotNull()), F.lit(0))
    return mapped.withColumns({"unit": F.coalesce("unit", first("unit"), F.lit("UN")), "quantity": F.coalesce("quantity", first("quantity"))})


def wide_map(cells: DataFrame, names: list[str]) -> DataFrame:
    """The map as it is read: per row one price column per supplier of ``names`` (a process' list is bounded), the lowest
    price, who has it, all suppliers that have it, and whose cells are of low confidence (S11)."""
    own = cells.groupBy(*ROW)
    price = {n: F.max(F.when(F.col("supplier") == n, F.col("unit_price"))).alias(n) for n in names}
    low = F.array_sort(F.collect_set(F.when(F.col("confidence") != "alta", F.col("supplier"))))
    priced = F.array_sort(F.collect_list(F.when(F.col("unit_price").isNotNull(), F.struct("unit_price", "supplier"))))
    wide = own.agg(*price.values(), priced.alias("__p"), F.count("unit_price").alias("n_quotes"), low.alias("low_confidence"))
    best = F.get("__p", F.lit(0))
    is_min = F.transform(F.filter("__p", lambda x: x["unit_price"] == F.get("__p", F.lit(0))["unit_price"]), lambda x: x["supplier"])
    return wide.select(*ROW, *[F.col(f"`{n}`") for n in names], best["unit_price"].alias("min_price"), best["supplier"].alias("min_supplier"), "n_quotes", is_min.alias("is_min"), "low_confidence")


def long_map(cells: DataFrame) -> DataFrame:
    """The map of any number of suppliers: a row a price, whether it is its row's lowest, and whether its cell is doubtful."""
    # over the cells as they are: a join with their minima would make them twice
    whole = Window.partitionBy(*ROW)
    marked = cells.select(*ROW, "supplier", "unit_price", "confidence").withColumns({"min_price": F.min("unit_price").over(whole), "n_quotes": F.count("unit_price").over(whole)})
    return marked.select(*ROW, "supplier", "unit_price", F.coalesce(F.col("unit_price") == F.col("min_price"), F.lit(False)).alias("is_min"), "min_price", "n_quotes", (F.col("confidence") != "alta").alias("doubtful"))
