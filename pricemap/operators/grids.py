"""Item rows out of grids of cells and out of runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricemap.functions.normalize import normalize_unit, parse_brl
from pricemap.functions.text import clean_text, normalize_header

# Words of header rows, and the synonyms of each field's header.
HEADER_KEYWORDS = ["item", "descricao", "nomenclatura", "nome", "material", "objeto", "qtd", "quantidade", "valor", "preco", "unitario", "numero", "num", "n", "pi", "nsn", "codigo"]
COLUMN_SYNONYMS = {
    "item_no": ["item", "n item", "item do edital", "num", "numero", "n"],
    "material_code": [
        "pi", "nsn", "part number", "partnumber", "pn", "p n", "cod", "codigo", "cod item", "codigo do item", "codigo item", "n estoque", "no estoque",
        "numero de estoque", "num estoque", "referencia", "ref",
    ],
    "description": ["descricao", "nomenclatura", "nome", "especificacao", "produto", "objeto", "material"],
    "unit": ["uf", "und", "unidade", "emb", "cx", "kg", "lt"],
    "quantity": ["qtd", "quantidade", "quant", "qtde"],
    "total_price": ["valor total", "vl total", "total", "valor"],
    "unit_price": ["valor unit", "vl unit", "unitario", "preco unit"],
}
FIELDS = list(COLUMN_SYNONYMS)
# Lines of a price section that are no part of an item.
PAGE_WORDS = [
    "PI", "Referência cadastrada", "Referencia cadastrada", "Descrição do item", "Descricao do item", "STF", "Prazo de", "entrega", "Qnt",
    "Valor Unitário", "Valor Unitario", "Valor Total", "PROPOSTA", "REV 00",
]


def detect_header(cells: DataFrame, first_rows: int = 40) -> DataFrame:
    """(file_id, grid_id, header_row): the first row with two cells or more that hold a header word."""
    hit = F.arrays_overlap(F.split(normalize_header(F.col("text")), " "), F.array(*[F.lit(x) for x in HEADER_KEYWORDS]))
    rows = cells.filter(F.col("row") < first_rows).groupBy("file_id", "grid_id", "row").agg(F.count_if(hit).alias("n")).filter("n >= 2")
    return rows.groupBy("file_id", "grid_id").agg(F.min("row").alias("header_row"))


def synonym_table(spark: SparkSession) -> DataFrame:
    rows = [(f, s, " " in s) for f, own in COLUMN_SYNONYMS.items() for s in own]
    return spark.createDataFrame(rows, "field string, synonym string, several boolean")


def map_columns(header: DataFrame) -> DataFrame:
    """(file_id, grid_id, col, field) of header cells (file_id, grid_id, col, text).

    The longest synonym that a cell holds decides, so a column serves one field; of several columns
    for a field the first does.
    """
    cells = header.withColumn("norm", normalize_header(F.col("text")))
    synonyms = F.broadcast(synonym_table(header.sparkSession))  # a fixed list
    fits = F.when(F.col("several"), F.col("norm").contains(F.col("synonym"))).otherwise(F.array_contains(F.split("norm", " "), F.col("synonym")))
    hits = cells.join(synonyms, fits)
    per_cell = F.row_number().over(Window.partitionBy("file_id", "grid_id", "col").orderBy(F.desc(F.length("synonym")), "field"))
    best = hits.withColumn("n", per_cell).filter("n = 1")
    per_field = F.row_number().over(Window.partitionBy("file_id", "grid_id", "field").orderBy("col"))
    return best.withColumn("n", per_field).filter("n = 1").select("file_id", "grid_id", "col", "field")


def items_from_grid(cells: DataFrame) -> DataFrame:
    """Item rows below each grid's header; grids without a description or with fewer than two known columns give none."""
    key = ["file_id", "grid_id"]
    header = detect_header(cells)
    joined = cells.join(header.hint("merge"), key)
    mapping = map_columns(joined.filter("row = header_row").select(*key, "col", "text"))
    usable = mapping.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("field") == "description").alias("d")).filter("n >= 2 and d").select(*key)
    below = joined.filter("row > header_row").join(mapping.join(usable.hint("merge"), key).hint("merge"), [*key, "col"])
    wide = below.groupBy(*key, "row").pivot("field", FIELDS).agg(F.first("text"))
    out = wide.withColumns(
        {
            "description": clean_text(F.coalesce("description", F.lit(""))), "unit": normalize_unit(F.col("unit")), "quantity": parse_brl(F.col("quantity")),
            "unit_price": parse_brl(F.col("unit_price")), "total_price": parse_brl(F.col("total_price")),
            "location": F.concat("grid_id", F.lit("!"), F.col("row").cast("string")),
        }
    )
    return out.filter("description <> ''")


def items_from_lines(lines: DataFrame) -> DataFrame:
    """Item rows of documents whose tables came out as one line per cell.

    ``lines``: file_id, page, pos, text.  An item starts at a line of 1-4 digits before one of 6-12 and
    lasts to the next; in it the first two amounts are unit price and total, a number right before an
    amount is the quantity, lead times and norms are skipped, the rest is the description.
    """
    order = Window.partitionBy("file_id").orderBy("page", "pos")
    text = F.col("text")
    rows = lines.withColumn("text", F.trim("text")).filter("text <> ''")
    opens = text.contains("4.1 Preço") | text.contains("4.1 Preco")
    closes = (text == "TOTAL") | text.startswith("4.2 ") | text.contains("4.2 Impostos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("gate", F.last(F.when(closes, False).when(opens, True), ignorenulls=True).over(so_far)).filter("gate")
    rows = rows.withColumn("seen", F.max(text == "Item").over(so_far)).filter(F.col("seen") & (text != "Item"))
    rows = rows.filter(~text.isin(PAGE_WORDS) & ~text.startswith("PTC ") & ~text.startswith("Página "))
    rows = rows.withColumn("after", F.coalesce(F.lead("text").over(order), F.lit("")))
    start = text.rlike(r"^\d{1,4}$") & F.col("after").rlike(r"^\d{6,12}$")
    rows = rows.withColumns({"start": start, "block": F.sum(start.cast("int")).over(so_far)}).filter("block > 0")
    block = Window.partitionBy("file_id", "block").orderBy("page", "pos")
    in_block = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    price = text.rlike(r"^R\$\s*")
    number = text.rlike(r"^\d+([.,]\d+)?$") & F.col("after").rlike(r"^R\$\s*")
    lead_time = text.rlike(r"(?i)\bsemana")
    rows = rows.withColumns({"k": F.row_number().over(block), "is_price": price, "is_number": number, "is_lead": lead_time})
    rows = rows.withColumns({"n_price": F.sum(F.col("is_price").cast("int")).over(in_block), "n_number": F.sum(F.col("is_number").cast("int")).over(in_block)})
    # a norm runs from its mark to a lead time or the quantity
    rows = rows.withColumn("norm", F.coalesce(F.last(F.when(text.startswith("STF"), True).when(F.col("is_lead") | F.col("is_number"), False), ignorenulls=True).over(in_block), F.lit(False)))
    quantity = F.col("is_number") & (F.col("n_number") == 1)
    unit_price, total = F.col("is_price") & (F.col("n_price") == 1), F.col("is_price") & (F.col("n_price") == 2)
    rest = (F.col("k") > 2) & ~quantity & ~unit_price & ~total & ~F.col("is_lead") & ~F.col("norm")
    place = F.struct("page", "pos", "text")
    out = rows.groupBy("file_id", "block").agg(
        F.max(F.when(F.col("k") == 1, text)).alias("item_no"), F.max(F.when(F.col("k") == 2, text)).alias("material_code"),
        F.max(F.when(quantity, text)).alias("q"), F.max(F.when(unit_price, text)).alias("u"), F.max(F.when(total, text)).alias("t"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rest, place))), lambda x: x["text"]), " ").alias("d"),
        F.max(F.when(rest, F.col("page"))).alias("page"),
    )
    done = out.select("file_id", "block", "item_no", "material_code", clean_text(F.col("d")).alias("description"), parse_brl(F.col("q")).alias("quantity"), parse_brl(F.col("u")).alias("unit_price"), parse_brl(F.col("t")).alias("total_price"), F.concat(F.lit("Pagina "), F.col("page").cast("string")).alias("location"))
    return done.filter("description <> '' and unit_price is not null")
