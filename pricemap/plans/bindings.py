"""The engine's input tables, derived from the driver's tables.

The SQL runs unchanged in Spark and in DuckDB, so a query and its twin read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS = """SELECT CONCAT('P', CAST(l_orderkey % 20 AS STRING)) AS process_id,
       CONCAT('F', CAST(l_orderkey AS STRING)) AS file_id,
       s_name AS supplier,
       ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq,
       CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS STRING) END AS item_no,
       CASE WHEN l_partkey % 3 <> 2 THEN CONCAT('PN-', CAST(100000 + l_partkey AS STRING)) END AS material_code,
       CONCAT(p_name, ' ', p_brand, ' ', p_type) AS description,
       CASE p_size % 6 WHEN 0 THEN 'UND' WHEN 1 THEN 'caixa' WHEN 2 THEN 'KG' WHEN 3 THEN 'Pc' WHEN 4 THEN 'rolos' END AS unit,
       CAST(l_quantity AS DOUBLE) AS quantity,
       CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) END AS unit_price,
       CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DOUBLE) * CASE WHEN l_linenumber = 6 THEN CAST(1.05 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END END AS total_price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey"""

MESSAGES = """SELECT CONCAT('P', CAST(CAST(FLOOR(event_id / 50) AS BIGINT) % 20 AS STRING)) AS process_id,
       CONCAT('m', CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS STRING)) AS message_id,
       event_id AS ingest_seq, ts AS sent_at,
       CONCAT('user', CAST(user_id AS STRING), '@',
              CASE user_id % 5 WHEN 0 THEN CONCAT('supplier', CAST(user_id AS STRING), '.com.br') WHEN 1 THEN 'gmail.com'
                               WHEN 2 THEN 'compras.mil.br' WHEN 3 THEN CONCAT('mail.acme-', CAST(user_id AS STRING), '.com') ELSE 'uol.com.br' END) AS from_email,
       CASE event_type WHEN 'signup' THEN 'pedido_orcamento' WHEN 'purchase' THEN 'orcamento_recebido' WHEN 'view' THEN 'confirmacao_leitura'
                       WHEN 'error' THEN 'declinio' ELSE 'duvida' END AS type
FROM {events}"""

ATTACHMENTS = """SELECT doc_id AS ingest_seq, CAST(FLOOR(doc_id / 4) AS BIGINT) AS message_id, doc_id % 4 AS pos, lang AS sender, source, text AS content,
       CASE doc_id % 16 WHEN 0 THEN 'cotacao_n.pdf' WHEN 1 THEN 'cotacao_n.xlsx' WHEN 2 THEN 'catalogo_n.pdf' WHEN 3 THEN 'proposta-n.docx'
                        WHEN 4 THEN 'img_n.png' WHEN 5 THEN 'n.xlsx' WHEN 6 THEN 'logo.pdf' WHEN 7 THEN 'planilha_precos.csv'
                        WHEN 8 THEN 'cotacoa_n.pdf' WHEN 9 THEN 'Orcamneto.XLSX' WHEN 10 THEN 'catalgo.pdf' WHEN 11 THEN 'boletos_2024.pdf'
                        WHEN 12 THEN 'fotto.docx' WHEN 13 THEN 'valro.csv' WHEN 14 THEN 'prposta.pdf' ELSE 'cotacao_scan.pdf' END AS name,
       CASE WHEN doc_id % 16 = 15 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime,
       CASE CAST(FLOOR(doc_id / 4) AS BIGINT) % 3 WHEN 0 THEN 'orcamento_recebido' WHEN 1 THEN 'pedido_orcamento' ELSE 'duvida' END AS message_type
FROM {documents}"""

DOCUMENTS = """SELECT CONCAT('F', CAST(o_orderkey AS STRING)) AS file_id, o_orderkey % 3 <> 0 AS found_table, o_orderkey % 4 <> 0 AS found_columns,
       CAST(o_orderkey % 7 AS INT) AS item_blocks, CASE WHEN o_orderkey % 11 = 0 THEN 'scanned' ELSE 'text' END AS kind,
       CAST(o_orderkey % 6 AS INT) AS pages, CAST(o_orderkey % 5 AS INT) AS pages_with_text,
       CASE WHEN o_orderkey % 13 = 0 THEN 'failed' END AS error, o_orderkey
FROM {orders}"""

USAGE = """SELECT CONCAT('P', CAST(CAST(FLOOR(event_id / 50) AS BIGINT) % 20 AS STRING)) AS process_id,
       CONCAT('model', CAST(user_id % 5 AS STRING)) AS model, CAST(FLOOR(ABS(value) * 10) AS BIGINT) AS prompt_tokens, CAST(FLOOR(ABS(value)) AS BIGINT) AS completion_tokens,
       CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 100 AS DOUBLE) / 1000 END AS reported_cost, event_id
FROM {events}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables that it names in braces."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def twin(sql: str) -> str:
    """The same SQL for an engine that has the tables as views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, ITEMS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, MESSAGES)
