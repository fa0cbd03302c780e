"""The registered queries, each beside its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemap.functions import classify, contacts, dates, normalize, similarity, text
from pricemap.operators import attachments, checks, coverage, documents, enrichment, grids, participation, prices, resolve, usage
from pricemap.plans.bindings import ATTACHMENTS, DOCUMENTS, ITEMS, MESSAGES, USAGE, bound, items, messages, table, twin
from pricemap.sources import store
from pricemap.streaming import ingest
from pricemap.streaming import participations as streamed
from pricemap.work import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = twin(sql)
        return f

    return add


# -- shared parts of the twins ---------------------------------------------------------------------

SQL_CODE = r"""(SELECT CASE WHEN length(c) >= 4 AND c NOT IN ('0','NA','NULL','NONE','X','XX') THEN c END FROM (SELECT upper(regexp_replace(trim(material_code), '[\s\-./\\]', '', 'g')) AS c))"""
SQL_DESC = r"lower(trim(regexp_replace(description, '\s+', ' ', 'g')))"
SQL_UNIT = """CASE upper(unit) WHEN 'UND' THEN 'UN' WHEN 'PC' THEN 'UN' WHEN 'CAIXA' THEN 'CX' WHEN 'ROLOS' THEN 'RL' ELSE upper(unit) END"""
SQL_ITEMS = f"items AS ({ITEMS})"
SQL_ASSIGNED = f"""{SQL_ITEMS},
assigned AS (SELECT process_id, file_id, supplier, seq, item_no, material_code, description, quantity, total_price, {SQL_UNIT} AS unit,
  CASE WHEN unit_price IS NULL THEN total_price / nullif(quantity, 0) WHEN abs(unit_price - total_price) < 1e-6 THEN coalesce(total_price / nullif(quantity, 0), unit_price) ELSE unit_price END AS unit_price,
  coalesce('C:' || code, 'N:' || item_no, 'D:' || {SQL_DESC}) AS row_id, CASE WHEN code IS NOT NULL OR item_no IS NOT NULL THEN 'alta' ELSE 'média' END AS confidence
  FROM (SELECT *, {SQL_CODE} AS code FROM items))"""
SQL_CELLS = f"""{SQL_ASSIGNED},
cells AS (SELECT process_id, row_id, supplier, unit_price, quantity, unit, file_id, confidence, seq FROM assigned
  QUALIFY row_number() OVER (PARTITION BY process_id, row_id, supplier ORDER BY seq DESC) = 1)"""
SQL_ROWS = f"""{SQL_CELLS},
rws AS (SELECT process_id, row_id, min(seq) AS row_seq, arg_min(quantity, seq) FILTER (quantity IS NOT NULL) AS quantity, arg_min(unit, seq) FILTER (unit IS NOT NULL) AS unit,
  arg_min(item_no, seq) FILTER (item_no IS NOT NULL) AS item_no, arg_min(material_code, seq) FILTER (material_code IS NOT NULL) AS material_code,
  coalesce(first(description ORDER BY length(description) DESC, seq) FILTER (unit_price IS NOT NULL), first(description ORDER BY length(description) DESC, seq)) AS description
  FROM assigned GROUP BY ALL)"""
SQL_COV = f"""{SQL_CELLS},
cov AS (SELECT process_id, row_id, count(unit_price) AS n_quotes, round(least(count(unit_price), 3) * 100.0 / 3, 1) AS pct FROM cells GROUP BY ALL)"""
SQL_MESSAGES = f"""messages AS ({MESSAGES}),
fresh AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY process_id, message_id ORDER BY ingest_seq) = 1)"""
SQL_PART = f"""{SQL_MESSAGES},
part AS (SELECT process_id, from_email, bool_or(type = 'pedido_orcamento') AS asked, bool_or(type = 'orcamento_recebido') AS sent_quote, bool_or(type = 'declinio') AS declined,
  bool_or(type = 'confirmacao_leitura') AS read_ok, arg_min(sent_at, ingest_seq) FILTER (type = 'pedido_orcamento') AS requested_at,
  arg_min(sent_at, ingest_seq) FILTER (type IN ('orcamento_recebido', 'declinio', 'duvida')) AS first_reply_at FROM fresh GROUP BY ALL)"""
SQL_TOKENS = r"array_to_string(list_sort(regexp_extract_all(lower({0}), '[a-z0-9_]+')), ' ')"


def _score(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100.0 ELSE round(100.0 * (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b})), 4) END"


# -- prices and coverage ---------------------------------------------------------------------------


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return prices.assigned_by_code(items(spark, d))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return prices.price_cells(assigned(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("process_id", "row_id").distinct()


@query(f"WITH {SQL_CELLS} SELECT process_id, row_id, arg_min(unit_price, (unit_price, supplier)) FILTER (unit_price IS NOT NULL) AS min_price, arg_min(supplier, (unit_price, supplier)) FILTER (unit_price IS NOT NULL) AS min_supplier, count(unit_price) AS n_quotes FROM cells GROUP BY ALL")
def price_map_min(spark: SparkSession, d: str) -> DataFrame:
    return prices.min_price(cells(spark, d))


@query(f"""WITH {SQL_CELLS},
p AS (SELECT process_id, row_id, list_sort(list(unit_price)) AS p FROM cells WHERE unit_price IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
h AS (SELECT process_id, row_id, p[1:len(p) // 2] AS a, p[len(p) - len(p) // 2 + 1:] AS b FROM p),
q AS (SELECT process_id, row_id, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) / 2 AS q1, (b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) / 2 AS q3 FROM h)
SELECT process_id, row_id, supplier, unit_price, q1, q3 FROM cells JOIN q USING (process_id, row_id)
WHERE unit_price < q1 - 1.5 * (q3 - q1) OR unit_price > q3 + 1.5 * (q3 - q1)""")
def price_outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return prices.price_outliers(cells(spark, d))


@query(f"WITH {SQL_COV} SELECT * FROM cov")
def coverage_items(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage(None, cells(spark, d))


@query(f"""WITH {SQL_COV} SELECT count(*) AS n_rows, count(*) FILTER (n_quotes = 0) AS n_none, round(count(*) FILTER (n_quotes = 0) * 100.0 / count(*), 1) AS pct_none,
count(*) FILTER (n_quotes BETWEEN 1 AND 2) AS n_some, round(count(*) FILTER (n_quotes BETWEEN 1 AND 2) * 100.0 / count(*), 1) AS pct_some,
count(*) FILTER (n_quotes >= 3) AS n_full, round(count(*) FILTER (n_quotes >= 3) * 100.0 / count(*), 1) AS pct_full FROM cov""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_summary(coverage_items(spark, d))


@query(f"WITH {SQL_COV} SELECT process_id, band, part, count(*) AS n_rows, string_agg(row_id, '|' ORDER BY row_id) AS rows_in_band FROM (SELECT process_id, row_id, CAST(least(n_quotes, 3) AS INT) AS band, CAST((row_number() OVER (PARTITION BY process_id, least(n_quotes, 3) ORDER BY row_id) - 1) // 200 AS INT) AS part FROM cov) GROUP BY ALL")
def coverage_lists(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_lists(coverage_items(spark, d), chunk=200)


@query(f"WITH {SQL_CELLS} SELECT * FROM cells")
def price_cells_last(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@query(f"WITH {SQL_ROWS} SELECT * FROM rws")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    return resolve.canonical_rows(assigned(spark, d))


@query(f"WITH {SQL_CELLS} SELECT process_id, row_id, max(unit_price) - min(unit_price) AS amplitude, max(unit_price) / nullif(min(unit_price), 0) AS ratio, count(*) AS n_prices FROM cells WHERE unit_price IS NOT NULL GROUP BY ALL")
def price_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return prices.price_amplitude(cells(spark, d))


@query(f"""WITH {SQL_CELLS}, own AS (SELECT process_id, supplier, count(*) AS n_cells FROM cells WHERE unit_price IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n_cells) OVER (PARTITION BY process_id) AS total, sum(n_cells * n_cells) OVER (PARTITION BY process_id) AS sq FROM own)
SELECT process_id, supplier, n_cells, round(CAST(n_cells AS DOUBLE) / total, 6) AS share, round(CAST(sq AS DOUBLE) / (total * total), 6) AS hhi FROM w""")
def supplier_concentration(spark: SparkSession, d: str) -> DataFrame:
    return prices.supplier_concentration(cells(spark, d))


@query(f"""WITH {SQL_CELLS}, p AS (SELECT process_id, row_id, list_sort(list(unit_price)) AS p FROM cells WHERE unit_price IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT process_id, row_id, (p[(len(p) + 1) // 2] + p[len(p) // 2 + 1]) / 2 AS median_price FROM p)
SELECT process_id, row_id, supplier, unit_price, median_price FROM cells JOIN m USING (process_id, row_id) WHERE unit_price >= 3.0 * median_price""")
def ratio_outliers(spark: SparkSession, d: str) -> DataFrame:
    return prices.ratio_outliers(cells(spark, d))


@query(f"""WITH {SQL_ROWS} SELECT process_id, row_id, coalesce(r.unit, (SELECT arg_min(c.unit, c.supplier) FROM cells c WHERE c.process_id = r.process_id AND c.row_id = r.row_id AND c.unit IS NOT NULL), 'UN') AS unit, r.quantity AS quantity FROM rws r""")
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    return prices.shown_rows(prices.map_rows(assigned(spark, d))).select("process_id", "row_id", "unit", "quantity")


@query(f"WITH {SQL_ASSIGNED} SELECT process_id, seq, row_id, unit_price, confidence FROM assigned")
def resolve_by_code(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).select("process_id", "seq", "row_id", "unit_price", "confidence")


@query(f"""WITH {SQL_ITEMS}, n AS (SELECT * FROM items WHERE item_no IS NOT NULL),
f AS (SELECT process_id, item_no, arg_min(description, seq) AS first_desc FROM n GROUP BY ALL),
s AS (SELECT process_id, seq, item_no, description, {SQL_TOKENS.format('description')} AS a, {SQL_TOKENS.format('first_desc')} AS b FROM n JOIN f USING (process_id, item_no))
SELECT process_id, seq, {_score('a', 'b')} AS score, CASE WHEN {_score('a', 'b')} < 50 THEN 'N:' || item_no || ':' || left({SQL_DESC}, 180) ELSE 'N:' || item_no END AS row_id FROM s""")
def resolve_by_number(spark: SparkSession, d: str) -> DataFrame:
    return resolve.number_rows(items(spark, d).filter("item_no is not null")).select("process_id", "seq", "score", "row_id")


# -- similarity --------------------------------------------------------------------------------------

SQL_DESC_ROWS = f"""{SQL_ITEMS},
bare AS (SELECT process_id, seq, {SQL_DESC} AS t, {SQL_UNIT} AS unit FROM items WHERE item_no IS NULL AND {SQL_CODE} IS NULL),
dr AS (SELECT process_id, 'D:' || t AS row_id, min(seq) AS row_seq, first(unit ORDER BY seq) AS unit, {SQL_TOKENS.format('t')} AS t FROM bare WHERE t <> '' GROUP BY process_id, t)"""
SQL_PAIRS = f"""{SQL_DESC_ROWS},
pairs AS (SELECT a.process_id, a.row_id AS a_row_id, a.row_seq AS a_row_seq, a.unit AS a_unit, b.row_id AS b_row_id, b.row_seq AS b_row_seq, b.unit AS b_unit, {_score('a.t', 'b.t')} AS score
  FROM dr a JOIN dr b ON a.process_id = b.process_id AND a.row_seq > b.row_seq AND (a.unit IS NULL OR b.unit IS NULL OR a.unit = b.unit))"""


@query(f"WITH {SQL_PAIRS} SELECT * FROM pairs WHERE score >= CASE WHEN a_unit = b_unit THEN 77 ELSE 85 END")
def fuzzy_pairs_lev(spark: SparkSession, d: str) -> DataFrame:
    return resolve.fuzzy_pairs(resolve.description_rows(items(spark, d)))


SQL_GRAY = f"""{SQL_PAIRS}, s AS (SELECT process_id, 'D:' || {SQL_DESC} AS row_id, list(DISTINCT supplier) AS s FROM items GROUP BY ALL),
doubtful AS (SELECT p.*, x.s AS a_s, y.s AS b_s FROM pairs p LEFT JOIN s x ON x.process_id = p.process_id AND x.row_id = a_row_id LEFT JOIN s y ON y.process_id = p.process_id AND y.row_id = b_row_id
  WHERE score >= 60 AND score < 85 AND NOT coalesce(list_has_any(x.s, y.s), false)),
gray AS (SELECT * FROM doubtful QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY b_row_seq, a_row_seq) <= 60)"""


def sellers(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """Who quotes each description; ``own`` are the items where they are at hand."""
    return (items(spark, d) if own is None else own).select("process_id", F.concat(F.lit("D:"), text.normalize_desc(F.col("description"))).alias("row_id"), "supplier")


@query(f"WITH {SQL_GRAY} SELECT * EXCLUDE (a_s, b_s) FROM gray")
def gray_zone_pairs_lev(spark: SparkSession, d: str) -> DataFrame:
    return resolve.gray_zone_pairs(resolve.description_rows(items(spark, d)), sellers(spark, d))


@query(f"WITH {SQL_GRAY} SELECT * EXCLUDE (a_s, b_s) FROM doubtful")
def gray_zone_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of the gray zone, whatever their number."""
    # the items once: descriptions and their sellers come of what they offer
    own = resolve.offers(items(spark, d))
    return resolve.gray_zone_pairs(resolve.description_rows(own), sellers(spark, d, own), cap=None)


@query(f"""WITH {SQL_ITEMS}, g AS (SELECT process_id, item_no, trim(description) AS description, count(*) AS w, min(seq) AS seq FROM items WHERE item_no IS NOT NULL AND trim(description) <> '' GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY process_id, item_no) AS total, {SQL_TOKENS.format('description')} AS t FROM g),
a AS (SELECT x.process_id, x.item_no, x.description, x.seq, sum(y.w) AS n_agree FROM t x JOIN t y ON x.process_id = y.process_id AND x.item_no = y.item_no AND {_score('x.t', 'y.t')} >= 80 WHERE x.total >= 3 GROUP BY ALL)
SELECT process_id, item_no, description, CAST(n_agree AS BIGINT) AS n_agree FROM a QUALIFY row_number() OVER (PARTITION BY process_id, item_no ORDER BY n_agree DESC, length(description) DESC, seq) = 1 AND n_agree >= 3""")
def consensus_master_lev(spark: SparkSession, d: str) -> DataFrame:
    return resolve.consensus_master(items(spark, d))


SQL_NAMES = """names AS (SELECT CONCAT('G', CAST(s_suppkey % 10 AS STRING)) AS process_id, s_name AS supplier FROM {supplier}
UNION ALL SELECT CONCAT('G', CAST(s_suppkey % 10 AS STRING)) AS process_id, CONCAT(s_name, ' LTDA') AS supplier FROM {supplier} WHERE s_suppkey % 2 = 0)"""


@query(f"""WITH {SQL_NAMES}, t AS (SELECT DISTINCT process_id, supplier, {SQL_TOKENS.format('supplier')} AS t FROM names)
SELECT a.process_id, b.supplier AS supplier_a, a.supplier AS supplier_b, {_score('a.t', 'b.t')} AS score FROM t a JOIN t b ON a.process_id = b.process_id AND a.supplier > b.supplier WHERE {_score('a.t', 'b.t')} >= 90""")
def duplicate_suppliers_lev(spark: SparkSession, d: str) -> DataFrame:
    return resolve.duplicate_suppliers(bound(spark, d, f"WITH {SQL_NAMES} SELECT * FROM names"))


SQL_LEADERS = f"""{SQL_PAIRS},
ranked AS (SELECT process_id, row_id, row_number() OVER (PARTITION BY process_id ORDER BY row_seq) AS k FROM dr),
near AS (SELECT p.process_id, x.k, list(y.k) AS nb FROM pairs p JOIN ranked x ON x.process_id = p.process_id AND x.row_id = a_row_id JOIN ranked y ON y.process_id = p.process_id AND y.row_id = b_row_id
  WHERE score >= CASE WHEN a_unit = b_unit THEN 77 ELSE 85 END GROUP BY ALL),
walk AS (SELECT process_id, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS heads, CAST(NULL AS BIGINT) AS head FROM ranked GROUP BY ALL
  UNION ALL SELECT w.process_id, r.k, CASE WHEN len(list_intersect(heads, coalesce(nb, []))) > 0 THEN heads ELSE list_append(heads, r.k) END,
    coalesce(list_min(list_intersect(heads, coalesce(nb, []))), r.k) FROM walk w JOIN ranked r ON r.process_id = w.process_id AND r.k = w.k + 1 LEFT JOIN near n ON n.process_id = r.process_id AND n.k = r.k),
lead AS (SELECT w.process_id, x.row_id, y.row_id AS leader FROM walk w JOIN ranked x USING (process_id, k) JOIN ranked y ON y.process_id = w.process_id AND y.k = w.head)"""


@query(f"""WITH RECURSIVE {SQL_LEADERS},
priced AS (SELECT *, {SQL_CODE} AS code, CASE WHEN unit_price IS NULL THEN total_price / nullif(quantity, 0) WHEN abs(unit_price - total_price) < 1e-6 THEN coalesce(total_price / nullif(quantity, 0), unit_price) ELSE unit_price END AS price FROM items),
placed AS (SELECT p.process_id, supplier, seq, price, CASE WHEN code IS NOT NULL THEN 'K:' || min(seq) OVER (PARTITION BY p.process_id, code) ELSE leader END AS row_id FROM priced p LEFT JOIN lead ON lead.process_id = p.process_id AND code IS NULL AND lead.row_id = 'D:' || {SQL_DESC}),
cells AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY process_id, row_id, supplier ORDER BY seq DESC) = 1)
SELECT process_id, row_id, arg_min(price, (price, supplier)) FILTER (price IS NOT NULL) AS min_price, arg_min(supplier, (price, supplier)) FILTER (price IS NOT NULL) AS min_supplier, count(price) AS n_quotes FROM cells GROUP BY ALL""")
def resolve_full(spark: SparkSession, d: str) -> DataFrame:
    own = resolve.resolve_items(items(spark, d))
    return prices.min_price(prices.price_cells(own))


@query()
def token_sort_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(similarity.token_sort_ratio(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand", "p_name")), 4).alias("ratio"))


@query()
def token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(similarity.token_set_ratio(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")), 4).alias("ratio"))


#: Made verdicts: two thirds say the same item, with a confidence of 60 to 99.
SQL_JUDGED = f"""{SQL_GRAY},
judged AS (SELECT *, (a_row_seq + b_row_seq) % 3 > 0 AS same_item, 60 + (a_row_seq + 7 * b_row_seq) % 40 AS confidence FROM gray),
approved AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY b_row_seq, a_row_seq) AS k FROM judged WHERE same_item AND confidence >= 70),
ends AS (SELECT process_id, a_row_id AS r, a_s AS s FROM approved UNION SELECT process_id, b_row_id, b_s FROM approved),
merging AS (
  SELECT process_id, CAST(0 AS BIGINT) AS k, list({{'r': r, 't': r}}) AS roots, list({{'t': r, 's': coalesce(s, []), 'n': length(r)}}) AS known, CAST(NULL AS VARCHAR) AS row_id, CAST(NULL AS VARCHAR) AS absorbed_by, CAST(NULL AS BIGINT) AS confidence FROM ends GROUP BY ALL
  UNION ALL
  SELECT process_id, k, CASE WHEN takes THEN list_transform(roots, lambda e: CASE WHEN e.t = low THEN {{'r': e.r, 't': top}} ELSE e END) ELSE roots END,
    CASE WHEN takes THEN list_transform(known, lambda e: CASE WHEN e.t = top THEN {{'t': e.t, 's': list_concat(x.s, y.s), 'n': e.n}} ELSE e END) ELSE known END,
    CASE WHEN takes THEN low END, CASE WHEN takes THEN top END, CASE WHEN takes THEN confidence END
  FROM (SELECT *, x.t <> y.t AND NOT list_has_any(x.s, y.s) AS takes, CASE WHEN y.n > x.n THEN y.t ELSE x.t END AS top, CASE WHEN y.n > x.n THEN x.t ELSE y.t END AS low
    FROM (SELECT *, list_filter(known, lambda e: e.t = x_t)[1] AS x, list_filter(known, lambda e: e.t = y_t)[1] AS y
      FROM (SELECT m.process_id, p.k, m.roots, m.known, p.confidence, list_filter(m.roots, lambda e: e.r = p.b_row_id)[1].t AS x_t, list_filter(m.roots, lambda e: e.r = p.a_row_id)[1].t AS y_t
        FROM merging m JOIN approved p ON p.process_id = m.process_id AND p.k = m.k + 1)))),
final AS (SELECT process_id, unnest(arg_max(roots, k), max_depth := 2) FROM merging GROUP BY process_id)"""


def judged_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The gray zone's pairs and made verdicts on them."""
    gray = gray_zone_pairs_lev(spark, d).withColumn("pair_id", F.xxhash64("process_id", "a_row_id", "b_row_id"))
    verdicts = gray.select("pair_id", ((F.col("a_row_seq") + F.col("b_row_seq")) % 3 > 0).alias("same_item"), (60 + (F.col("a_row_seq") + 7 * F.col("b_row_seq")) % 40).cast("double").alias("confidence"))
    return gray.select("pair_id", "process_id", F.col("b_row_id").alias("row_a"), F.col("a_row_id").alias("row_b"), F.col("b_row_seq").alias("seq_a"), F.col("a_row_seq").alias("seq_b")), verdicts


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.description_rows(items(spark, d)).select("process_id", "row_id", F.col("text").alias("description"))


@query(f"WITH RECURSIVE {SQL_JUDGED} SELECT process_id, row_id, absorbed_by, t AS merged_into FROM merging JOIN final USING (process_id) WHERE row_id IS NOT NULL AND r = row_id")
def apply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.apply_verdicts(*judged_pairs(spark, d), sellers(spark, d), _descriptions(spark, d)).drop("pair_id")


@query(f"""WITH RECURSIVE {SQL_JUDGED} SELECT process_id, 'casado pela IA juiz' AS kind, row_id[3:] AS new_desc, absorbed_by[3:] AS matched_desc, CAST(confidence AS DOUBLE) AS score FROM merging WHERE row_id IS NOT NULL
UNION ALL SELECT process_id, 'IA juiz: possível mesmo item (confiança baixa, não fundido)', a_row_id[3:], b_row_id[3:], CAST(confidence AS DOUBLE) FROM judged WHERE same_item AND confidence < 70""")
def verdict_reviews(spark: SparkSession, d: str) -> DataFrame:
    """What the verdicts leave to look at."""
    pairs, verdicts = judged_pairs(spark, d)
    texts = _descriptions(spark, d)
    return resolve.verdict_reviews(pairs, verdicts, resolve.apply_verdicts(pairs, verdicts, sellers(spark, d), texts), texts)


SQL_GREEDY = f"""{SQL_ITEMS}, a AS (SELECT file_id, seq, description, unit, quantity, {SQL_TOKENS.format('description')} AS t FROM items),
b AS (SELECT file_id, seq, description, unit, quantity + CASE WHEN seq % 3 = 0 THEN 1.0 ELSE 0.0 END AS quantity, t FROM a WHERE seq % 5 <> 0),
s AS (SELECT file_id, a.seq AS a_seq, b.seq AS b_seq, round(0.6 * {_score('a.t', 'b.t')} + 0.25 * CASE WHEN a.unit IS NOT NULL AND a.unit = b.unit THEN 100.0 ELSE 0.0 END
  + 0.15 * CASE WHEN a.quantity = b.quantity OR abs(a.quantity - b.quantity) / greatest(abs(a.quantity), abs(b.quantity)) < 0.05 THEN 100.0 ELSE 0.0 END, 4) AS score FROM a JOIN b USING (file_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, a_seq, b_seq) AS k FROM s),
g AS (SELECT file_id, CAST(0 AS BIGINT) AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS took FROM o GROUP BY ALL
  UNION ALL SELECT g.file_id, o.k, CASE WHEN NOT list_contains(ua, a_seq) AND NOT list_contains(ub, b_seq) THEN list_append(ua, a_seq) ELSE ua END, CASE WHEN NOT list_contains(ua, a_seq) AND NOT list_contains(ub, b_seq) THEN list_append(ub, b_seq) ELSE ub END,
    NOT list_contains(ua, a_seq) AND NOT list_contains(ub, b_seq) FROM g JOIN o ON o.file_id = g.file_id AND o.k = g.k + 1)"""


@query(f"WITH RECURSIVE {SQL_GREEDY} SELECT file_id, a_seq, b_seq, score FROM o JOIN g USING (file_id, k) WHERE took")
def reconcile_greedy(spark: SparkSession, d: str) -> DataFrame:
    own = items(spark, d).select("file_id", "seq", "item_no", "description", "unit", "quantity")
    other = own.filter("seq % 5 <> 0").withColumns({"item_no": F.lit(None).cast("string"), "quantity": F.col("quantity") + F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0)})
    return documents.reconcile(own, other)


@query(f"""WITH RECURSIVE {SQL_GREEDY}, taken AS (SELECT file_id, a_seq, b_seq, score FROM o JOIN g USING (file_id, k) WHERE took)
SELECT file_id, a_seq AS seq, 'a' AS side, score >= 70 AS sure, score < 70 AS conflict FROM taken
UNION ALL SELECT file_id, seq, 'a' AS side, false AS sure, true AS conflict FROM a WHERE (file_id, seq) NOT IN (SELECT (file_id, a_seq) FROM taken)
UNION ALL SELECT file_id, seq, 'b' AS side, false AS sure, true AS conflict FROM b WHERE (file_id, seq) NOT IN (SELECT (file_id, b_seq) FROM taken)""")
def reconciled_items(spark: SparkSession, d: str) -> DataFrame:
    """Both extractions' items: pairs merged, the rest of either side kept and marked."""
    own = items(spark, d).select("file_id", "seq", "item_no", "description", "unit", "quantity", F.lit(1.0).alias("unit_price"))
    other = own.filter("seq % 5 <> 0").withColumns({"item_no": F.lit(None).cast("string"), "quantity": F.col("quantity") + F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0)})
    return documents.reconciled(own, other).select("file_id", "seq", "side", (F.col("item_confidence") == "alta").alias("sure"), "conflict")


# -- participation -----------------------------------------------------------------------------------


def fresh(spark: SparkSession, d: str) -> DataFrame:
    own = messages(spark, d)
    return participation.new_messages(own, own.limit(0))


def part(spark: SparkSession, d: str) -> DataFrame:
    return participation.participations(fresh(spark, d))


@query(f"""WITH {SQL_MESSAGES}, stored AS (SELECT DISTINCT process_id, message_id FROM messages WHERE ingest_seq % 2 = 0 AND ingest_seq % 10 <> 8)
SELECT * FROM (SELECT m.* FROM messages m ANTI JOIN stored USING (process_id, message_id)) QUALIFY row_number() OVER (PARTITION BY process_id, message_id ORDER BY ingest_seq) = 1""")
def new_messages_anti(spark: SparkSession, d: str) -> DataFrame:
    own = messages(spark, d)
    return participation.new_messages(own, own.filter("ingest_seq % 2 = 0 and ingest_seq % 10 <> 8"))


@query(f"WITH {SQL_PART} SELECT * FROM part")
def participation_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return part(spark, d)


@query(f"WITH {SQL_MESSAGES} SELECT coalesce(type, 'outro') AS type, count(*) AS n_messages FROM fresh GROUP BY ALL")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return participation.type_distribution(fresh(spark, d))


@query(f"""WITH {SQL_PART}, s AS (SELECT DISTINCT from_email FROM messages UNION SELECT s_name || '@novo.com.br' FROM {{supplier}})
SELECT from_email, count(DISTINCT process_id) AS n_processes, CAST(sum(CAST(sent_quote AS INT)) AS BIGINT) AS quotes, CAST(sum(CAST(declined AS INT)) AS BIGINT) AS declines, CAST(sum(CAST(read_ok AS INT)) AS BIGINT) AS reads
FROM s LEFT JOIN part USING (from_email) GROUP BY ALL""")
def supplier_stats(spark: SparkSession, d: str) -> DataFrame:
    known = messages(spark, d).select("from_email").union(table(spark, d, "supplier").select(F.concat("s_name", F.lit("@novo.com.br")))).distinct()
    return participation.supplier_stats(known, part(spark, d))


@query(f"""WITH {SQL_PART}, c AS (SELECT process_id, count(*) AS n_messages FROM fresh GROUP BY ALL),
h AS (SELECT *, (epoch_us(first_reply_at) - epoch_us(requested_at)) / 3.6e9 AS hrs FROM part)
SELECT c.process_id, n_messages, count(from_email) AS n_suppliers, count(*) FILTER (sent_quote) AS n_sent, count(*) FILTER (declined) AS n_declined, count(*) FILTER (read_ok) AS n_read,
count(*) FILTER (NOT sent_quote AND NOT declined AND NOT read_ok AND first_reply_at IS NULL) AS n_silent, round(avg(hrs) FILTER (hrs >= 0), 4) AS mean_hours
FROM c LEFT JOIN h ON c.process_id = h.process_id GROUP BY c.process_id, n_messages""")
def process_summary(spark: SparkSession, d: str) -> DataFrame:
    own = fresh(spark, d)
    return participation.process_summary(own, participation.participations(own))


@query(f"""WITH {SQL_PART} SELECT process_id, count(*) AS n_suppliers, count(*) FILTER (sent_quote) AS n_quotes, count(*) FILTER (declined) AS n_declined,
count(*) FILTER (read_ok OR sent_quote OR declined OR first_reply_at IS NOT NULL) AS n_read_effective, count(*) FILTER (NOT (read_ok OR sent_quote OR declined OR first_reply_at IS NOT NULL)) AS n_unread FROM part GROUP BY ALL""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return participation.status_counts(part(spark, d))


@query(f"WITH {SQL_PART} SELECT process_id, count(*) AS n_contacted, count(first_reply_at) AS n_answered, round(CAST(count(first_reply_at) AS DOUBLE) / count(*), 6) AS response_rate FROM part GROUP BY ALL")
def response_rate(spark: SparkSession, d: str) -> DataFrame:
    return participation.response_rate(part(spark, d))


@query(f"""WITH {SQL_PART} SELECT process_id, from_email, CASE WHEN sent_quote THEN 'orcamento_recebido' WHEN declined THEN 'declinio' WHEN first_reply_at IS NOT NULL THEN 'duvida' WHEN read_ok THEN 'confirmacao_leitura' ELSE 'sem_resposta' END AS status FROM part""")
def participation_status(spark: SparkSession, d: str) -> DataFrame:
    return participation.participation_status(part(spark, d)).select("process_id", "from_email", "status")


SQL_LINKS = f"""{SQL_ITEMS}, links AS (SELECT DISTINCT process_id, file_id, CONCAT('u', CAST(seq % 97 AS STRING), '@forn.com.br') AS sender_email FROM items WHERE seq % 3 = 0),
sup AS (SELECT DISTINCT process_id, CONCAT('u', CAST(seq % 101 AS STRING), '@forn.com.br') AS email FROM items)"""


@query(f"""WITH {SQL_LINKS}, n AS (SELECT process_id, file_id, count(*) AS n FROM items GROUP BY ALL),
own AS (SELECT process_id, sender_email AS email, CAST(sum(n) AS BIGINT) AS n_items, count(DISTINCT file_id) AS n_files FROM links JOIN n USING (process_id, file_id) GROUP BY ALL)
SELECT process_id, email, coalesce(n_items, 0) AS n_items, coalesce(n_files, 0) AS n_files FROM sup FULL JOIN own USING (process_id, email)""")
def items_per_supplier(spark: SparkSession, d: str) -> DataFrame:
    links = bound(spark, d, f"WITH {SQL_LINKS} SELECT * FROM links")
    known = bound(spark, d, f"WITH {SQL_LINKS} SELECT * FROM sup")
    return participation.items_per_supplier(links, items(spark, d), known)


@query(f"SELECT process_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum(coalesce(reported_cost, 0)), 4) AS cost, count(*) AS runs FROM ({USAGE}) GROUP BY ALL")
def usage_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return usage.accumulate_usage(bound(spark, d, USAGE))


# Prices per million tokens of five models, input and output.
MODEL_PRICES = [("model0", 0.30, 2.50), ("model1", 0.25, 2.00), ("model2", 0.25, 0.40), ("model3", 0.15, 0.60), ("model4", 0.25, 1.25)]
SQL_MODEL_PRICES = "p(model, i, o) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in MODEL_PRICES[:4]) + ")"


@query(f"""WITH {SQL_MODEL_PRICES}, u AS ({USAGE}) SELECT event_id, round(coalesce(reported_cost, prompt_tokens / 1e6 * i + completion_tokens / 1e6 * o, 0), 8) AS cost, reported_cost IS NULL AS estimated FROM u LEFT JOIN p USING (model)""")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame(MODEL_PRICES[:4], "model string, input_price double, output_price double")
    return usage.usage_cost(bound(spark, d, USAGE), known).select("event_id", "cost", "estimated")


# -- attachments -------------------------------------------------------------------------------------

SQL_ATT = f"att AS (SELECT *, sha256(content) AS sha256 FROM ({ATTACHMENTS}))"


def attached(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, ATTACHMENTS).withColumn("sha256", text.content_hash(F.col("content"))).drop("content")


@query(f"WITH {SQL_ATT} SELECT ingest_seq, sender, sha256 FROM att QUALIFY row_number() OVER (PARTITION BY sha256, sender ORDER BY ingest_seq) = 1")
def dedup_hash_sender(spark: SparkSession, d: str) -> DataFrame:
    return attachments.dedup_attachments(attached(spark, d)).select("ingest_seq", "sender", "sha256")


@query(f"WITH {SQL_ATT} SELECT ingest_seq, source, sha256 FROM att WHERE source <> 'src0' AND sha256 NOT IN (SELECT sha256 FROM att WHERE source = 'src0')")
def template_barrier(spark: SparkSession, d: str) -> DataFrame:
    return attachments.drop_templates(attached(spark, d), F.col("source") == "src0").select("ingest_seq", "source", "sha256")


#: Points of each made name: of its ending, its words for and against (misspelt ones too), and a word that a PDF gains by.
NAME_POINTS = [
    ("cotacao_n.pdf", 3, 1, 0, 2), ("cotacao_n.xlsx", 3, 1, 0, 0), ("catalogo_n.pdf", 3, 0, 1, 0), ("proposta-n.docx", 2, 1, 0, 0), ("n.xlsx", 3, 0, 0, 0), ("planilha_precos.csv", 3, 2, 0, 0), ("cotacoa_n.pdf", 3, 1, 0, 0),
    ("Orcamneto.XLSX", 3, 1, 0, 0), ("catalgo.pdf", 3, 0, 1, 0), ("boletos_2024.pdf", 3, 0, 1, 0), ("fotto.docx", 2, 0, 1, 0), ("valro.csv", 3, 0, 0, 0), ("prposta.pdf", 3, 1, 0, 0), ("cotacao_scan.pdf", 3, 1, 0, 2), ("img_n.png", 0, 0, 0, 0), ("logo.pdf", 3, 0, 1, 0),
]
SQL_SCORED = f"""{SQL_ATT}, np(name, ext, pos, neg, pdf) AS (VALUES {", ".join(map(str, NAME_POINTS))}),
sc AS (SELECT * EXCLUDE (ext, pos_1, neg, pdf, total), CASE WHEN name LIKE '%.png' THEN -99 WHEN mime LIKE 'image/%' OR name = 'logo.pdf' THEN -10 WHEN neg > 0 AND neg >= pos_1 THEN -3 * neg WHEN pos_1 = 0 AND message_type <> 'orcamento_recebido' THEN -1 ELSE total END AS score,
  CASE WHEN name LIKE '%.png' THEN 'extensao_nao_suportada' WHEN mime LIKE 'image/%' THEN 'mime_imagem' WHEN name = 'logo.pdf' THEN 'prefixo_negativo' WHEN neg > 0 AND neg >= pos_1 THEN 'sinal_negativo' WHEN pos_1 = 0 AND message_type <> 'orcamento_recebido' THEN 'sem_indicio_textual' WHEN total <= 0 THEN 'baixo_sinal_de_orcamento' ELSE 'candidato_valido' END AS reason
  FROM (SELECT att.*, ext, np.pos AS pos_1, neg, pdf, ext + 3 * np.pos + pdf + CASE message_type WHEN 'orcamento_recebido' THEN 3 WHEN 'pedido_orcamento' THEN -2 ELSE 0 END AS total FROM att JOIN np USING (name)))"""


@query(f"WITH {SQL_SCORED} SELECT ingest_seq, CAST(score AS INT) AS score, reason FROM sc")
def attachment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every attachment's score with its reason, misspelt words of its name included."""
    return attachments.scored_attachments(attached(spark, d)).select("ingest_seq", "score", "reason")


@query(f"""WITH {SQL_SCORED}, good AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, pos) AS rk FROM sc WHERE score > 0),
gw AS (SELECT *, bool_or(rk = 1 AND name NOT LIKE '%.pdf' AND contains(name, 'cota')) OVER (PARTITION BY message_id) AS gives FROM good)
SELECT message_id, name, pos, score FROM gw QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY CASE WHEN gives AND name LIKE '%.pdf' AND contains(name, 'cota') THEN 0 ELSE 1 END, CASE WHEN gives AND name LIKE '%.pdf' AND contains(name, 'cota') THEN pos ELSE rk END, pos) = 1""")
def best_attachment(spark: SparkSession, d: str) -> DataFrame:
    return attachments.best_attachment(attachments.scored_attachments(attached(spark, d))).select("message_id", "name", "pos", "score")


@query(f"""WITH {SQL_SCORED}, m AS (SELECT *, row_number() OVER (PARTITION BY sha256, sender ORDER BY ingest_seq) AS n, sha256 IN (SELECT sha256 FROM sc WHERE source = 'src0') AS tpl FROM sc)
SELECT ingest_seq, CASE WHEN source = 'src0' THEN 'institutional' WHEN tpl THEN 'template' WHEN n > 1 THEN 'duplicate' WHEN score <= 0 THEN 'rejected' ELSE 'accepted' END AS disposition FROM m""")
def attachment_dispositions(spark: SparkSession, d: str) -> DataFrame:
    own = attachments.scored_attachments(attached(spark, d))
    return attachments.dispositions(own, F.col("source") == "src0").select("ingest_seq", "disposition")


SQL_MAIL_LINKS = f"""{SQL_MESSAGES}, lk AS (SELECT process_id, CONCAT('email_attachment:', message_id, ':cotacao.pdf:0123456789ab') AS file_id, CASE WHEN ingest_seq % 4 = 0 THEN 'known@x.com' ELSE '' END AS sender_email FROM messages WHERE ingest_seq % 3 = 0)"""


@query(f"""WITH {SQL_MAIL_LINKS}, f AS (SELECT process_id, message_id, arg_min(from_email, ingest_seq) AS from_email FROM messages GROUP BY ALL)
SELECT lk.process_id, file_id, CASE WHEN sender_email = '' THEN coalesce(from_email, sender_email) ELSE sender_email END AS sender_email FROM lk LEFT JOIN f ON f.process_id = lk.process_id AND f.message_id = split_part(file_id, ':', 2)""")
def backfill_sender(spark: SparkSession, d: str) -> DataFrame:
    own = messages(spark, d)
    links = own.filter("ingest_seq % 3 = 0").select("process_id", F.concat(F.lit("email_attachment:"), "message_id", F.lit(":cotacao.pdf:0123456789ab")).alias("file_id"), F.when(F.col("ingest_seq") % 4 == 0, "known@x.com").otherwise("").alias("sender_email"))
    return participation.backfill_sender(links, own)


@query(f"WITH {SQL_MESSAGES} SELECT DISTINCT process_id, message_id FROM messages")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of messages in several batches, each message once."""
    return spark.read.parquet(_ingested(spark, d)).select("process_id", "message_id")


def _ingested(spark: SparkSession, d: str) -> str:
    events = table(spark, d, "events")
    parts, out, state = (new_folder(spark, name) for name in ("stream-in", "stream", "stream-state"))
    events.repartition(4, "event_id").write.parquet(parts)
    stream = spark.sql(MESSAGES, events=spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts))
    ingest.ingest(stream.withColumn("sent_at", F.col("sent_at").cast("timestamp")), out, state).awaitTermination()
    return out


@query(f"WITH {SQL_PART} SELECT * FROM part")
def stream_participations(spark: SparkSession, d: str) -> DataFrame:
    """Participations kept up over a stream of all messages, dealt to batches so that repeats and earlier arrivals come late."""
    events = table(spark, d, "events")
    parts, out, state = (new_folder(spark, name) for name in ("stream-in", "participations", "stream-state"))
    events.repartition(3, F.hash("event_id") % 3).write.parquet(parts)
    stream = spark.sql(MESSAGES, events=spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts))
    streamed.follow_participations(stream, out, state).awaitTermination()
    return streamed.latest_participations(spark, out).withColumns({c: F.col(c).cast(messages(spark, d).schema["sent_at"].dataType) for c in ("requested_at", "first_reply_at")})


# -- documents and text --------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {documents}),
t AS (SELECT doc_id, pos, trim(raw) AS line FROM l WHERE trim(raw) <> '' AND (length(trim(raw)) <= 150 OR regexp_matches(raw, '[0-9]'))),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM t)
SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM m WHERE length(line) <= 10 OR n < 3 OR k = 1 GROUP BY doc_id""")
def prefilter_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.prefilter_lines(table(spark, d, "documents").select("doc_id", "text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text FROM {documents}""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]{3,}', chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text FROM {pages}""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"WITH {SQL_ITEMS} SELECT seq, {SQL_UNIT} AS unit FROM items")
def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("seq", normalize.normalize_unit(F.col("unit")).alias("unit"))


@query(f"WITH {SQL_ITEMS} SELECT seq, {SQL_CODE} AS code FROM items")
def normalize_code(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("seq", normalize.normalize_code(F.col("material_code")).alias("code"))


@query("SELECT DISTINCT l_extendedprice, CAST(l_extendedprice AS DOUBLE) AS value FROM {lineitem}")
def parse_brl(spark: SparkSession, d: str) -> DataFrame:
    price = F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), ",.", ".,")
    rows = table(spark, d, "lineitem").select("l_extendedprice").distinct()
    return rows.select("l_extendedprice", normalize.parse_brl(F.concat(F.lit("R$ "), price)).alias("value"))


def _check_sql(s: str, weights: list[int]) -> str:
    total = " + ".join(f"CAST(substr({s}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


SQL_TAX = """t AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000000 AS STRING), 12, '0') AS base, c_custkey % 3 = 0 AS broken FROM {customer})"""
_W1, _W2 = contacts.WEIGHTS, [6, *contacts.WEIGHTS]
SQL_TAX_IDS = f"""WITH {SQL_TAX}, a AS (SELECT c_custkey, broken, CONCAT(base, CAST({_check_sql('base', _W1)} AS STRING)) AS b13 FROM t),
ids AS (SELECT c_custkey, CONCAT(b13, CAST(({_check_sql('b13', _W2)} + CASE WHEN broken THEN 1 ELSE 0 END) % 10 AS STRING)) AS tax_id FROM a)"""


@query(f"{SQL_TAX_IDS} SELECT c_custkey, tax_id, c_custkey % 3 <> 0 AS valid, substr(tax_id, 1, 2) || '.' || substr(tax_id, 3, 3) || '.' || substr(tax_id, 6, 3) || '/' || substr(tax_id, 9, 4) || '-' || substr(tax_id, 13, 2) AS shown FROM ids")
def tax_id_validate(spark: SparkSession, d: str) -> DataFrame:
    ids = bound(spark, d, f"{SQL_TAX_IDS} SELECT * FROM ids")
    return ids.select("c_custkey", "tax_id", contacts.tax_id_valid(F.col("tax_id")).alias("valid"), contacts.first_tax_id(F.concat(F.lit("CNPJ "), "tax_id")).alias("shown"))


@query("SELECT c_custkey, '(' || CAST(11 + c_custkey % 9 AS STRING) || ') 9' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0') AS phone FROM {customer}")
def phone_extract(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat((11 + F.col("c_custkey") % 9).cast("string"), F.lit(" 9"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0"))
    return table(spark, d, "customer").select("c_custkey", contacts.first_phone(F.concat(F.lit("Contato: +55 "), number, F.lit(" horario comercial"))).alias("phone"))


@query(f"""WITH {SQL_MESSAGES}, e AS (SELECT DISTINCT from_email, regexp_extract(from_email, '@(.+)$', 1) AS dom FROM messages)
SELECT from_email, CASE WHEN dom IN ('gmail.com', 'uol.com.br') THEN NULL WHEN dom = 'compras.mil.br' THEN 'Compras' WHEN dom LIKE 'supplier%' THEN 'Supplier' || regexp_extract(dom, 'supplier(\\d+)', 1) ELSE 'Acme ' || regexp_extract(dom, 'acme-(\\d+)', 1) END AS company FROM e""")
def company_from_email(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("from_email").distinct().select("from_email", contacts.company_from_email(F.col("from_email")).alias("company"))


SQL_SUBJECT = """CASE o_orderkey % 5 WHEN 0 THEN CONCAT('Pregão ', CAST(o_orderkey % 90 + 1 AS STRING), '/2024 itens') WHEN 1 THEN CONCAT('NUP 60650.', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), '/2024-01')
  WHEN 2 THEN CONCAT('Processo ABC-', CAST(o_orderkey % 1000 AS STRING), '/2023') WHEN 3 THEN CONCAT('cotacao ', CAST(o_orderkey % 9999 AS STRING), '/2022') ELSE 'sem numero' END"""


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 90 + 1 AS STRING) || '/2024' WHEN 1 THEN '60650.' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '/2024-01' WHEN 2 THEN 'ABC-' || CAST(o_orderkey % 1000 AS STRING) || '/2023' WHEN 3 THEN CAST(o_orderkey % 9999 AS STRING) || '/2022' END AS number FROM {orders}")
def process_number(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, f"SELECT o_orderkey, {SQL_SUBJECT} AS subject FROM {{orders}}")
    return own.select("o_orderkey", classify.process_number(F.col("subject")).alias("number"))


SQL_MAIL = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Lida: cotação' WHEN 1 THEN 'Solicita proposta' ELSE 'Re: itens' END AS subject,
  CASE o_orderkey % 7 WHEN 0 THEN 'Lamentamos, segue proposta em outro momento' WHEN 1 THEN 'Segue Cotação em anexo' WHEN 2 THEN 'Qual o prazo de entrega?' WHEN 3 THEN 'Nao podemos atender' ELSE 'Bom dia' END AS body,
  CASE o_orderkey % 4 WHEN 0 THEN 'a@compras.mil.br' ELSE 'b@loja.com.br' END AS sender, o_orderkey % 50 = 0 AS is_mdn FROM {orders}"""


@query(f"""SELECT o_orderkey, CASE WHEN is_mdn OR subject LIKE 'Lida:%' THEN 'confirmacao_leitura'
  WHEN sender LIKE '%.mil.br' AND (subject LIKE 'Solicita%' OR body LIKE '%proposta%' OR body LIKE '%Cotação%') THEN 'pedido_orcamento'
  WHEN body LIKE 'Lamentamos%' OR body LIKE 'Nao podemos%' THEN 'declinio' WHEN body LIKE 'Segue Cotação%' THEN 'orcamento_recebido' WHEN body LIKE '%prazo de entrega%' THEN 'duvida' END AS type FROM ({SQL_MAIL})""")
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, SQL_MAIL)
    return own.select("o_orderkey", classify.classify_rules(F.col("subject"), F.col("body"), F.col("sender"), F.col("is_mdn")).alias("type"))


SQL_HISTORY = """SELECT conv_id, turn, CAST(2 + conv_id % 20 AS INT) AS d1, CAST(5 + turn AS INT) AS d2, role FROM {conversations}"""


@query(f"""SELECT DISTINCT conv_id, turn, role, CASE WHEN make_timestamp(2024, 5, d1, 10, 30, 0) <= make_timestamp(2024, 5, 12, 0, 0, 0) AND make_timestamp(2024, 5, d2, 8, 0, 0) <= make_timestamp(2024, 5, 12, 0, 0, 0) THEN greatest(make_timestamp(2024, 5, d1, 10, 30, 0), make_timestamp(2024, 5, d2, 8, 0, 0))
  WHEN make_timestamp(2024, 5, d1, 10, 30, 0) <= make_timestamp(2024, 5, 12, 0, 0, 0) THEN make_timestamp(2024, 5, d1, 10, 30, 0) WHEN make_timestamp(2024, 5, d2, 8, 0, 0) <= make_timestamp(2024, 5, 12, 0, 0, 0) THEN make_timestamp(2024, 5, d2, 8, 0, 0)
  ELSE greatest(make_timestamp(2024, 5, d1, 10, 30, 0), make_timestamp(2024, 5, d2, 8, 0, 0)) END AS requested_at FROM ({SQL_HISTORY})""")
def asof_request_date(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, SQL_HISTORY).distinct()
    day = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    body = F.concat(F.lit("Segue.\nEm "), day("d1"), F.lit("/05/2024 10:30, Fulano escreveu:\n> oi\nEnviado em: "), F.col("d2").cast("string"), F.lit(" de maio de 2024 8:00\n"))
    found = F.transform(dates.history_dates(body), dates.parse_date)
    return own.select("conv_id", "turn", "role", F.to_timestamp_ntz(dates.request_date(found, F.lit("2024-05-12 00:00:00").cast("timestamp"))).alias("requested_at"))


#: Dates that replies quote: up to two a message, before it and after it, on the day or none.
SQL_QUOTED = f"""{SQL_MESSAGES}, quoted AS (SELECT process_id, message_id, sent_at - to_days(CAST(ingest_seq % 4 AS INT)) AS said_at FROM messages WHERE ingest_seq % 3 <> 0
  UNION ALL SELECT process_id, message_id, sent_at + to_days(CAST(1 + ingest_seq % 2 AS INT)) FROM messages WHERE ingest_seq % 2 = 0)"""


def quoted_dates(spark: SparkSession, d: str) -> DataFrame:
    own = messages(spark, d)
    shifted = lambda n: (F.col("sent_at") + F.make_dt_interval(n.cast("int"))).alias("at")
    before = own.filter("ingest_seq % 3 <> 0").select("process_id", "message_id", shifted(-(F.col("ingest_seq") % 4)))
    return before.unionByName(own.filter("ingest_seq % 2 = 0").select("process_id", "message_id", shifted(1 + F.col("ingest_seq") % 2)))


@query(f"""WITH {SQL_QUOTED}, q AS (SELECT f.process_id, f.message_id, max(said_at) FILTER (said_at <= sent_at) AS up_to, max(said_at) AS latest FROM fresh f JOIN quoted USING (process_id, message_id) GROUP BY ALL)
SELECT process_id, message_id, coalesce(up_to, latest) AS quoted_at FROM fresh LEFT JOIN q USING (process_id, message_id)""")
def asof_quoted(spark: SparkSession, d: str) -> DataFrame:
    """The date of the request that each message answers: the latest quoted one up to it, else the latest."""
    return participation.with_quoted_dates(fresh(spark, d), quoted_dates(spark, d)).select("process_id", "message_id", "quoted_at")


@query(f"""WITH {SQL_QUOTED}, q AS (SELECT f.process_id, f.message_id, max(said_at) FILTER (said_at <= sent_at) AS up_to, max(said_at) AS latest FROM fresh f JOIN quoted USING (process_id, message_id) GROUP BY ALL),
m AS (SELECT f.*, CASE WHEN type = 'pedido_orcamento' THEN sent_at WHEN type IN ('orcamento_recebido', 'declinio', 'duvida') THEN coalesce(up_to, latest) END AS asked_at FROM fresh f LEFT JOIN q USING (process_id, message_id))
SELECT process_id, from_email, bool_or(type = 'pedido_orcamento') AS asked, bool_or(type = 'orcamento_recebido') AS sent_quote, bool_or(type = 'declinio') AS declined, bool_or(type = 'confirmacao_leitura') AS read_ok,
arg_min(asked_at, ingest_seq) FILTER (asked_at IS NOT NULL) AS requested_at, arg_min(sent_at, ingest_seq) FILTER (type IN ('orcamento_recebido', 'declinio', 'duvida')) AS first_reply_at FROM m GROUP BY ALL""")
def participation_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Participations whose request may be known only from a reply's quoted history."""
    return participation.participations(participation.with_quoted_dates(fresh(spark, d), quoted_dates(spark, d)))


SQL_COMPANIES = """a AS (SELECT s_suppkey, CONCAT(s_name, CASE s_suppkey % 3 WHEN 0 THEN ' LTDA' WHEN 1 THEN ' Comércio ME' ELSE '' END) AS name FROM {supplier}),
b AS (SELECT c_custkey, CONCAT('Supplier ', c_name) AS name FROM {customer})"""


@query(f"""WITH {SQL_COMPANIES}, na AS (SELECT s_suppkey, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS n FROM a),
nb AS (SELECT c_custkey, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS n FROM b),
ta AS (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda x: length(x) >= 3 AND x NOT IN ('ltda','eireli','epp','comercio','servicos','das','dos','empresa','sociedade','limitada')) AS t FROM na),
tb AS (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda x: length(x) >= 3 AND x NOT IN ('ltda','eireli','epp','comercio','servicos','das','dos','empresa','sociedade','limitada')) AS t FROM nb),
j AS (SELECT s_suppkey, c_custkey, ta.n AS an, tb.n AS bn, len(list_intersect(ta.t, tb.t)) AS i, len(ta.t) AS la, len(tb.t) AS lb FROM ta, tb)
SELECT s_suppkey, c_custkey, CAST(i AS INT) AS n_common FROM j WHERE contains(an, bn) OR contains(bn, an) OR i / greatest(la, 1) >= 0.6 OR i / greatest(lb, 1) >= 0.6 OR i >= 2""")
def name_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = (bound(spark, d, f"WITH {SQL_COMPANIES} SELECT * FROM {t}") for t in "ab")
    return enrichment.name_match(a, b, "s_suppkey", "c_custkey")


@query(f"""WITH {SQL_ITEMS} SELECT process_id, supplier, count(*) AS n_divergent, min(seq) AS first_seq FROM items WHERE total_price IS NOT NULL AND unit_price IS NOT NULL AND quantity IS NOT NULL AND total_price <> 0
AND abs(total_price - unit_price * quantity) > 0.01 * abs(total_price) GROUP BY ALL""")
def arithmetic_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.arithmetic_check(items(spark, d))


SQL_SILENT = f"""{SQL_CELLS}, seen AS (SELECT process_id, supplier, CASE WHEN supplier NOT LIKE '%7' THEN unit_price END AS unit_price FROM cells),
sup AS (SELECT DISTINCT process_id, supplier FROM cells UNION ALL SELECT CONCAT('P', CAST(s_suppkey % 20 AS STRING)) AS process_id, CONCAT(s_name, ' sem itens') AS supplier FROM {{supplier}} WHERE s_suppkey % 7 = 0)"""


@query(f"WITH {SQL_SILENT} SELECT process_id, supplier, count(c.supplier) AS n_cells FROM sup LEFT JOIN seen c USING (process_id, supplier) GROUP BY ALL HAVING count(unit_price) = 0")
def empty_columns(spark: SparkSession, d: str) -> DataFrame:
    own = cells(spark, d)
    silent = table(spark, d, "supplier").filter("s_suppkey % 7 = 0").select(F.concat(F.lit("P"), (F.col("s_suppkey") % 20).cast("string")).alias("process_id"), F.concat("s_name", F.lit(" sem itens")).alias("supplier"))
    known = own.select("process_id", "supplier").distinct().unionByName(silent)
    return checks.empty_columns(own.withColumn("unit_price", F.when(~F.col("supplier").endswith("7"), F.col("unit_price"))), known)


@query(f"""WITH {SQL_ROWS} SELECT r.process_id, count(*) AS n_blank FROM rws r WHERE r.row_seq % 5 = 0 AND EXISTS (SELECT 1 FROM cells c WHERE c.process_id = r.process_id AND c.row_id = r.row_id AND c.unit_price IS NOT NULL) GROUP BY ALL""")
def blank_priced_rows(spark: SparkSession, d: str) -> DataFrame:
    own = prices.map_rows(assigned(spark, d), of_row=(), of_cell=("unit_price",))
    return checks.blank_priced_rows(own.withColumn("description", F.when(F.col("row_seq") % 5 == 0, " ").otherwise(F.col("description"))))


SQL_DOCS = f"docs AS ({DOCUMENTS})"


@query(f"WITH {SQL_DOCS}, {SQL_ITEMS} SELECT file_id FROM docs WHERE file_id NOT IN (SELECT file_id FROM items)")
def empty_extractions(spark: SparkSession, d: str) -> DataFrame:
    return checks.empty_extractions(bound(spark, d, DOCUMENTS), items(spark, d)).select("file_id")


@query(f"WITH {SQL_DOCS}, {SQL_ITEMS} SELECT file_id, error FROM docs WHERE error IS NOT NULL AND file_id NOT IN (SELECT file_id FROM items)")
def failed_documents(spark: SparkSession, d: str) -> DataFrame:
    return checks.failed_documents(bound(spark, d, DOCUMENTS), items(spark, d)).select("file_id", "error")


SQL_CONF = f"""{SQL_DOCS}, {SQL_ITEMS},
own AS (SELECT file_id, count(*) AS n, count(*) FILTER (quantity IS NOT NULL AND unit_price IS NOT NULL AND total_price IS NOT NULL) AS v,
  count(*) FILTER (unit_price * quantity <> 0 AND abs(total_price - unit_price * quantity) / abs(unit_price * quantity) <= 0.05) AS r FROM items GROUP BY ALL),
j AS (SELECT docs.*, coalesce(n, 0) AS n, v, r FROM docs LEFT JOIN own USING (file_id)),
conf AS (SELECT file_id, kind, n AS n_items, CAST(CASE WHEN found_table THEN 40 ELSE 0 END + CASE WHEN found_columns THEN 25 ELSE 0 END
  + CASE WHEN n > 0 AND (item_blocks = 0 OR CAST(least(n, item_blocks) AS DOUBLE) / greatest(n, item_blocks) >= 0.6) THEN 15 ELSE 0 END + 10
  + CASE WHEN n > 0 AND (v = 0 OR CAST(r AS DOUBLE) / v >= 0.8) THEN 10 ELSE 0 END AS INT) AS confidence FROM j)"""


@query(f"WITH {SQL_CONF} SELECT file_id, n_items, confidence FROM conf")
def structural_confidence(spark: SparkSession, d: str) -> DataFrame:
    return documents.structural_confidence(bound(spark, d, DOCUMENTS), items(spark, d)).select("file_id", "n_items", "confidence")


@query(f"WITH {SQL_DOCS} SELECT file_id, CASE WHEN pages_with_text >= greatest(1, pages // 2) THEN 'pdf_texto' ELSE 'pdf_escaneado' END AS kind FROM docs")
def document_kind(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_kind(bound(spark, d, DOCUMENTS)).select("file_id", "kind")


@query(f"""WITH {SQL_CONF}, e AS (SELECT file_id, n_items, CAST(greatest(confidence - CASE WHEN kind = 'scanned' THEN 10 ELSE 0 END, 0) AS INT) AS effective_confidence FROM conf)
SELECT file_id, effective_confidence, CASE WHEN n_items = 0 THEN 'alternate' WHEN effective_confidence >= 85 THEN 'structural' WHEN effective_confidence < 40 THEN 'alternate' ELSE 'reconcile' END AS route FROM e""")
def route_documents(spark: SparkSession, d: str) -> DataFrame:
    scored = documents.structural_confidence(bound(spark, d, DOCUMENTS), items(spark, d))
    return documents.route_documents(scored).select("file_id", "effective_confidence", "route")


@query(f"""WITH {SQL_ITEMS}, r AS (SELECT file_id, seq, CASE WHEN supplier < 'Supplier#000000050' THEN 1 ELSE 2 END AS rank FROM items)
SELECT file_id, seq, CAST(rank AS INT) AS rank FROM r QUALIFY rank = min(rank) OVER (PARTITION BY file_id)""")
def first_nonempty_source(spark: SparkSession, d: str) -> DataFrame:
    own = items(spark, d).select("file_id", "seq", F.when(F.col("supplier") < "Supplier#000000050", 1).otherwise(2).alias("rank"))
    return documents.first_nonempty_source(own)


# The header row of the grids that the parts are laid out in.
GRID_HEADER = ["Item", "Descrição", "UF", "QTD", "Valor Unitário", "Valor Total"]
SQL_GRID = """SELECT CONCAT('F', CAST(CAST(FLOOR(p_partkey / 50) AS BIGINT) AS STRING)) AS file_id, 'g' AS grid_id, CAST(p_partkey % 50 + 3 AS INT) AS row, p_partkey, p_name, p_size, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM {part}"""


@query(f"""SELECT file_id, row, CAST(p_partkey AS STRING) AS item_no, trim(regexp_replace(p_name, '[ \t]+', ' ', 'g')) AS description, CASE p_size % 3 WHEN 0 THEN 'CX' WHEN 1 THEN 'UN' ELSE 'KG' END AS unit, CAST(p_size AS DOUBLE) AS quantity,
CAST(price AS DOUBLE) AS unit_price, CAST(price * p_size AS DOUBLE) AS total_price, 'g!' || row AS location FROM ({SQL_GRID})""")
def grid_items(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, SQL_GRID)
    money = lambda c: F.concat(F.lit("R$ "), F.translate(F.format_number(c.cast("decimal(18,2)"), 2), ",.", ".,"))
    values = [F.col("p_partkey").cast("string"), F.col("p_name"), F.element_at(F.array(F.lit("caixa"), F.lit("und"), F.lit("quilo")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_size").cast("string"), money(F.col("price")), money(F.col("price") * F.col("p_size"))]
    body = own.select("file_id", "grid_id", "row", F.posexplode(F.array(*values)).alias("col", "text"))
    head = own.select("file_id", "grid_id").distinct().select("file_id", "grid_id", F.lit(2).alias("row"), F.posexplode(F.array(*[F.lit(h) for h in GRID_HEADER])).alias("col", "text"))
    out = grids.items_from_grid(head.unionByName(body))
    return out.select("file_id", "row", "item_no", "description", "unit", "quantity", "unit_price", "total_price", "location")


@query(f"""SELECT file_id, CAST(row - 2 AS STRING) AS item_no, CAST(100000 + p_partkey AS STRING) AS material_code, trim(regexp_replace(p_name, '[ \t]+', ' ', 'g')) AS description, CAST(p_size AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS unit_price, CAST(price * p_size AS DOUBLE) AS total_price FROM ({SQL_GRID})""")
def line_block_items(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, SQL_GRID)
    money = lambda c: F.concat(F.lit("R$ "), F.translate(F.format_number(c.cast("decimal(18,2)"), 2), ",.", ".,"))
    values = [(F.col("row") - 2).cast("string"), (100000 + F.col("p_partkey")).cast("string"), F.col("p_name"), F.lit("STF 123"), F.lit("NBR 9"), F.lit("6 semanas"), F.col("p_size").cast("string"), money(F.col("price")), money(F.col("price") * F.col("p_size"))]
    body = own.select("file_id", F.lit(1).alias("page"), (F.col("row") * 100).alias("base"), F.posexplode(F.array(*values)).alias("k", "text")).select("file_id", "page", (F.col("base") + F.col("k")).alias("pos"), "text")
    files = own.select("file_id").distinct()
    head = files.select("file_id", F.lit(1).alias("page"), F.posexplode(F.array(F.lit("4.1 Preço"), F.lit("Item"), F.lit("PI"))).alias("pos", "text"))
    foot = files.select("file_id", F.lit(2).alias("page"), F.lit(0).alias("pos"), F.lit("TOTAL").alias("text"))
    out = grids.items_from_lines(head.unionByName(body).unionByName(foot))
    return out.select("file_id", "item_no", "material_code", "description", "quantity", "unit_price", "total_price")


# -- stored tables -------------------------------------------------------------------------------------

SQL_FILES = "SELECT CAST(o_orderkey AS STRING) AS file_id, CAST(o_orderkey % 3 AS STRING) AS version FROM {orders}"
SQL_CACHE = "SELECT CAST(o_orderkey AS STRING) AS file_id, CASE WHEN o_orderkey % 8 = 0 THEN 'old' ELSE CAST(o_orderkey % 3 AS STRING) END AS version, CASE WHEN o_orderkey % 10 = 0 THEN '4' ELSE '5' END AS extraction_version, CASE WHEN o_orderkey % 6 <> 0 THEN '11' END AS tax_id, '' AS phone FROM {orders} WHERE o_orderkey % 2 = 0"


@query(f"WITH f AS ({SQL_FILES}), c AS ({SQL_CACHE}) SELECT f.* FROM f ANTI JOIN (SELECT * FROM c WHERE extraction_version = '5' AND NOT (coalesce(tax_id, '') = '' AND phone = '')) v USING (file_id, version)")
def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    return store.incremental(bound(spark, d, SQL_FILES), bound(spark, d, SQL_CACHE))


SQL_UPSERT = """SELECT CONCAT('s', CAST(o_custkey % 500 AS STRING)) AS email, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('n', CAST(o_orderkey AS STRING)) ELSE '' END AS name,
  CAST(o_orderkey % 1000 AS BIGINT) AS amount, CONCAT('p', CAST(o_orderkey AS STRING)) AS phone, o_orderkey % 2 = 0 AS old FROM {orders}"""


@query(f"""WITH u AS ({SQL_UPSERT}) SELECT email, arg_min(name, seq) FILTER (name <> '') AS name, CAST(sum(amount) AS BIGINT) AS amount, arg_max(phone, seq) AS phone, max(seq) AS seq FROM u GROUP BY ALL""")
def upsert_fill_blank(spark: SparkSession, d: str) -> DataFrame:
    own = bound(spark, d, SQL_UPSERT)
    rules = {"name": "fill", "amount": "add", "phone": "last"}
    return store.upsert(own.filter("old").drop("old"), own.filter("not old").drop("old"), ["email"], rules)
