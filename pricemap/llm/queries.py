"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricemap.llm import byte_cnn, decontamination, fingerprints, langid, merkle, packing, repetition, roles, separators, simhash, token_files, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.Capacity(tokens=2048))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(table(spark, sf_dir, "documents"))
    return found.drop("n_covered", "longest_repeat")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.format_chats(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"))).drop("siblings")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_role_repair": op6_role_repair,
    "op7_simhash": op7_simhash,
    "op8_language_evidence": op8_language_evidence,
    "op9_warc_captures": op9_warc_captures,
    "op10_separator_scan": op10_separator_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}


def _crc32(x: str) -> str:
    """SQL for the unsigned crc32 of the decimal ``x``, bit by bit."""
    digits = f"[CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST({x} AS VARCHAR), '')]"
    byte = "list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, z: xor(c // 2, 3988292384 * (c % 2)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, b: {byte}), 4294967295)"


def _leaf(n_chars: str) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM iw WHERE len(w) > 0)),
hits AS (
  SELECT r, k, n, item_id
  FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)) d
  JOIN wins USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op3_quality_rules": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
wins AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dw, (VALUES (5), (8), (51)) v(n) WHERE len(w) >= n)),
rep AS (SELECT r, n, k FROM (SELECT r, n, k, count(*) OVER (PARTITION BY r, n, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT r, n, count(DISTINCT p) AS c FROM (SELECT r, n, unnest(generate_series(k, k + n - 1)) AS p FROM rep) GROUP BY r, n),
lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM dw)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c5.c, 0) AS BIGINT) AS n_repeat_words,
         coalesce(c8.c, 0) AS c8, c51.c IS NOT NULL AS long_repeat
  FROM dw LEFT JOIN lines USING (r)
  LEFT JOIN (SELECT r, c FROM cov WHERE n = 5) c5 USING (r) LEFT JOIN (SELECT r, c FROM cov WHERE n = 8) c8 USING (r) LEFT JOIN (SELECT r, c FROM cov WHERE n = 51) c51 USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * c8 <= 30 * n_words AND NOT long_repeat AS kept
FROM m""",
    "op9_warc_captures": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS INT), 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
               CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS tampered
        FROM documents)),
n AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM d
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM n WHERE size > 1 GROUP BY tree, level, size, pos // 2),
t AS (
  SELECT tree AS of_tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS size FROM n WHERE size = 1
  UNION ALL
  SELECT NULL, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM t WHERE size > 1 GROUP BY level, size, pos // 2),
placed AS (SELECT d.*, t.pos AS t_pos, t.h AS subroot FROM d JOIN t ON t.of_tree = d.tree),
sib AS (
  SELECT a.r, 0 AS tier, l.level, (a.pos >> l.level) & 1 AS digit, s.h
  FROM placed a JOIN (SELECT DISTINCT tree, level FROM n WHERE size > 1) l USING (tree)
  LEFT JOIN n s ON s.tree = a.tree AND s.level = l.level AND s.pos = xor(a.pos >> l.level, 1)
  UNION ALL
  SELECT a.r, 1, l.level, (a.t_pos >> l.level) & 1, s.h
  FROM placed a CROSS JOIN (SELECT DISTINCT level FROM t WHERE size > 1) l LEFT JOIN t s ON s.level = l.level AND s.pos = xor(a.t_pos >> l.level, 1)),
paths AS (SELECT r, list({{'digit': digit, 'h': h}} ORDER BY tier, level) AS path, string_agg(h, '' ORDER BY tier, level) AS proof FROM sib GROUP BY r),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM t WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend({{'digit': CAST(0 AS BIGINT), 'h': coalesce(tampered, leaf)}}, coalesce(path, [])),
                     lambda a, b: {{'digit': CAST(0 AS BIGINT), 'h': CASE WHEN b.h IS NULL THEN sha256(a.h) WHEN b.digit = 1 THEN sha256(b.h || a.h) ELSE sha256(a.h || b.h) END}}).h AS folded_root
  FROM placed LEFT JOIN paths USING (r))
SELECT *, folded_root = root AS verified FROM f""",
    "op13_prefix_trie": f"""
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS rn
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS size FROM c GROUP BY conv_id),
conv AS (
  SELECT v.conv_id, v.h, v.conv_id - v.conv_id % 5 AS base, least(v.h, coalesce(b.size, 0)) AS head
  FROM (SELECT conv_id, {_crc32("conv_id")} % 9 AS h FROM sizes) v LEFT JOIN sizes b ON b.conv_id = v.conv_id - v.conv_id % 5),
built AS (
  SELECT v.conv_id, o.rn AS place, o.digest, o.bytes FROM conv v JOIN c o ON o.conv_id = v.base AND o.rn < v.h
  UNION ALL
  SELECT v.conv_id, v.head + o.rn - v.h, o.digest, o.bytes FROM conv v JOIN c o ON o.conv_id = v.conv_id AND o.rn >= v.h),
prefixes AS (
  SELECT conv_id, place + 1 AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place) AS k, bytes, count(*) OVER (PARTITION BY conv_id) AS len FROM built
  UNION ALL
  SELECT conv_id, 0, '', 0, coalesce(len, 0) FROM conv LEFT JOIN (SELECT conv_id, count(*) AS len FROM built GROUP BY conv_id) USING (conv_id)),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, k[1:32 * (depth - 1)] AS parent,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, k),
kids AS (SELECT parent AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth),
below AS (
  SELECT a AS depth, k[1:32 * a] AS k, sum(own) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT n.*, n_children, unnest(range(0, n.depth + 1)) AS a FROM nodes n LEFT JOIN kids USING (k, depth)) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k, depth) LEFT JOIN kids USING (k, depth) LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.parent AND p.depth = n.depth - 1""",
}
