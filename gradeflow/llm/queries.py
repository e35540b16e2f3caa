"""Registered queries of the corpus operators and their DuckDB SQL.

Operators with learned scores, links, merges or files have no SQL form; they
are held against plain versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeflow.llm import (bpe, decontam, html_text, lm, prefix_trie, quality, repair, secret_scan, simhash, suffix_dedup,
                           token_shards, toxicity, warc)
from gradeflow.llm.common import shared_folder, table

VOCABULARY = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                       shared_folder(spark, "token-shards"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(table(spark, sf_dir, "pages"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_of_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_token_shards, op3_bpe, op4_simhash, op5_quality, op6_lm, op7_secrets, op8_toxicity,
    op9_decontaminate, op10_revisits, op11_html_text, op12_repair, op13_prefix_trie)}

_CANONICAL = r"""
regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
|| regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(/[^?]*)', 1), '/index\.html?$', '/'), '/+$', '')
|| CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END
"""

def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII expression, bit by bit."""
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), "
            "lambda c: ascii(c)::UBIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)")


def _repair_sql() -> str:
    """The cheapest edits by levels; a state's key is its cost in nine digits followed by its audit, so that the
    least string is the cheapest, ASCII-least one."""
    def edit(key: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"

    none = "'900000000'"

    def inserted(source: str) -> str:
        return (f"SELECT conv, i, st, sy, u1 AS u, least(a, {edit('u1', '2', 'I')}) AS a FROM (SELECT *, "
                f"least(u, {edit('st', '2', 'I')}, {edit('sy', '2', 'I')}, {edit('a', '2', 'I')}) AS u1 FROM ({source}) x0) x1")

    def written(key: str, letter: str) -> str:
        return (f"CASE WHEN r.fault IN ('blank', 'duplicate') THEN {none} WHEN r.letter = '{letter}' "
                f"THEN least({edit(key, 'r.stays', 'K')}, {edit(key, '2 + r.stays', 'R')}) ELSE {edit(key, '2 + r.stays', 'R')} END")
    step = f"""SELECT w.conv, r.i, {edit('w.st', '3', 'D')} AS st,
      least({edit('w.sy', '3', 'D')}, CASE WHEN r.letter = 's' AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate')
        THEN {edit('w.st', 'r.stays', 'K')} ELSE {none} END) AS sy,
      least({edit('w.u', '3', 'D')}, {written('least(w.st, w.sy, w.a)', 'u')}) AS u,
      least({edit('w.a', '3', 'D')}, {written('w.u', 'a')}) AS a
    FROM walk w JOIN r ON r.conv IS NOT DISTINCT FROM w.conv AND r.i = w.i + 1"""
    return rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id AS conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
  FROM hit, (SELECT unnest([0, 1]) AS n) c WHERE d <> 0 AND (n = 0 OR d = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, n) AS i FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS letter,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' END AS fault FROM placed),
r AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS stays,
    CASE WHEN lag(letter) OVER (PARTITION BY conv ORDER BY i) || letter IN ('su', 'ua', 'au') THEN 0
      WHEN i = 1 THEN 0 ELSE 1 END AS illegal FROM marked),
walk AS (
  {inserted(f"SELECT DISTINCT conv_id AS conv, CAST(0 AS BIGINT) AS i, '000000000' AS st, {none} AS sy, {none} AS u, {none} AS a FROM conversations")}
  UNION ALL
  {inserted(step)}),
found AS (
  SELECT conv, CAST(substr(k, 1, 9) AS BIGINT) AS cost, substr(k, 10) AS audit FROM (
    SELECT conv, least(st, a) AS k FROM walk QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1) x),
letters AS (
  SELECT conv, p, substr(audit, p, 1) AS e, p - length(replace(substr(audit, 1, p), 'I', '')) AS n_in,
    length(replace(substr(audit, 1, p), 'D', '')) AS q
  FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS p FROM found) x),
opens AS (
  SELECT l.conv, max(CASE WHEN l.q = 1 AND l.e = 'K' AND r.letter = 's' THEN 1 ELSE 0 END) AS s
  FROM letters l JOIN r ON r.conv IS NOT DISTINCT FROM l.conv AND r.i = l.p - l.n_in WHERE l.e <> 'D' GROUP BY l.conv),
repaired AS (
  SELECT l.conv, string_agg(CASE WHEN l.e = 'K' THEN r.role WHEN (l.q - coalesce(o.s, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN l.e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY l.p) AS body
  FROM letters l LEFT JOIN r ON r.conv IS NOT DISTINCT FROM l.conv AND r.i = l.p - l.n_in
  LEFT JOIN opens o ON o.conv IS NOT DISTINCT FROM l.conv WHERE l.e <> 'D' GROUP BY l.conv),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    CAST(sum(illegal) AS BIGINT) AS illegal FROM r GROUP BY conv)
SELECT f.conv AS conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, f.cost, f.audit,
  sha256(coalesce(p.body, '')) AS repaired_sha256
FROM found f LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM f.conv LEFT JOIN repaired p ON p.conv IS NOT DISTINCT FROM f.conv
"""


def _trie_sql() -> str:
    return rf"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM own) x),
rebuilt AS (
  SELECT k.c, 0 AS part, o.i, o.role, o.text FROM convs k JOIN own o ON o.c = k.c - k.c % 100 AND o.i < k.h
  UNION ALL SELECT k.c, 1, o.i, o.role, o.text FROM convs k JOIN own o ON o.c = k.c AND o.i >= k.h),
placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth, length(text) AS chars,
    string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY part, i) AS node FROM rebuilt),
chains AS (
  SELECT c, 0 AS depth, '' AS node, NULL AS parent, 0 AS chars FROM convs
  UNION ALL SELECT c, depth, node, left(node, length(node) - 32), chars FROM placed),
nodes AS (
  SELECT node, min(c) AS rep, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n
  FROM chains GROUP BY node),
kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
trees AS (
  SELECT ch.node, sum((b.n - 1) * b.chars) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes b JOIN chains ch ON ch.c = b.rep AND ch.depth <= b.depth LEFT JOIN kids k ON k.parent = b.node GROUP BY ch.node),
ends AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT * FROM chains QUALIFY depth = max(depth) OVER (PARTITION BY c)) x GROUP BY node)
SELECT n.rep AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.rep AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
  CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN trees t ON t.node = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.parent = n.node
LEFT JOIN ends e ON e.node = n.node
"""


ORACLE_SQL: dict[str, str] = {"op10_revisits": rf"""
WITH p AS (
  SELECT page_id AS i, url, md5(coalesce(html, '')) AS d, 1600000000 + page_id * 131 AS modified FROM pages
  WHERE page_id IS NOT NULL),
captures AS (
  SELECT i * 2 AS record_id, true AS response, url AS uri, 1700000000 + (i * 7919) % 864000 AS at, i, d, modified FROM p
  UNION ALL
  SELECT i * 2 + 1, false, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
    || 'utm_source=again#seen', 1700000000 + (i * 7919) % 864000 + 3600 + (i * 104729) % 500000, i, d, modified FROM p),
cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM captures),
split AS (
  SELECT *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=?')) AS params FROM cut),
r AS (SELECT *, {_CANONICAL} AS u FROM split),
matched AS (
  SELECT a.record_id, a.u AS canonical, a.i, a.d, a.modified, b.record_id AS match, b.i AS bi, b.d AS bd, b.modified AS bm
  FROM r a LEFT JOIN r b ON b.response AND b.i % 11 <> 0 AND a.u = b.u
    AND (b.at < a.at OR b.at = a.at AND b.record_id < a.record_id)
  WHERE NOT a.response
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY b.at DESC NULLS LAST, b.record_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN match IS NULL THEN 'no_response'
    WHEN CASE WHEN i % 5 = 0 THEN modified = bm WHEN i % 7 = 0 THEN false ELSE left(d, 16) = left(bd, 16) END
    THEN 'resolved' ELSE 'validator_mismatch' END AS resolution FROM matched)
SELECT record_id, canonical, resolution, CASE WHEN resolution = 'resolved' THEN match END AS resolved_id,
  CASE WHEN resolution = 'resolved' THEN bd END AS digest,
  CASE WHEN resolution = 'resolved' THEN
    CASE WHEN i % 5 = 0 THEN
      'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || i || chr(10)
      || 'etag: "' || left(bd, 16) || '"' || chr(10) || 'last-modified: ' || modified
    ELSE
      'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || i || chr(10)
      || 'etag: W/"' || left(d, 16) || '"' || chr(10) || 'last-modified: ' || bm END END AS merged_headers
FROM judged
""",
    "op12_repair": _repair_sql(), "op13_prefix_trie": _trie_sql()}
