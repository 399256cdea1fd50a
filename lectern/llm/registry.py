"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import encode_documents
from lectern.llm.common import table
from lectern.llm.ctw import score_texts
from lectern.llm.decontaminate import decontaminate
from lectern.llm.filters import audit_filters
from lectern.llm.html import extract_main_text
from lectern.llm.jaccard import link_documents
from lectern.llm.lines import drop_boilerplate
from lectern.llm.pii import replace_pii
from lectern.llm.quality import score_quality
from lectern.llm.spotsigs import compare_with_edited
from lectern.llm.toxicity import score_toxicity
from lectern.llm.turns import damaged, repair
from lectern.llm.warc import archived


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages"))
    return found.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=("n_words", "n_hit", "items"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "line_count", "removed_count", "text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), ids=conversations)


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_lines": op4_lines,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_html": op8_html,
    "op9_spotsigs": op9_spotsigs,
    "op10_toxicity": op10_toxicity,
    "op11_turns": op11_turns,
    "op12_filters": op12_filters,
    "op13_ctw": op13_ctw,
}

OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k
"""

OP2_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hit AS (
  SELECT r.doc_id, r.n, r.i, b.item_id FROM runs r JOIN win b ON r.n = b.n AND r.run = b.run
), hw AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""

OP4_SQL = """
WITH l AS (
  SELECT doc_id, source, i, raw, trim(raw, ' ') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), b AS (
  SELECT line, min(doc_id) AS keeper FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), k AS (
  SELECT l.doc_id, i, raw, b.line IS NULL OR l.doc_id = b.keeper AS kept FROM l LEFT JOIN b ON l.line = b.line
), g AS (
  SELECT doc_id, count(*) AS line_count, count(*) FILTER (WHERE NOT kept) AS removed_count, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE kept) AS body FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(line_count, 0) AS BIGINT) AS line_count, CAST(coalesce(removed_count, 0) AS BIGINT) AS removed_count,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(body, '') END AS text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM raw WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, time) AS i, regexp_replace(body, '[\\x20\\x09-\\x0D]+$', '') AS core, role[1] AS initial FROM d
), f AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY i) > 1 THEN 'duplicate' WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS total, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM o
), m(q, letters, r, fee, lines) AS (VALUES
  (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 3, 'user:\n'), (1, 'I', 2, 3, 'user:\n'), (2, 'I', 3, 3, 'assistant:\n'), (3, 'I', 2, 3, 'user:\n'),
  (0, 'II', 3, 6, 'user:\nassistant:\n'), (1, 'II', 3, 6, 'user:\nassistant:\n')
), e(q, letter, r, wants) AS (VALUES
  (0, 'D', 0, ''), (1, 'D', 1, ''), (2, 'D', 2, ''), (3, 'D', 3, ''), (0, 'R', 2, 'user'), (1, 'R', 2, 'user'), (2, 'R', 3, 'assistant'), (3, 'R', 2, 'user'),
  (0, 'K', 1, 's'), (0, 'K', 2, 'u'), (1, 'K', 2, 'u'), (2, 'K', 3, 'a'), (3, 'K', 2, 'u')
), p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS lines, total FROM f
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines, total FROM (
    SELECT p.conv_id, f.i, e.r AS q, p.total, p.cost + m.fee + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.letter <> 'D' AND f.fault IS NOT NULL THEN 3 ELSE 0 END AS cost, p.audit || m.letters || e.letter AS audit,
           p.lines || m.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'R' THEN e.wants || ':' || f.body || chr(10) ELSE f.role || ':' || f.body || chr(10) END AS lines
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN m ON m.q = p.q JOIN e ON e.q = m.r
    WHERE (e.letter = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (e.letter <> 'K' OR e.wants = f.initial)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
), best AS (
  SELECT conv_id, cost + fee AS cost, audit || letters AS audit, p.lines || m.lines AS lines FROM p JOIN m ON m.q = p.q
  WHERE i = total AND m.r IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + fee, audit || letters) = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, greatest(length(lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), f AS (
  SELECT part, doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY body) < doc_id, false) AS e
  FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM g GROUP BY ALL
), x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS filters FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), st AS (
  SELECT array_to_string(list_transform(filters, lambda y: 'ABCDE'[y]), '') AS filter_order, step, filters[step] AS i, filters[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, i, n, good, toxic, fails[i] AS fail, len(list_filter(earlier, lambda y: fails[y])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS alone FROM n, st
), agg AS (
  SELECT part, filter_order, step, i, sum(n) FILTER (WHERE NOT gone AND NOT fail) AS kept, sum(n) FILTER (WHERE NOT gone AND fail) AS removed, sum(n) FILTER (WHERE gone AND fail) AS redundant,
         sum(n) FILTER (WHERE fail AND alone) AS unique_fails, sum(n) FILTER (WHERE NOT gone AND fail AND good) AS good_lost, sum(n) FILTER (WHERE NOT gone AND fail AND toxic) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, i), 0) AS BIGINT) AS shapley
FROM agg
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_lines": OP4_SQL,
    "op11_turns": OP11_SQL,
    "op12_filters": OP12_SQL,
}
