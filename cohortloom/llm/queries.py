"""The operators as queries over ``documents``, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm.byte_bpe import byte_bpe
from cohortloom.llm.common import documents
from cohortloom.llm.exact_dedup import exact_dedup
from cohortloom.llm.fill_in_middle import fill_in_middle_digests
from cohortloom.llm.importance_sample import importance_sample
from cohortloom.llm.license_scan import license_scan
from cohortloom.llm.packing import packed_pieces
from cohortloom.llm.pii import pii
from cohortloom.llm.quality_rules import quality_rules
from cohortloom.llm.simhash import simhash
from cohortloom.llm.source_mix import source_mix
from cohortloom.llm.suffix_dedup import suffix_dedup
from cohortloom.llm.token_counts import token_counts
from cohortloom.llm.token_files import token_files

JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda spark, sf: suffix_dedup(documents(spark, sf)),
    "op2_license_scan": lambda spark, sf: license_scan(documents(spark, sf)),
    "op3_token_files": lambda spark, sf: token_files(documents(spark, sf), JSON_FILE),
    "op4_exact_dedup": lambda spark, sf: exact_dedup(documents(spark, sf)),
    "op5_source_mix": lambda spark, sf: source_mix(documents(spark, sf)),
    "op6_token_counts": lambda spark, sf: token_counts(documents(spark, sf), JSON_FILE),
    "op7_quality_rules": lambda spark, sf: quality_rules(documents(spark, sf)),
    "op8_byte_bpe": lambda spark, sf: byte_bpe(documents(spark, sf), RANKS_FILE),
    "op9_simhash": lambda spark, sf: simhash(documents(spark, sf)),
    "op10_pii": lambda spark, sf: pii(documents(spark, sf)),
    "op11_fill_in_middle": lambda spark, sf: fill_in_middle_digests(documents(spark, sf)),
    "op12_packing": lambda spark, sf: packed_pieces(documents(spark, sf), JSON_FILE),
    "op13_importance_sample": lambda spark, sf: importance_sample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")),
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm""",
    "op5_source_mix": r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(sha256(text), 'null')), 1, 15) AS BIGINT) AS draw
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighted AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS most FROM totals),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(most) OVER filled, 0))
            / ((SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER filled, 0)) AS level
  FROM weighted
  WINDOW filled AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT first(level ORDER BY most / weight, source NULLS LAST) AS open_level FROM levels WHERE level * weight <= most),
targets AS (
  SELECT source, source_size, CASE WHEN open_level IS NULL OR open_level * weight > most THEN CAST(most AS DOUBLE) ELSE open_level * weight END AS target
  FROM levels, opened),
planned AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / greatest(source_size, 1)) END AS passes FROM targets),
goals AS (SELECT *, target - passes * source_size AS rest FROM planned),
parts AS (SELECT source, draw, sum(size) AS part FROM rows_ GROUP BY source, draw),
run AS (SELECT source, draw, part, sum(part) OVER (PARTITION BY source ORDER BY draw ROWS UNBOUNDED PRECEDING) AS upto FROM parts),
chosen AS (
  SELECT r.source, r.draw, r.upto <= g.rest OR (r.upto - r.part <= g.rest AND r.upto - g.rest < g.rest - (r.upto - r.part)) AS extra
  FROM run r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT r.doc_id, r.size, g.source_size, g.target,
       CAST(r.size * least(g.passes + CAST(c.extra AS INTEGER), 3) AS BIGINT) AS taken
FROM rows_ r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source AND r.draw = c.draw""",
    "op7_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS x FROM documents),
lists AS (SELECT rid, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
words AS (SELECT rid, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
grams AS (
  SELECT rid, pos, word || chr(32) || lead(word, 1) OVER w || chr(32) || lead(word, 2) OVER w || chr(32) || lead(word, 3) OVER w
         || chr(32) || lead(word, 4) OVER w AS gram
  FROM words WINDOW w AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) AS p FROM twice) GROUP BY rid),
lines0 AS (SELECT rid, source, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS pos FROM t),
lines AS (
  SELECT rid, source, line, pos, regexp_replace(regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))), '[0-9]', '0', 'g'),
                                                '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM lines0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sketches AS (
  SELECT rid, md5(string_agg(norm, chr(10) ORDER BY pos)) AS sketch, count(*) - count(DISTINCT line) AS n_dup, sum(length(line)) AS chars
  FROM lines GROUP BY rid),
common AS (
  SELECT l.source, l.norm FROM lines l JOIN sketches s ON l.rid = s.rid
  GROUP BY l.source, l.norm HAVING count(DISTINCT s.sketch) > 50),
lost AS (SELECT l.rid, sum(length(l.line)) AS lost FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY l.rid),
counts AS (
  SELECT t.rid, t.doc_id, CAST(len(l.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(l.ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t.x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(s.n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(s.chars, 0) AS chars, coalesce(o.lost, 0) AS lost
  FROM t JOIN lists l ON l.rid = t.rid LEFT JOIN sketches s ON s.rid = t.rid LEFT JOIN covered c ON c.rid = t.rid LEFT JOIN lost o ON o.rid = t.rid),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND chars - lost >= 0.1 * chars AS kept
FROM judged""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p""",
}
