"""Queries of the training-data operators: each applies its operator, with production
parameters, to its whole table. ``ORACLE`` has SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendlens.llm.byte_bpe import op3_byte_bpe
from spendlens.llm.chat import op9_chat
from spendlens.llm.classifier import op6_quality_classifier
from spendlens.llm.common import table
from spendlens.llm.fingerprints import fingerprint_groups, op8_fingerprints
from spendlens.llm.html_extract import op10_html
from spendlens.llm.licenses import op13_license_scans
from spendlens.llm.lm import op7_lm_scores
from spendlens.llm.minhash import op5_near_duplicates
from spendlens.llm.packing import op4_packing
from spendlens.llm.quality_rules import op2_quality_rules
from spendlens.llm.runs import op12_word_runs
from spendlens.llm.search import op11_ranked_search
from spendlens.llm.sharding import op1_sharding


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sharding(table(spark, sf_dir, "documents"))


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_near_duplicates(table(spark, sf_dir, "documents"))


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_lm_scores(table(spark, sf_dir, "documents"))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_fingerprints(table(spark, sf_dir, "documents"))


def q_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op8: groups of near texts by banded, verified fingerprints."""
    return fingerprint_groups(table(spark, sf_dir, "documents"))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_chat(table(spark, sf_dir, "conversations"))


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html(table(spark, sf_dir, "pages"))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_word_runs(table(spark, sf_dir, "documents"))


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_license_scans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": q_op1,
    "op2_quality_rules": q_op2,
    "op3_byte_bpe": q_op3,
    "op4_packing": q_op4,
    "op5_near_duplicates": q_op5,
    "op6_quality_classifier": q_op6,
    "op7_lm_scores": q_op7,
    "op8_fingerprints": q_op8,
    "fingerprint_groups": q_fingerprint_groups,
    "op9_chat": q_op9,
    "op10_html": q_op10,
    "op11_ranked_search": q_op11,
    "op12_word_runs": q_op12,
    "op13_license_scans": q_op13,
}

ORACLE: dict[str, str] = {
    "op5_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
win AS (
  SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
full_sets AS (SELECT doc_id, list_sort(list(DISTINCT shingle)) AS shingles FROM win WHERE i <= greatest(n - 4, 1) GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(shingles, []) AS shingles FROM documents LEFT JOIN full_sets USING (doc_id)),
class AS (SELECT shingles, min(doc_id) AS rep, CAST(len(shingles) AS BIGINT) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
place AS (SELECT rep, n, unnest(shingles) AS shingle FROM class),
link AS (
  SELECT a.rep AS x, b.rep AS y FROM place a JOIN place b
    ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT rep, rep AS other FROM class
  UNION
  SELECT reach.rep, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other),
component AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep),
named AS (SELECT class.shingles, component.component_id FROM class JOIN component ON class.rep = component.rep)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id,
       coalesce(named.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN named ON s.shingles = named.shingles""",
    "op9_chat": r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
         sum(length('### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': ' || regexp_replace(text, '([\\#<])', '\\\1', 'g') || ' </turn>' || chr(10))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM g""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
z AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d1),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d1) t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, z GROUP BY term, big_n),
s AS (
  SELECT q.item_id, p.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * z.big_n) // z.big_l)))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term CROSS JOIN z
  GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) r
WHERE rank <= 50""",
}
