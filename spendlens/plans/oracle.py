"""Reference SQL (DuckDB dialect) for every catalogue query, written independently
of the Spark code from the relation definitions of the fixtures.

Tables ``orders documents labels customer part`` are views over the same
parquet files. Column names and rounding match ``plans.catalog``.
"""

from __future__ import annotations

from spendlens.plans.catalog import (
    ABSENT_CODES,
    COLLATE_SPLIT_YEAR,
    FIXTURE_KEYWORDS,
    MAX_COST,
    SAMPLE_CODES,
    SAMPLE_SIZE,
    TAXONOMY_KEYWORDS,
)
from spendlens.plans import stage_queries
from spendlens.sources.dimensions import DEFAULT_SECTOR_NAMES
from spendlens.taxonomy import CONTINUUM, SUBSECTORS

TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


ACTIVITIES = """activities AS (
  SELECT o.o_orderkey AS activity_id,
         CAST(year(o.o_orderdate) AS INT) AS yr,
         o.o_totalprice AS amount,
         CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN '10' WHEN '2' THEN '21'
              WHEN '3' THEN '30' WHEN '4' THEN '40' ELSE '60' END AS category,
         CASE d.lang WHEN 'fr' THEN '16030' WHEN 'es' THEN '16040'
              WHEN 'de' THEN '43030' ELSE '11110' END AS purpose_code,
         d.text AS txt
  FROM orders o
  CROSS JOIN (SELECT count(*) AS nd FROM documents) z
  JOIN documents d ON d.doc_id = o.o_orderkey % z.nd)"""

LAB = """lab AS (
  SELECT txt, c1, c2, g, urban, rural FROM (
    SELECT d.text AS txt, l.quality = 1 AS c1, l.toxic = 1 AS c2, d.doc_id % 5 = 0 AS g,
           d.doc_id % 3 = 0 AS urban, d.doc_id % 4 = 0 AS rural,
           row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) AS rn
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id) x
  WHERE rn = 1)"""

M = """m AS (
  SELECT a.*, l.c1, l.c2, l.g, l.urban, l.rural,
         coalesce(a.purpose_code IN ('16030', '16040'), false) AS sector,
         (l.c1 OR l.c2 OR l.g) AS any_sans_sector,
         (l.c1 OR l.c2 OR l.g OR coalesce(a.purpose_code IN ('16030', '16040'), false)) AS any_flag
  FROM activities a LEFT JOIN lab l ON a.txt = l.txt)"""

SEL = """sel AS (SELECT * REPLACE ((NOT c1 AND NOT c2) AS g) FROM m WHERE any_flag)"""

BASE = f"WITH {ACTIVITIES},\n{LAB},\n{M},\n{SEL}\n"

ANY_CLASS = "count(CASE WHEN c1 THEN 1 END) + count(CASE WHEN c2 THEN 1 END) + count(CASE WHEN g THEN 1 END) > 0"

UNIQUE_DOCS = """u AS (
  SELECT doc_id, text FROM (
    SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) x
  WHERE rn = 1 AND length(trim(text)) > 0)"""


def _keyword_exprs(col: str) -> str:
    parts = []
    for cls, words in FIXTURE_KEYWORDS.items():
        cond = " OR ".join(f"contains(lower({col}), {_q(w.lower())})" for w in words)
        parts.append(f"({cond}) AS {cls}")
    return ", ".join(parts)


SECTORS = "sectors(code, name) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in DEFAULT_SECTOR_NAMES.items()) + ")"

REQUESTS = f"""firsts AS (
  SELECT activity_id, purpose_code, txt FROM (
    SELECT activity_id, purpose_code, txt, row_number() OVER (PARTITION BY txt ORDER BY activity_id) AS rn
    FROM activities) x
  WHERE rn = 1 AND length(trim(txt)) > 0),
{SECTORS},
req AS (
  SELECT f.activity_id, f.purpose_code, coalesce(s.name, '') AS sector_name,
         f.txt || chr(10) || 'Sector: ' || coalesce(s.name, '') AS user_message
  FROM firsts f LEFT JOIN sectors s ON s.code = f.purpose_code)"""


def _cost(tokens: str) -> str:
    return f"(CAST({tokens} AS DOUBLE) / 1e6 * 0.025 + CAST({tokens} AS DOUBLE) / 1e6 * 0.2)"


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _taxonomy_sel(t) -> str:
    """Keyword labels per distinct text, left-joined to every activity, marked, selected,
    residual overwritten."""
    kw = TAXONOMY_KEYWORDS[t.name]
    flags = []
    for c in t.vocabulary:
        words = kw.get(c, [])
        cond = " OR ".join(f"contains(lower(txt), {_q(w.lower())})" for w in words) or "false"
        flags.append(f"({cond}) AS {_ident(c)}")
    sector = f"coalesce(a.purpose_code IN ({_in(t.sector_codes)}), false)"
    any_cls = " OR ".join(f"l.{_ident(c)}" for c in t.classes)
    resid = " AND ".join(f"NOT {_ident(c)}" for c in t.specific)
    cols = ", ".join(f"l.{_ident(c)}" for c in t.vocabulary)
    return f"""WITH {ACTIVITIES},
tlab AS (SELECT DISTINCT txt, {", ".join(flags)} FROM activities WHERE length(trim(txt)) > 0),
tm AS (SELECT a.yr, a.amount, {cols}, ({any_cls} OR {sector}) AS any_flag
       FROM activities a LEFT JOIN tlab l ON a.txt = l.txt),
sel AS (SELECT * REPLACE (({resid}) AS {_ident(t.residual)}) FROM tm WHERE any_flag)
"""


def _class_having(t) -> str:
    return " + ".join(f"count(CASE WHEN {_ident(c)} THEN 1 END)" for c in t.classes) + " > 0"


def _continuum_spend() -> str:
    cols = ", ".join(f"round(sum(CASE WHEN {_ident(c)} THEN amount END), 2) AS {_ident(c)}" for c in CONTINUUM.classes)
    return _taxonomy_sel(CONTINUUM) + f"SELECT yr, {cols} FROM sel GROUP BY yr HAVING {_class_having(CONTINUUM)}"


def _subsector_share() -> str:
    cols = ", ".join(f"round(sum(CASE WHEN {_ident(c)} THEN amount END) / sum(amount), 9) AS {_ident(c)}" for c in SUBSECTORS.classes)
    return _taxonomy_sel(SUBSECTORS) + f"SELECT yr, {cols} FROM sel GROUP BY yr HAVING {_class_having(SUBSECTORS)}"


def _continuum_share() -> str:
    cols = ", ".join(f"round(sum(CASE WHEN {_ident(c)} THEN amount END) / sum(amount), 9) AS {_ident(c)}" for c in CONTINUUM.classes)
    return _taxonomy_sel(CONTINUUM) + f"SELECT yr, {cols} FROM sel GROUP BY yr HAVING {_class_having(CONTINUUM)}"


def _subsector_location() -> str:
    u, r = (_ident(c) for c in SUBSECTORS.locations)
    return _taxonomy_sel(SUBSECTORS) + f"""SELECT yr, round(su / (coalesce(su, 0) + coalesce(sr, 0)), 9) AS {u},
       round(sr / (coalesce(su, 0) + coalesce(sr, 0)), 9) AS {r}
FROM (SELECT yr, sum(CASE WHEN {u} THEN amount END) AS su, sum(CASE WHEN {r} THEN amount END) AS sr
      FROM sel GROUP BY yr) t
WHERE su IS NOT NULL OR sr IS NOT NULL"""


ORACLE: dict[str, str] = {
    "positive_amount": "SELECT * FROM customer WHERE c_acctbal > 0",
    "collate_years": f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN year(o_orderdate) < {COLLATE_SPLIT_YEAR} THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(year(o_orderdate) AS INT) AS "Year"
FROM orders WHERE o_totalprice > 0""",
    "land_yearly": """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS "Year", o_totalprice FROM orders WHERE o_totalprice > 0""",
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "activity_text": """
WITH tp AS (
  SELECT p_partkey AS id, p_brand AS title,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS short_text,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS long_text
  FROM part),
s1 AS (SELECT id, title, short_text, coalesce(long_text, '') AS t FROM tp),
s2 AS (SELECT id, title,
              CASE WHEN coalesce(short_text, '') <> '' AND NOT contains(lower(t), lower(short_text))
                   THEN short_text || ' ' || t ELSE t END AS t FROM s1),
s3 AS (SELECT id,
              CASE WHEN coalesce(title, '') <> '' AND NOT contains(lower(t), lower(title))
                   THEN title || ' ' || t ELSE t END AS t FROM s2)
SELECT id, trim(t) AS text FROM s3""",
    "unicode_strip": "SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n_len FROM documents",
    "keep_first_text": """
SELECT doc_id, lang, text_key FROM (
  SELECT doc_id, lang, sha256(text) AS text_key,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents) x
WHERE rn = 1""",
    "prepare_funnel": """
WITH t AS (SELECT CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS txt FROM documents)
SELECT count(*) AS n_start,
       count(*) - count(DISTINCT txt) AS n_duplicates,
       count(DISTINCT CASE WHEN txt = '' THEN txt END) AS n_blank,
       count(DISTINCT txt) - count(DISTINCT CASE WHEN txt = '' THEN txt END) AS n_end
FROM t""",
    "token_cost": f"""
WITH {UNIQUE_DOCS},
t AS (SELECT count(*) AS n_texts,
             CAST(coalesce(sum(len(regexp_extract_all(text, {_q(TOKEN)}))), 0) AS BIGINT) AS n_tokens
      FROM u)
SELECT n_texts, n_tokens, n_tokens AS input_tokens, n_tokens AS output_tokens,
       round({_cost('n_tokens')}, 6) AS est_cost
FROM t""",
    "bpe_token_count": f"WITH {UNIQUE_DOCS}\nSELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens FROM u",
    "request_rows": f"""
WITH {ACTIVITIES},
{REQUESTS}
SELECT activity_id, purpose_code, sector_name, user_message FROM req""",
    "budget_gate": f"""
WITH {ACTIVITIES},
{REQUESTS},
t AS (SELECT count(*) AS n_requests,
             CAST(coalesce(sum(len(regexp_extract_all({_q(CONTINUUM.system_prompt())}, {_q(TOKEN)}))
                               + len(regexp_extract_all(user_message, {_q(TOKEN)}))), 0) AS BIGINT) AS input_tokens
      FROM req)
SELECT n_requests, input_tokens, input_tokens AS output_tokens,
       round({_cost('input_tokens')}, 6) AS est_cost,
       {_cost('input_tokens')} <= {MAX_COST} AS within_budget
FROM t""",
    "code_sample": f"""
WITH {ACTIVITIES}
SELECT * FROM (
  (SELECT 'hit' AS sample_case, activity_id, purpose_code FROM activities
   WHERE trim(purpose_code) IN ({_in(SAMPLE_CODES)}) ORDER BY activity_id LIMIT {SAMPLE_SIZE})
  UNION ALL
  (SELECT 'fallback' AS sample_case, activity_id, purpose_code FROM activities
   WHERE (SELECT count(*) FROM activities WHERE trim(purpose_code) IN ({_in(ABSENT_CODES)})) = 0
   ORDER BY activity_id LIMIT {SAMPLE_SIZE})) s""",
    "parse_labels": """
SELECT d.doc_id,
       CASE WHEN d.doc_id % 17 = 0 THEN 'malformed' WHEN d.doc_id % 10 = 0 THEN 'unknown_class' ELSE 'ok' END AS status,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE 's' END AS summary,
       CASE WHEN d.doc_id % 17 = 0 OR d.doc_id % 10 = 0 THEN NULL
            ELSE CAST(l.quality = 1 AS INTEGER) + CAST(l.toxic = 1 AS INTEGER) END AS n_classes
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "multi_hot": """
SELECT doc_id,
       CASE WHEN ok THEN quality = 1 END AS c1,
       CASE WHEN ok THEN toxic = 1 END AS c2,
       CASE WHEN ok THEN false END AS g,
       CASE WHEN ok THEN false END AS urban,
       CASE WHEN ok THEN false END AS rural
FROM (SELECT d.doc_id, l.quality, l.toxic, NOT (d.doc_id % 17 = 0 OR d.doc_id % 10 = 0) AS ok
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id) x""",
    "keyword_label": f"WITH {UNIQUE_DOCS}\nSELECT doc_id, {_keyword_exprs('text')} FROM u",
    "label_job": f"WITH {UNIQUE_DOCS}\nSELECT doc_id, {_keyword_exprs('text')}, 'ok' AS status FROM u",
    # the message a model gets is the text and 9 characters of the sector line
    "label_resume": f"""
WITH {UNIQUE_DOCS}
SELECT doc_id, {_keyword_exprs('text')},
       CAST(CASE WHEN (length(text) + 9) % 5 = 0 THEN 2 ELSE 1 END AS INT) AS tries,
       CAST(CASE WHEN (length(text) + 9) % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_quarantined
FROM u""",
    "unprocessed": f"""
WITH {UNIQUE_DOCS},
done AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, sha256(text) AS text_key FROM u
WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.text = u.text)""",
    "incremental_label": f"""
SELECT DISTINCT sha256(text) AS text_key, {_keyword_exprs('text')}
FROM documents WHERE length(trim(text)) > 0""",
    "labels_unique": f"WITH {LAB}\nSELECT sha256(txt) AS text_key, c1, c2, g, urban, rural FROM lab",
    "attach_labels": f"""
WITH {ACTIVITIES},
{LAB}
SELECT a.activity_id, l.c1, l.c2, l.g, l.urban, l.rural
FROM activities a LEFT JOIN lab l ON a.txt = l.txt""",
    "attach_labels_salted": f"""
WITH {ACTIVITIES},
{LAB}
SELECT a.activity_id, l.c1, l.c2, l.g, l.urban, l.rural
FROM activities a LEFT JOIN lab l ON a.txt = l.txt""",
    "marker_flags": BASE + "SELECT activity_id, sector, any_sans_sector, any_flag, (NOT c1 AND NOT c2) AS resid FROM m",
    "false_negatives": BASE + "SELECT activity_id, yr, amount, purpose_code FROM m WHERE sector AND NOT any_sans_sector",
    "selection_summary": BASE + """
SELECT count(*) AS n_all,
       count(CASE WHEN any_flag THEN 1 END) AS n_selected,
       round(count(CASE WHEN any_flag THEN 1 END) / count(*), 9) AS selection_rate,
       round(sum(CASE WHEN any_flag THEN amount END), 2) AS selected_amount,
       count(CASE WHEN any_flag AND any_sans_sector IS NULL THEN 1 END) AS n_unlabelled_selected,
       count(CASE WHEN sector AND NOT any_sans_sector THEN 1 END) AS n_false_negative
FROM m""",
    "spend_by_class": BASE + f"""
SELECT yr,
       round(sum(CASE WHEN c1 THEN amount END), 2) AS c1,
       round(sum(CASE WHEN c2 THEN amount END), 2) AS c2,
       round(sum(CASE WHEN g THEN amount END), 2) AS g
FROM sel GROUP BY yr HAVING {ANY_CLASS}""",
    "class_share": BASE + f"""
SELECT yr,
       round(sum(CASE WHEN c1 THEN amount END) / sum(amount), 9) AS c1,
       round(sum(CASE WHEN c2 THEN amount END) / sum(amount), 9) AS c2,
       round(sum(CASE WHEN g THEN amount END) / sum(amount), 9) AS g
FROM sel GROUP BY yr HAVING {ANY_CLASS}""",
    "stack_total": BASE + f"""
SELECT yr,
       round(coalesce(sum(CASE WHEN c1 THEN amount END) / sum(amount), 0)
           + coalesce(sum(CASE WHEN c2 THEN amount END) / sum(amount), 0)
           + coalesce(sum(CASE WHEN g THEN amount END) / sum(amount), 0), 9) AS stack_total
FROM sel GROUP BY yr HAVING {ANY_CLASS}""",
    "spend_long": BASE + """,
long AS (SELECT yr, 'c1' AS variable, amount FROM sel WHERE c1
         UNION ALL SELECT yr, 'c2' AS variable, amount FROM sel WHERE c2
         UNION ALL SELECT yr, 'g' AS variable, amount FROM sel WHERE g),
agg AS (SELECT yr, variable, sum(amount) AS s FROM long GROUP BY yr, variable),
tot AS (SELECT yr, sum(amount) AS t FROM sel GROUP BY yr)
SELECT agg.yr AS yr, variable, round(s, 2) AS amount, round(t, 2) AS total, round(s / t, 9) AS share
FROM agg JOIN tot ON agg.yr = tot.yr""",
    "spend_by_group": BASE + """
SELECT yr,
       round(sum(CASE WHEN category = '10' THEN amount END), 2) AS "ODA",
       round(sum(CASE WHEN category = '21' THEN amount END), 2) AS "OOF",
       round(sum(CASE WHEN category IN ('30', '60') THEN amount END), 2) AS "Private",
       round(sum(CASE WHEN category IS NULL OR category NOT IN ('10', '21', '30', '60') THEN amount END), 2) AS unmapped
FROM sel GROUP BY yr""",
    "location_share": BASE + """
SELECT yr, round(u / (coalesce(u, 0) + coalesce(r, 0)), 9) AS urban,
       round(r / (coalesce(u, 0) + coalesce(r, 0)), 9) AS rural
FROM (SELECT yr, sum(CASE WHEN urban THEN amount END) AS u, sum(CASE WHEN rural THEN amount END) AS r
      FROM sel GROUP BY yr) t
WHERE u IS NOT NULL OR r IS NOT NULL""",
    "sum_strict": """
WITH t AS (
  SELECT CAST(year(o_orderdate) AS INT) AS yr,
         CASE WHEN o_orderkey % 97 = 0 AND year(o_orderdate) % 2 = 0 THEN NULL ELSE o_totalprice END AS amount
  FROM orders)
SELECT yr,
       round(CASE WHEN count(amount) = count(*) THEN sum(amount) END, 2) AS strict_sum,
       round(coalesce(sum(amount), 0), 2) AS lenient_sum,
       count(*) - count(amount) AS n_null
FROM t GROUP BY yr""",
    "spend_pivot": BASE + f"""
SELECT yr,
       round(sum(CASE WHEN c1 THEN amount END), 2) AS c1,
       round(sum(CASE WHEN c2 THEN amount END), 2) AS c2,
       round(sum(CASE WHEN g THEN amount END), 2) AS g
FROM sel GROUP BY yr HAVING {ANY_CLASS}""",
    "continuum_class_spend": _continuum_spend(),
    "staged_continuum_share": _continuum_share(),
    "subsector_class_share": _subsector_share(),
    "subsector_location_share": _subsector_location(),
    **stage_queries.oracle(BASE, ACTIVITIES, LAB, TOKEN, _cost),
}
ORACLE["spend_melted"] = ORACLE["spend_long"]
