"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quirespark.llm.exact_dedup import ORACLE_OP5
from quirespark.llm.licenses import ORACLE_OP2
from quirespark.llm.mixing import ORACLE_OP4
from quirespark.llm.quality import ORACLE_OP8
from quirespark.llm.url_filter import ORACLE_OP10

_LINES = r"""
WITH l AS (
  SELECT d.row_no, d.doc_id, u.n, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, row_number() OVER () AS row_no FROM documents) d,
       LATERAL (SELECT unnest(d.a) AS line, unnest(range(len(d.a))) AS n) u),
k AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT row_no, doc_id, key FROM l WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_no, doc_id
"""

ORACLES = {"op2_licenses": ORACLE_OP2, "op8_quality": ORACLE_OP8, "op10_url_filter": ORACLE_OP10, "op4_mixing": ORACLE_OP4, "op5_exact_dedup": ORACLE_OP5, "op7_line_dedup": _LINES}
