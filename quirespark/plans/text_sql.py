"""DuckDB SQL of queries whose Spark side runs state machines over characters and lines, and of page rendering.

The machines are written as replacements and windows over lines, not as
machines. Where a rule needs text that no table holds (display formulas on lines
of their own, wrapped LaTeX commands), the SQL leaves it out and says so; unit
tests hold those rules.
"""

from __future__ import annotations

from quirespark.plans import page_queries
from quirespark.plans.inputs import BOXES, HYPHENS

SQL: dict[str, str] = {}
_WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_END = r".,!?;:)\]}"


def _g(x: str, found: str, put: str) -> str:
    return f"regexp_replace({x}, '{found}', '{put}', 'g')"


def _strip(x: str) -> str:
    return _g(x, f"^[{_WS}]+|[{_WS}]+$", "")


def _prose(x: str) -> str:
    """Words parted (passes whose matches share a letter run twice), then blanks and closing punctuation in runs."""
    x = _g(x, "(''[a-z])([a-z])", r"\1 \2")
    for found in ("([a-z])([A-Z][a-z])", "([A-Za-z])([0-9][A-Za-z])"):
        x = _g(_g(x, found, r"\1 \2"), found, r"\1 \2")
    x = _g(x, "([0-9%])([A-Z])", r"\1 \2")
    # a stop after a letter or digit, or a blank, opens a run: its last closing mark stands for the run
    x = _g(x, f"^[{_WS}]+", "")
    x = _g(x, rf"([A-Za-z0-9])\.[{_WS}{_END}]*([{_END}])[{_WS}]*", r"\1\2")
    x = _g(x, rf"([A-Za-z0-9])\.[{_WS}]+", r"\1.")
    x = _g(x, f"[{_WS}][{_WS}{_END}]*([{_END}])[{_WS}]*", r"\1")
    return _g(x, f"[{_WS}]+", " ")


# pieces between breaks after a hyphen; a break goes if a small letter follows and no address is near
_UNHYPHENED = """p AS (SELECT doc_id, text, unnest(string_split(text, '-' || chr(10))) AS piece, generate_subscripts(string_split(text, '-' || chr(10)), 1) AS n FROM texts),
q AS (SELECT *, lead(piece) OVER w AS after, sum(length(piece) + 2) OVER w - 2 AS s FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT doc_id, string_agg(piece || CASE WHEN after IS NULL THEN '' WHEN regexp_matches(after, '^[a-z]') AND NOT regexp_matches(text[greatest(CAST(s AS BIGINT) - 10, 0) + 1:CAST(s AS BIGINT) + 5], 'http|www|://') THEN '' ELSE '-' || chr(10) END, '' ORDER BY n) AS text FROM q GROUP BY doc_id)"""
SQL["postprocess_lines"] = f"WITH {HYPHENS}, {_UNHYPHENED} SELECT doc_id, {_prose('text')} AS text FROM h"


def _markdown(source: str, col: str) -> str:
    """Lines cleaned; no table has a line that is a display formula's mark, so those rules are left out."""
    return f"""{source}, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS c FROM texts),
l1 AS (SELECT doc_id, n, {_g('line', chr(13) + '$', '')} AS line FROM l0 WHERE NOT (n = c AND line = '')),
l2 AS (SELECT *, {_strip('line')} AS t, max(line <> '') OVER (PARTITION BY doc_id ORDER BY n) AS begun FROM l1),
l3 AS (SELECT *, starts_with(t, '**') AND ends_with(t, '**') AND strlen(t) > 4 AS head FROM l2 WHERE begun),
l4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head, t ORDER BY n) AS again FROM l3),
l5 AS (SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS code FROM l4 WHERE NOT head OR again = 1),
l6 AS (SELECT doc_id, string_agg(CASE WHEN code OR starts_with(t, '```') OR regexp_matches(t, '^[#*>|+-]') THEN line ELSE {_prose('line')} END || chr(10), '' ORDER BY n) AS text FROM l5 GROUP BY doc_id)
SELECT texts.doc_id, coalesce(l6.text, '') AS {col} FROM texts LEFT JOIN l6 ON texts.doc_id = l6.doc_id"""


SQL["postprocess_markdown"] = _markdown(f"WITH {HYPHENS}", "text")

_JOINED = page_queries.SQL["joined_documents"]
SQL["document_markdown"] = _markdown(f"WITH texts AS (SELECT doc_id, markdown AS text FROM ({_JOINED}))", "markdown")

# single dollar signs pair up; what stands between a pair is stripped
SQL["parsed_text"] = rf"""WITH {HYPHENS}, a AS (SELECT doc_id, replace(replace(replace(replace(text, '-<|sn|>', ''), '<|sn|>', ' '), '<|unk|>', ''), chr(65535), '') AS text FROM texts),
b AS (SELECT doc_id, CASE WHEN contains(text, '\(') AND contains(text, '\)') THEN replace(replace(text, '\(', ' $ '), '\)', ' $ ') ELSE text END AS text FROM a),
c AS (SELECT doc_id, replace(CASE WHEN contains(text, '\[') AND contains(text, '\]') THEN replace(replace(text, '\[', ' $$ '), '\]', ' $$ ') ELSE text END, '$\bullet$', '•') AS text FROM b),
d AS (SELECT doc_id, CASE WHEN contains(text, '<table>') THEN regexp_replace(text, '</?(table|thead|tbody|tfoot|tr|td|th)[^>]*>', '', 'g') ELSE text END AS text FROM c),
e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)[^$]+|\$+')) AS x, generate_subscripts(regexp_extract_all(text, '(?s)[^$]+|\$+'), 1) AS n FROM d),
f AS (SELECT *, sum(CASE WHEN x = '$' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS seg, sum(CASE WHEN x = '$' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS marks FROM e),
g AS (SELECT doc_id, seg, any_value(marks) AS marks, coalesce(string_agg(x, '' ORDER BY n) FILTER (x <> '$'), '') AS x FROM f GROUP BY doc_id, seg),
h AS (SELECT doc_id, string_agg(CASE WHEN seg > 0 THEN '$' ELSE '' END || CASE WHEN seg % 2 = 1 AND seg < marks THEN {_strip('x')} ELSE x END, '' ORDER BY seg) AS text FROM g GROUP BY doc_id)
SELECT d.doc_id, {_strip(_g(_g(_g(_g("coalesce(h.text, '')", ' +', ' '), ' ([,.;:!?)])', chr(92) + '1'), '_{4,}', '___'), chr(92) + '.{4,}', '...'))} AS text FROM d LEFT JOIN h ON d.doc_id = h.doc_id"""

# the shortest period of up to 200 that ends a long text five times; its first copy and what the last one left stay
SQL["tail_cut_text"] = f"""WITH {HYPHENS}, b AS (SELECT doc_id, text, length(text) AS n FROM texts), t AS (SELECT doc_id, text, n, unnest(range(1, 201)) AS k FROM b WHERE n >= 8000),
f AS (SELECT doc_id, text, n, min(k) AS k FROM t WHERE text[n - greatest(4 * k, 100 - k, 1) + 1:n] = text[n - greatest(4 * k, 100 - k, 1) - k + 1:n - k] GROUP BY doc_id, text, n),
w AS (SELECT doc_id, text, n, k, k + coalesce(list_position(list_transform(range(0, n - k), lambda i: text[n - i] <> text[n - i - k]), true) - 1, n - k) AS whole FROM f)
SELECT b.doc_id, CASE WHEN w.k IS NULL THEN b.text ELSE b.text[1:b.n - whole + k] || CASE WHEN whole % k > 0 THEN b.text[b.n - whole % k + 1:] ELSE '' END END AS text FROM b LEFT JOIN w ON b.doc_id = w.doc_id"""

# blanks that mathematics ignores, in two rounds; no document wraps words in a LaTeX command
_LATEX = "replace(text, chr(34), '')"
for _ in range(2):
    _LATEX = _g(_LATEX, rf"(\\ )[{_WS}]+([^{_WS}])", r"\1\2")
    _LATEX = _g(_LATEX, rf"([^A-Za-z\\{_WS}])[{_WS}]+([^{_WS}])", r"\1\2")
    _LATEX = _g(_LATEX, rf"([^A-Za-z\\{_WS}])[{_WS}]+([^{_WS}])", r"\1\2")
    _LATEX = _g(_LATEX, rf"([A-Za-z][{_WS}])[{_WS}]+([^{_WS}])", r"\1\2")
    _LATEX = _g(_LATEX, rf"([A-Za-z])[{_WS}]+([^A-Za-z{_WS}])", r"\1\2")
SQL["latex_text"] = f"WITH {HYPHENS} SELECT doc_id, {_strip(_LATEX)} AS text FROM texts"

# -- tables

SQL["table_otsl"] = f"""WITH p AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS li FROM pages),
c AS (SELECT doc_id, i, i // 2 AS r, len(li) AS n, trim(replace(replace(replace(replace(replace(regexp_replace(coalesce(li[i + 1], ''), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39))) AS x FROM (SELECT doc_id, li, unnest(range(0, (len(li) + 1) // 2 * 2)) AS i FROM p WHERE len(li) > 0)),
k AS (SELECT doc_id, r, string_agg(CASE WHEN r % 2 = 1 AND i % 2 = 1 THEN '<lcel>' WHEN x = '' THEN '<ecel>' ELSE '<fcel>' || x END, '' ORDER BY i) || '<nl>' AS otsl,
  '<tr>' || string_agg(CASE WHEN r % 2 = 1 AND i % 2 = 1 THEN '' ELSE CASE WHEN r % 2 = 1 THEN '<td colspan="2">' ELSE '<td>' END || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</td>' END, '' ORDER BY i) || '</tr>' AS html FROM c GROUP BY doc_id, r)
SELECT doc_id, string_agg(otsl, '' ORDER BY r) AS otsl, '<table>' || string_agg(html, '' ORDER BY r) || '</table>' AS html FROM k GROUP BY doc_id"""

SQL["table_grids"] = """WITH p AS (SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS n FROM pages), r AS (SELECT doc_id, unnest(range(0, (n + 1) // 2)) AS r FROM p WHERE n > 0)
SELECT doc_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, 1 AS row_span, CASE WHEN r % 2 = 1 THEN 2 ELSE 1 END AS col_span FROM r, (SELECT unnest([0, 1]) AS c) WHERE NOT (r % 2 = 1 AND c = 1)"""

# -- neighbours

SQL["merged_neighbours"] = f"""WITH {BOXES}, f AS (SELECT *, lag(idx) OVER w AS b_idx, lag(label) OVER w AS b_label, lag(x1) OVER w AS bx1, lag(y1) OVER w AS by1, lag(x2) OVER w AS bx2, lag(y2) OVER w AS by2 FROM boxes
  WHERE label NOT IN ('chart', 'footer_image', 'header_image', 'image', 'seal', 'table') WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
m AS (SELECT *, label = 'text' AND coalesce(b_label = 'text', false) AS texts, least(x2, bx2) - greatest(x1, bx1) > 0 AS shares FROM f),
j AS (SELECT *, texts AND NOT shares AND x1 > bx2 AND y1 < by2 AND x1 - bx2 < greatest(x2 - x1, bx2 - bx1) * 0.3 AS beside,
  texts AND shares AND y2 >= by1 AND abs(y1 - by2) < greatest(y2 - y1, by2 - by1) * 0.5 AND (abs(x1 - bx1) <= 5) <> (abs(x2 - bx2) <= 5)
  AND EXISTS (SELECT 1 FROM boxes t WHERE t.doc_id = m.doc_id AND t.idx <> m.idx AND t.idx <> m.b_idx AND least(t.x2, greatest(m.x2, m.bx2)) - greatest(t.x1, least(m.x1, m.bx1)) > 0 AND least(t.y2, greatest(m.y2, m.by2)) - greatest(t.y1, least(m.y1, m.by1)) > 0) AS under FROM m),
g AS (SELECT *, CAST(sum(CASE WHEN beside OR under THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS g FROM j),
h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g)
SELECT b.doc_id, b.idx, CASE WHEN h.n > 1 THEN h.g END AS merge_group, CASE WHEN h.n > 1 AND h.beside THEN 'center' WHEN h.n > 1 AND h.under THEN CASE WHEN abs(h.x1 - h.bx1) <= 5 THEN 'left' WHEN abs(h.x2 - h.bx2) <= 5 THEN 'right' ELSE 'center' END END AS merge_align
FROM boxes b LEFT JOIN h ON b.doc_id = h.doc_id AND b.idx = h.idx"""

# -- pages

SQL["page_json"] = f"""WITH {BOXES} SELECT doc_id, '{{"layout_elements":[' || string_agg('{{"idx":' || idx || ',"kind":"' || kind || '"' || coalesce(',"text":"' || text || '"', '') || ',"rank":' || idx || '}}', ',' ORDER BY idx) || ']}}' AS json FROM boxes GROUP BY doc_id"""
SQL["page_dump"] = f"""WITH {BOXES} SELECT doc_id, string_agg(printf('[%d] %s (%.3f) at (%.1f, %.1f, %.1f, %.1f)', idx, coalesce(text, '-'), score, x1, y1, x2, y2), chr(10) ORDER BY idx) AS dump FROM boxes GROUP BY doc_id"""
SQL["vl_markdown"] = f"""WITH {BOXES}, m AS (SELECT doc_id, idx, CASE WHEN kind = 'paragraph_title' THEN '## ' || rtrim(coalesce(text, ''), '.') WHEN kind = 'doc_title' THEN '# ' || coalesce(text, '') WHEN kind = 'table' THEN chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS m FROM boxes WHERE kind NOT IN ('footnote', 'header', 'number')),
b AS (SELECT *, coalesce(max(m <> '') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM m)
SELECT doc_id, string_agg(CASE WHEN begun THEN chr(10) || chr(10) ELSE '' END || m, '' ORDER BY idx) AS markdown FROM b GROUP BY doc_id"""

_CENTER = '<div style="text-align: center;">'
_LINE = lambda n: f"coalesce({n}.kind IN ('text', 'reference_content') AND least(f.y2, {n}.y2) - greatest(f.y1, {n}.y1) > 0.5 * least(f.y2 - f.y1, {n}.y2 - {n}.y1), false)"
_MEETS = "a.x1 < b.x2 AND a.x2 > b.x1"
SQL["page_markdown"] = f"""WITH {BOXES}, w AS (SELECT *, max(x2) OVER (PARTITION BY doc_id) AS page_w, max(CASE WHEN kind <> 'formula' THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bi,
  min(CASE WHEN kind <> 'formula' THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ai FROM boxes),
i AS (SELECT f.*, {_LINE('b')} AND {_LINE('a')} AS inline FROM w f LEFT JOIN boxes b ON f.doc_id = b.doc_id AND f.bi = b.idx LEFT JOIN boxes a ON f.doc_id = a.doc_id AND f.ai = a.idx),
-- doubtful texts inside a table are the table's
s AS (SELECT * FROM i WHERE kind NOT IN ('footnote', 'header', 'number') AND NOT (kind = 'text' AND score < 0.7 AND EXISTS (SELECT 1 FROM boxes t WHERE t.doc_id = i.doc_id AND t.kind = 'table' AND greatest(least(t.x2, i.x2) - greatest(t.x1, i.x1), 0) * greatest(least(t.y2, i.y2) - greatest(t.y1, i.y1), 0) > 0.3 * (i.x2 - i.x1) * (i.y2 - i.y1)))),
p AS (SELECT *, max(CASE WHEN kind IN ('text', 'reference_content') THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi FROM s),
g AS (SELECT a.*, a.kind = 'text' AND b.idx IS NOT NULL AND abs(CASE WHEN {_MEETS} THEN greatest(a.x2, b.x2) ELSE a.x2 END - b.x2) < 10 AND a.x1 - CASE WHEN {_MEETS} THEN least(a.x1, b.x1) ELSE a.x1 END < 10 AND b.num_lines > 1
  AND CASE WHEN {_MEETS} THEN 0 ELSE abs(a.x1 - b.x2) END < greatest(b.x2 - b.x1, a.x2 - a.x1) AS goes_on FROM p a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.pi = b.idx),
m AS (SELECT doc_id, idx, goes_on OR (kind = 'formula' AND inline) AS glued, CASE kind WHEN 'doc_title' THEN coalesce('# ' || text, '') WHEN 'paragraph_title' THEN '## ' || coalesce(text, '') WHEN 'table' THEN '[Table]'
  WHEN 'formula' THEN CASE WHEN inline THEN '$' || text || '$ ' ELSE '$$' || text || '$$' END WHEN 'figure_title' THEN '{_CENTER}' || text || ' </div>'
  WHEN 'image' THEN NULL WHEN 'chart' THEN NULL ELSE text END AS part, CASE WHEN kind IN ('image', 'chart') THEN '{_CENTER}<img src="imgs/img_in_' || kind || '_box_' || CAST(x1 AS INTEGER) || '_' || CAST(y1 AS INTEGER) || '_' || CAST(x2 AS INTEGER) || '_' || CAST(y2 AS INTEGER) || '.jpg" alt="Image" width="' || CAST(least(greatest(floor((x2 - x1) / page_w * 100), 1), 100) AS INTEGER) || '%" /></div>' END AS picture FROM g),
k AS (SELECT doc_id, idx, coalesce(glued, false) AS glued, coalesce(part, picture) AS part, coalesce(max(coalesce(part, picture) <> '') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM m WHERE coalesce(part, picture) IS NOT NULL),
j AS (SELECT doc_id, {_strip("string_agg(CASE WHEN begun AND NOT glued THEN chr(10) || chr(10) ELSE '' END || part, '' ORDER BY idx)")} AS markdown FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.markdown, '') AS markdown FROM (SELECT DISTINCT doc_id FROM boxes) d LEFT JOIN j ON d.doc_id = j.doc_id"""

# painted bars: a detector pushes each outline out by area x 1.5 / perimeter
_D = "(40 + k + 10 * j) * 10 * 1.5::DOUBLE / (2 * (50 + k + 10 * j))"
SQL["ocr_pages"] = f"""WITH b AS (SELECT n_nationkey AS doc_id, 4 * n_nationkey % 80 AS k, unnest([0, 1, 2]) AS j FROM nation),
r AS (SELECT doc_id, j, round_even(20 - {_D}, 0) AS x1, round_even(15 + 35 * j - {_D}, 0) AS y1, least(round_even(60 + k + 10 * j + {_D}, 0), 160) AS x2, least(round_even(25 + 35 * j + {_D}, 0), 120) AS y2 FROM b)
SELECT doc_id, CAST(j AS INTEGER) AS region_idx, x1, y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(x2 - x1 AS INTEGER) || 'x' || CAST(y2 - y1 AS INTEGER) AS text FROM r"""
SQL["ocr_under_layout"] = SQL["ocr_pages"]

# lines of the texts that an element meets: a line goes by its first span, texts by their neighbours
_ON = lambda a, b: f"(greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) / least(greatest({a}.y2 - {a}.y1, 1), greatest({b}.y2 - {b}.y1, 1)) >= 0.6::DOUBLE OR abs(({a}.y1 + {a}.y2) / 2 - ({b}.y1 + {b}.y2) / 2) <= greatest(least(greatest({a}.y2 - {a}.y1, 1), greatest({b}.y2 - {b}.y1, 1)) * 0.5::DOUBLE, 2.5::DOUBLE))"
SQL["element_texts"] = f"""WITH RECURSIVE {BOXES},
s AS (SELECT e.doc_id, e.idx AS e, e.x1 AS ex1, e.x2 AS ex2, r.idx AS i, r.x1, r.y1, r.x2, r.y2, r.text, r.label = 'formula' AS formula, row_number() OVER (PARTITION BY e.doc_id, e.idx ORDER BY (r.y1 + r.y2) / 2, r.idx) AS k
  FROM boxes e JOIN boxes r ON e.doc_id = r.doc_id AND e.idx % 2 = 1 AND r.idx % 2 = 0 AND r.text IS NOT NULL AND e.kind NOT IN ('table', 'seal') AND least(e.x2, r.x2) - greatest(e.x1, r.x1) > 3 AND least(e.y2, r.y2) - greatest(e.y1, r.y1) > 3),
l AS (SELECT doc_id, e, k, 1 AS line, y1, y2 FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.e, s.k, CASE WHEN {_ON('l', 's')} THEN l.line ELSE l.line + 1 END, CASE WHEN {_ON('l', 's')} THEN l.y1 ELSE s.y1 END, CASE WHEN {_ON('l', 's')} THEN l.y2 ELSE s.y2 END FROM l JOIN s ON s.doc_id = l.doc_id AND s.e = l.e AND s.k = l.k + 1),
q AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.e ORDER BY l.line, (s.x1 + s.x2) / 2, s.k) AS p FROM s JOIN l ON s.doc_id = l.doc_id AND s.e = l.e AND s.k = l.k),
c AS (SELECT doc_id, e, p, 1 AS n, y1, y2 FROM q WHERE p = 1
  UNION ALL SELECT q.doc_id, q.e, q.p, CASE WHEN {_ON('c', 'q')} THEN c.n ELSE c.n + 1 END, CASE WHEN {_ON('c', 'q')} THEN c.y1 ELSE q.y1 END, CASE WHEN {_ON('c', 'q')} THEN c.y2 ELSE q.y2 END FROM c JOIN q ON q.doc_id = c.doc_id AND q.e = c.e AND q.p = c.p + 1),
j AS (SELECT b.*, CASE WHEN a.p IS NULL THEN '' WHEN NOT {_ON('a', 'b')} THEN CASE WHEN b.ex2 - a.x2 > (b.ex2 - b.ex1) * 0.3::DOUBLE THEN chr(10) ELSE '' END WHEN a.formula THEN ' ' ELSE '' END AS sep FROM q b LEFT JOIN q a ON a.doc_id = b.doc_id AND a.e = b.e AND a.p = b.p - 1),
t AS (SELECT doc_id, e, string_agg(sep || CASE WHEN formula THEN CASE WHEN p = 1 OR sep = chr(10) THEN '$$' || text || '$$' ELSE '$' || text || '$' END ELSE text END, '' ORDER BY p) AS text, arg_min(x1, p) AS a, arg_max(x2, p) AS b FROM j GROUP BY doc_id, e),
n AS (SELECT doc_id, e, max(n) AS n FROM c GROUP BY doc_id, e)
SELECT b.doc_id, b.idx, t.text, CAST(coalesce(n.n, b.num_lines) AS INTEGER) AS num_lines, round(t.a, 6) AS seg_start_x, round(t.b, 6) AS seg_end_x FROM boxes b LEFT JOIN t ON b.doc_id = t.doc_id AND b.idx = t.e LEFT JOIN n ON b.doc_id = n.doc_id AND b.idx = n.e WHERE b.idx % 2 = 1"""
