"""DuckDB SQL of queries whose Spark side folds over a page: the same rules as recursive queries.

A page's boxes are numbered, and a recursive step takes the next box (or the next
overlapping pair) with the list of what was decided so far. Lists of texts and of
numbers stand for pages; nothing is shared with the folds themselves.
"""

from __future__ import annotations

from quirespark.plans.inputs import BOXES, HYPHENS

_W = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + {0}, 0)"
_H = "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + {0}, 0)"


def _size(t: str, one: str) -> str:
    return f"(({t}.x2 - {t}.x1 + {one}) * ({t}.y2 - {t}.y1 + {one}))"


def _iou(one: str = "0") -> str:
    both = f"{_W.format(one)} * {_H.format(one)}"
    return f"({both}) / ({_size('a', one)} + {_size('b', one)} - {both})"


_SHARE = f"({_W.format(0)} * {_H.format(0)}) / least({_size('a', '0')}, {_size('b', '0')})"
_BY_SCORE = "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS k FROM boxes)"


def _suppressed(drops: str) -> str:
    """Greedy suppression by falling score; ``drops`` says whether a kept box a drops a later one b."""
    return f"""WITH RECURSIVE {BOXES}, {_BY_SCORE},
c AS (SELECT a.doc_id, b.k, list(a.k) AS foes FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.k < b.k WHERE {drops} GROUP BY a.doc_id, b.k),
r AS (SELECT doc_id, k, [k] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN list_has_any(r.kept, coalesce(c.foes, [])) THEN r.kept ELSE list_append(r.kept, o.k) END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1 LEFT JOIN c ON c.doc_id = o.doc_id AND c.k = o.k),
e AS (SELECT doc_id, arg_max(kept, k) AS kept FROM r GROUP BY doc_id)
SELECT o.doc_id, o.idx, CAST(list_position(e.kept, o.k) - 1 AS INTEGER) AS rank FROM o JOIN e ON o.doc_id = e.doc_id WHERE list_contains(e.kept, o.k)"""


SQL: dict[str, str] = {
    "nms": _suppressed(f"a.cls = b.cls AND {_iou()} > 0.3"),
    "layout_nms": _suppressed(f"NOT ({_iou('1')} < CASE WHEN a.cls = b.cls THEN 0.6 ELSE 0.98 END)"),
}

# overlapping pairs of a page in the order in which they are compared
_PAIRS = "row_number() OVER (PARTITION BY a.doc_id ORDER BY a.idx, b.idx) AS n, a.doc_id, a.idx AS i, b.idx AS j"
_GONE = "e AS (SELECT doc_id, arg_max(gone, n) AS gone FROM r GROUP BY doc_id) SELECT s.doc_id, s.idx FROM s LEFT JOIN e ON s.doc_id = e.doc_id WHERE NOT coalesce(list_contains(e.gone, s.idx), false)"
SQL["overlap_removal"] = f"""WITH RECURSIVE {BOXES}, s AS (SELECT * FROM boxes),
p AS (SELECT {_PAIRS}, CASE WHEN (a.kind = 'image') <> (b.kind = 'image') THEN CASE WHEN a.kind = 'image' THEN a.idx ELSE b.idx END WHEN {_size('a', '0')} < {_size('b', '0')} THEN a.idx ELSE b.idx END AS falls FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.idx < b.idx WHERE {_SHARE} > 0.5),
-- gone at the start of the pass of i, and gone by now: a box that falls in its own pass goes on comparing
r AS (SELECT doc_id, n, i, CAST([] AS INTEGER[]) AS before, [falls] AS gone FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, p.i, CASE WHEN p.i = r.i THEN r.before ELSE r.gone END, CASE WHEN list_contains(CASE WHEN p.i = r.i THEN r.before ELSE r.gone END, p.i) OR list_contains(r.gone, p.j) THEN r.gone ELSE list_append(r.gone, p.falls) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1),
{_GONE}"""
SQL["overlap_filter"] = f"""WITH RECURSIVE {BOXES}, s AS (SELECT * FROM boxes WHERE kind <> 'reference'),
p AS (SELECT {_PAIRS}, CASE WHEN {_size('a', '0')} >= {_size('b', '0')} THEN b.idx ELSE a.idx END AS falls FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.idx < b.idx WHERE {_SHARE} > 0.7 AND NOT ((a.kind = 'image') <> (b.kind = 'image'))),
r AS (SELECT doc_id, n, [falls] AS gone FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN list_contains(r.gone, p.i) OR list_contains(r.gone, p.j) THEN r.gone ELSE list_append(r.gone, p.falls) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1),
{_GONE}"""

# each box in (y, x) order moves left past the boxes of its band that end the list and start further right
SQL["quad_order"] = f"""WITH RECURSIVE {BOXES}, o AS (SELECT doc_id, idx, x1, y1, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, idx) AS k FROM boxes),
r AS (SELECT doc_id, k, [{{'i': idx, 'x': x1, 'y': y1}}] AS done FROM o WHERE k = 1
  UNION ALL SELECT doc_id, k, list_concat(list_append(done[:len(done) - past], {{'i': idx, 'x': x1, 'y': y1}}), done[len(done) - past + 1:]) FROM (
    SELECT o.doc_id, o.k, o.idx, o.x1, o.y1, r.done, coalesce(list_position(list_transform(list_reverse(r.done), lambda d: abs(o.y1 - d.y) < 10 AND o.x1 < d.x), false) - 1, len(r.done)) AS past FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)),
e AS (SELECT doc_id, arg_max(done, k) AS done FROM r GROUP BY doc_id)
SELECT doc_id, unnest(done).i AS idx, CAST(generate_subscripts(done, 1) - 1 AS INTEGER) AS rank FROM e"""

# groups grow box by box: step (i, j) compares the group that i leads with j
_GROUP = "least(g.x2, o.x2) - greatest(g.x1, o.x1)", "least(g.y2, o.y2) - greatest(g.y1, o.y1)"
_BOTH = f"greatest({_GROUP[0]}, 0) * greatest({_GROUP[1]}, 0)"
SQL["nms_merge"] = f"""WITH RECURSIVE {BOXES}, {_BY_SCORE}, m AS (SELECT doc_id, count(*) AS c FROM boxes GROUP BY doc_id),
-- lead: rank of the box that began the group; pos: the rank compared last; done: ranks in groups; gs: finished groups
r(doc_id, lead, pos, done, x1, y1, x2, y2, first, best, cls, gs) AS (
  SELECT doc_id, k, k, [k], x1, y1, x2, y2, idx, score, cls, CAST([] AS STRUCT(idx INTEGER, cls VARCHAR, score DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) FROM o WHERE k = 1
  UNION ALL
  SELECT * FROM (
  SELECT g.doc_id, g.lead, g.pos + 1, CASE WHEN t THEN list_append(g.done, o.k) ELSE g.done END,
    CASE WHEN NOT t THEN g.x1 WHEN g.cls = 'A' THEN least(g.x1, o.x1) WHEN f THEN g.x1 ELSE o.x1 END, CASE WHEN NOT t THEN g.y1 WHEN g.cls = 'A' THEN least(g.y1, o.y1) WHEN f THEN g.y1 ELSE o.y1 END,
    CASE WHEN NOT t THEN g.x2 WHEN g.cls = 'A' THEN greatest(g.x2, o.x2) WHEN f THEN g.x2 ELSE o.x2 END, CASE WHEN NOT t THEN g.y2 WHEN g.cls = 'A' THEN greatest(g.y2, o.y2) WHEN f THEN g.y2 ELSE o.y2 END,
    CASE WHEN t THEN least(g.first, o.idx) ELSE g.first END, CASE WHEN t THEN greatest(g.best, o.score) ELSE g.best END, g.cls, g.gs
  FROM r g JOIN m ON m.doc_id = g.doc_id JOIN o ON o.doc_id = g.doc_id AND o.k = g.pos + 1,
    LATERAL (SELECT NOT list_contains(g.done, o.k) AND o.cls = g.cls AND ({_BOTH}) / ({_size('g', '0')} + {_size('o', '0')} - {_BOTH}) > 0.2 AS t, CASE WHEN g.cls = 'N' THEN {_size('g', '0')} <= {_size('o', '0')} ELSE {_size('g', '0')} >= {_size('o', '0')} END AS f)
  WHERE g.pos < m.c
  UNION ALL
  SELECT g.doc_id, o.k, o.k, list_append(g.done, o.k), o.x1, o.y1, o.x2, o.y2, o.idx, o.score, o.cls, list_append(g.gs, {{'idx': g.first, 'cls': g.cls, 'score': g.best, 'x1': g.x1, 'y1': g.y1, 'x2': g.x2, 'y2': g.y2}})
  FROM r g JOIN m ON m.doc_id = g.doc_id, LATERAL (SELECT min(x) AS k FROM (SELECT unnest(range(1, m.c + 1)) AS x) WHERE NOT list_contains(g.done, x)) q JOIN o ON o.doc_id = g.doc_id AND o.k = q.k
  WHERE g.pos >= m.c)),
e AS (SELECT r.* FROM r JOIN m ON m.doc_id = r.doc_id WHERE r.pos = m.c AND len(r.done) = m.c),
u AS (SELECT doc_id, unnest(list_append(gs, {{'idx': first, 'cls': cls, 'score': best, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}})) AS g FROM e)
SELECT doc_id, g.idx AS idx, g.cls AS cls, g.score AS score, g.x1 AS x1, g.y1 AS y1, g.x2 AS x2, g.y2 AS y2 FROM u"""

SQL["reversed_text"] = f"""WITH {HYPHENS} SELECT doc_id, coalesce(array_to_string(list_reverse(regexp_extract_all(text, '(?s)[A-Za-z0-9 :*./%+-]+|.')), ''), '') AS text FROM texts"""

# a cut after each share of the length moves back up to five characters to follow a blank, comma or full stop
_SPLIT = lambda n, share, at: f"CASE WHEN {at} < least({n}, {at} + CAST(floor({n} * {share} + 0.5) AS BIGINT)) AND {at} + CAST(floor({n} * {share} + 0.5) AS BIGINT) < {n} THEN {at} + CAST(floor({n} * {share} + 0.5) AS BIGINT) ELSE least({n}, {at} + CAST(floor({n} * {share} + 0.5) AS BIGINT)) END"
_BACK = lambda end, at: f"coalesce((SELECT max(i + 1) FROM (SELECT unnest(range({end} - least(5, {end} - {at}) + 1, {end} + 1)) AS i) WHERE i > {at} AND {end} > {at} AND {end} < n AND regexp_matches(text[i + 1], '[\\s,.]')), {end})"
SQL["ratio_splits"] = f"""WITH b AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE text IS NOT NULL), c AS (SELECT *, {_SPLIT('n', '0.5::DOUBLE', '0')} AS e1 FROM b), d AS (SELECT *, {_BACK('e1', '0')} AS f1 FROM c),
g AS (SELECT *, {_SPLIT('n', '0.3::DOUBLE', 'f1')} AS e2 FROM d), h AS (SELECT *, {_BACK('e2', 'f1')} AS f2 FROM g),
p AS (SELECT item_id, unnest([text[1:f1], text[f1 + 1:f2], text[f2 + 1:]]) AS text, unnest([0, 1, 2]) AS part FROM h)
SELECT item_id, CAST(part AS INTEGER) AS part, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM p"""

# a region is cut along x, each part along y; a part that y does not cut is a leaf, others are regions again
_STRETCH = lambda lo, hi, part, order: f"CASE WHEN {lo} - max({hi}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1 THEN 0 ELSE 1 END"
SQL["xycut_order"] = f"""WITH RECURSIVE {BOXES}, w AS (SELECT doc_id, idx, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2 FROM boxes),
r AS (SELECT *, CAST([] AS BIGINT[]) AS path, false AS leaf FROM w
  UNION ALL SELECT doc_id, idx, x1, y1, x2, y2, list_append(list_append(path, s1), s2), max(s2) OVER (PARTITION BY doc_id, path, s1) = 1 FROM (
    SELECT *, CAST(sum(new2) OVER (PARTITION BY doc_id, path, s1 ORDER BY {{B}}1, {{A}}1, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s2 FROM (
      SELECT *, {_STRETCH('{B}1', '{B}2', 'doc_id, path, s1', '{B}1, {A}1, idx')} AS new2 FROM (
        SELECT *, CAST(sum(new1) OVER (PARTITION BY doc_id, path ORDER BY {{A}}1, {{B}}1, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s1 FROM (
          SELECT *, {_STRETCH('{A}1', '{A}2', 'doc_id, path', '{A}1, {B}1, idx')} AS new1 FROM r WHERE NOT leaf))))),
e AS (SELECT * FROM r WHERE leaf)
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, {{B}}1, {{A}}1, idx) - 1 AS INTEGER) AS rank FROM e""".replace("{A}", "y").replace("{B}", "x")
