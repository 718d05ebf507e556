"""Queries over texts and sequences, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import sequences as S
from quirespark.functions import text as T
from quirespark.plans.inputs import BOXES, HYPHENS, LOGITS, boxes, hyphened, logits, table

ALPHABET = ["_", "a", "b", "c", "d", "e", "f"]
SQL: dict[str, str] = {}


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up by replacement on texts with line-break hyphens."""
    t = F.col("text")
    return hyphened(spark, sf_dir).select("doc_id", T.clean_ocr(t).alias("cleaned"), T.text_block(t).alias("block"), T.content_block(t).alias("content"))


SQL["text_blocks"] = f"""WITH {HYPHENS} SELECT doc_id, replace(replace(text, '-' || chr(10), ''), chr(10), ' ') AS cleaned, replace(replace(replace(text, '-' || chr(10), ''), chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10)) AS block,
  replace(replace(text, '-' || chr(10), '  ' || chr(10)), chr(10), '  ' || chr(10)) AS content FROM texts"""


def text_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes and centring of whole texts."""
    t = F.col("text")
    return hyphened(spark, sf_dir).select("doc_id", T.escape_html(t).alias("escaped"), T.centered(t).alias("centered"))


SQL["text_markup"] = f"""WITH {HYPHENS} SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped,
  '<div style="text-align: center;">' || replace(replace(text, '-' || chr(10), ''), chr(10), ' ') || '</div>' || chr(10) AS centered FROM texts"""


def text_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, spaces and punctuation, on texts made to have them."""
    src = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" of "), F.lit("   ____ ")), F.lit("."), F.lit(" .....")).alias("text"))
    t = F.col("text")
    return src.select("doc_id", T.runs_shortened(t).alias("shortened"), T.spaces_collapsed(t).alias("collapsed"), T.punctuation_tightened(t).alias("tightened"), T.has_bullets(F.replace(t, F.lit("____"), F.lit("•"))).alias("bullets"), T.bullet_list(F.replace(t, F.lit("____"), F.lit("•"))).alias("items"))


SQL["text_spacing"] = r"""WITH texts AS (SELECT doc_id, replace(replace(coalesce(text, ''), ' of ', '   ____ '), '.', ' .....') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '_{4,}', '___', 'g'), '\.{4,}', '...', 'g'), '^\s+|\s+$', '', 'g') AS shortened, regexp_replace(text, ' +', ' ', 'g') AS collapsed, regexp_replace(text, ' ([,.;:!?)])', '\1', 'g') AS tightened,
  contains(text, '____') AS bullets, coalesce(list_reduce(list_prepend('', list_transform(list_filter(list_transform(string_split(replace(text, '____', '•'), '•'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), lambda s: '- ' || s || chr(10))), lambda a, b: a || b), '') AS items FROM texts"""


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels of numbered, keyword and plain titles."""
    b = boxes(spark, sf_dir)
    k = F.col("idx") % 5
    title = F.when(k == 0, F.concat(F.lit("1.2. "), F.col("label"))).when(k == 1, F.lit("Introduction:")).when(k == 2, F.concat(F.lit("(3) "), F.col("label"))).when(k == 3, F.concat(F.lit("IV. "), F.col("label"))).otherwise(F.col("label"))
    t = T.titled(title, F.col("num_lines"))
    return b.select("doc_id", "idx", t["level"].alias("level"), t["title"].alias("title"))


SQL["section_titles"] = f"""WITH {BOXES} SELECT doc_id, idx, CAST(CASE idx % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE greatest(num_lines, 2) END AS INTEGER) AS level,
  CASE idx % 5 WHEN 0 THEN '1.2 ' || label WHEN 1 THEN 'Introduction:' WHEN 2 THEN '(3) ' || label WHEN 3 THEN 'IV ' || label ELSE label END AS title FROM boxes"""


def tiny_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("sign", F.when(F.col("idx") % 3 == 0, "=").when(F.col("idx") % 3 == 1, "0").otherwise("a"))
    return b.select("doc_id", "idx", T.tiny_symbol(F.col("sign"), F.col("score"), (F.col("x2") - F.col("x1")) / 3, (F.col("y2") - F.col("y1")) / 2).alias("sign"))


SQL["tiny_symbols"] = f"""WITH {BOXES}, s AS (SELECT doc_id, idx, CASE idx % 3 WHEN 0 THEN '=' WHEN 1 THEN '0' ELSE 'a' END AS sign, score, (x2 - x1) / 3 AS w, (y2 - y1) / 2 AS h FROM boxes)
SELECT doc_id, idx, CASE WHEN sign = '=' AND score < 0.45 AND w <= 9.5 AND h <= 7.5 THEN ',' WHEN sign = '=' AND score < 0.45 AND w <= 12.5 AND h > 7.5 AND h <= 10.5 THEN '-' WHEN sign = '0' AND score < 0.2 AND w <= 14.5 AND h <= 14.5 THEN ';' ELSE sign END AS sign FROM s"""


def orientation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in ("90", "180.05", "Left", " upright ", "45", "270deg", "sideways")]), (F.col("idx") % 7 + 1).cast("int"))
    return b.select("doc_id", "idx", E.orientation_angle(label).alias("angle"), E.orientation_angle(label, (0.0, 180.0)).alias("line_angle"), E.orientation_label(label).alias("shown"))


SQL["orientation_labels"] = f"""WITH {BOXES} SELECT doc_id, idx, CASE idx % 7 WHEN 0 THEN 90.0::DOUBLE WHEN 1 THEN 180.05::DOUBLE WHEN 2 THEN 270.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN 270.0::DOUBLE END AS angle,
  CASE idx % 7 WHEN 1 THEN 180.05::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS line_angle, CASE idx % 7 WHEN 0 THEN '90°' WHEN 1 THEN '180.05' WHEN 2 THEN 'Left' WHEN 3 THEN ' upright ' WHEN 4 THEN '45' WHEN 5 THEN '270deg' ELSE 'sideways' END AS shown FROM boxes"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = logits(spark, sf_dir).select("seq", "t", S.argmax(F.col("scores")).alias("b"))
    packed = best.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("t", "b"))).alias("s"))
    return packed.select("seq", F.transform("s", lambda x: x["b"]["token"]).alias("tokens"), F.transform("s", lambda x: x["b"]["prob"]).alias("probs"))


def argmax_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.argmax(F.col("scores")), S.argmax_first(F.transform("scores", lambda v: F.round(v, 0)))
    return logits(spark, sf_dir).select("seq", "t", a["token"].alias("token"), F.round(a["prob"], 6).alias("prob"), b["token"].alias("first_token"))


SQL["argmax_steps"] = f"""WITH {LOGITS}, r AS (SELECT *, list_transform(scores, lambda v: round(v, 0)) AS whole FROM steps)
SELECT seq, t, CAST(8 - list_position(list_reverse(scores), list_max(scores)) AS INTEGER) AS token, round(list_max(scores), 6) AS prob, CAST(list_position(whole, list_max(whole)) - 1 AS INTEGER) AS first_token FROM r"""


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.ctc_decode(F.col("tokens"), F.col("probs"), ALPHABET)
    return _steps(spark, sf_dir).select("seq", d["text"].alias("text"), F.round(d["score"], 6).alias("score"), F.array_join(F.transform(d["columns"], lambda c: c.cast("string")), ",").alias("columns"))


_ARG = f"""{LOGITS}, a AS (SELECT seq, t, CAST(8 - list_position(list_reverse(scores), list_max(scores)) AS INTEGER) AS token, list_max(scores) AS prob FROM steps),
l AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY seq ORDER BY t), 0) AS before, lag(token) OVER (PARTITION BY seq ORDER BY t) AS raw_before FROM a), ids AS (SELECT DISTINCT seq FROM a)"""
_CHARS = "list_extract(['_', 'a', 'b', 'c', 'd', 'e', 'f'], token + 1)"
SQL["ctc_decode"] = f"""WITH {_ARG}, k AS (SELECT * FROM l WHERE token <> 0 AND token <> before AND token < 7)
SELECT ids.seq, coalesce(string_agg({_CHARS}, '' ORDER BY t), '') AS text, round(coalesce(avg(prob), 0.0::DOUBLE), 6) AS score, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t), '') AS columns FROM ids LEFT JOIN k ON ids.seq = k.seq GROUP BY ids.seq"""


def base_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.base_decode(F.col("tokens"), F.col("probs"), ALPHABET)
    return _steps(spark, sf_dir).select("seq", d["text"].alias("text"), F.round(d["score"], 6).alias("score"))


SQL["base_decode"] = f"""WITH {_ARG}, k AS (SELECT *, CASE WHEN token < 7 THEN {_CHARS} ELSE '' END AS c FROM l WHERE token <> 0 AND token IS DISTINCT FROM raw_before)
SELECT ids.seq, coalesce(string_agg(c, '' ORDER BY t), '') AS text, round(coalesce(avg(prob), 0.0::DOUBLE), 6) AS score FROM ids LEFT JOIN k ON ids.seq = k.seq GROUP BY ids.seq"""


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.posexplode(S.top_k(F.col("scores"), 3, {0: "zero", 1: "one"}))
    return logits(spark, sf_dir).select("seq", "t", top.alias("place", "c")).select("seq", "t", "place", F.col("c.class_id").alias("class_id"), F.round("c.score", 6).alias("score"), F.col("c.label").alias("name"))


SQL["top_classes"] = f"""WITH {LOGITS}, u AS (SELECT seq, t, unnest(scores) AS s, CAST(generate_subscripts(scores, 1) - 1 AS INTEGER) AS c FROM steps),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq, t ORDER BY s DESC, c) - 1 AS INTEGER) AS place FROM u)
SELECT seq, t, place, c AS class_id, round(s, 6) AS score, CASE c WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'Unknown(' || CAST(c AS VARCHAR) || ')' END AS name FROM r WHERE place < 3"""


def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-number detector rows in any of three layouts."""
    row = F.transform(F.slice("scores", 1, 6), lambda v, i: F.when(i == F.col("t") % 6, F.round(F.abs(v) * 20)).otherwise(v))
    p = E.compact_prediction(row, 8)
    return logits(spark, sf_dir).select("seq", "t", p["class_id"].alias("class_id"), F.round(p["score"], 6).alias("score"), F.round(p["x1"], 6).alias("x1"))


_ROW = [f"CASE WHEN t % 6 = {i} THEN round(abs(scores[{i + 1}]) * 20) ELSE scores[{i + 1}] END AS r{i}" for i in range(6)]
_OKS = lambda i: f"r{i} BETWEEN 0 AND 1.0000001192092896"
_OKC = lambda i: f"round(r{i}) BETWEEN 0 AND 12"
SQL["compact_rows"] = f"""WITH {LOGITS}, r AS (SELECT seq, t, {', '.join(_ROW)} FROM steps), k AS (SELECT *, CASE WHEN {_OKS(1)} AND {_OKC(0)} THEN 1 WHEN {_OKS(4)} AND {_OKC(5)} THEN 2 WHEN {_OKS(0)} AND {_OKC(1)} THEN 3 END AS form FROM r)
SELECT seq, t, CAST(CASE form WHEN 1 THEN round(r0) WHEN 2 THEN round(r5) WHEN 3 THEN round(r1) END AS INTEGER) AS class_id, round(CASE form WHEN 1 THEN r1 WHEN 2 THEN r4 WHEN 3 THEN r0 END, 6) AS score, round(CASE form WHEN 1 THEN r2 WHEN 2 THEN r0 WHEN 3 THEN r2 END, 6) AS x1 FROM k"""


def banned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.transform("tokens", lambda v: v % 3)
    return _steps(spark, sf_dir).select("seq", F.array_join(F.transform(S.banned_tokens(h, 2), lambda v: v.cast("string")), ",").alias("banned"))


SQL["banned_tokens"] = f"""WITH {LOGITS}, a AS (SELECT seq, t, (8 - list_position(list_reverse(scores), list_max(scores))) % 3 AS h FROM steps), n AS (SELECT *, lead(h) OVER (PARTITION BY seq ORDER BY t) AS nxt FROM a),
e AS (SELECT seq, arg_max(h, t) AS tail FROM a GROUP BY seq), d AS (SELECT DISTINCT n.seq, n.nxt FROM n JOIN e ON n.seq = e.seq AND n.h = e.tail WHERE n.nxt IS NOT NULL)
SELECT e.seq, coalesce(string_agg(CAST(d.nxt AS VARCHAR), ',' ORDER BY d.nxt), '') AS banned FROM e LEFT JOIN d ON e.seq = d.seq GROUP BY e.seq"""


def char_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character extents of decoded lines."""
    d = S.ctc_decode(F.col("tokens"), F.col("probs"), ALPHABET)
    s = _steps(spark, sf_dir).select("seq", d.alias("d"))
    b = F.posexplode(S.ctc_char_boxes(F.lit(10.0), F.lit(110.0), F.col("d.text"), F.col("d.columns"), F.lit(10), F.lit(2.0), F.lit(2.0)))
    return s.select("seq", b.alias("n", "b")).select("seq", "n", F.round("b.x1", 6).alias("x1"), F.round("b.x2", 6).alias("x2"))


SQL["char_boxes"] = f"""WITH {_ARG}, k AS (SELECT seq, t, 10 + (t + 0.5) * 10.0 AS c FROM l WHERE token <> 0 AND token <> before AND token < 7),
w AS (SELECT seq, CAST(row_number() OVER o - 1 AS INTEGER) AS n, c, lag(c) OVER o AS p, lead(c) OVER o AS q FROM k WINDOW o AS (PARTITION BY seq ORDER BY t))
SELECT seq, n, round(CAST(greatest(coalesce((p + c) / 2, 10.0), 10.0) AS DOUBLE), 6) AS x1, round(CAST(least(coalesce((c + q) / 2, 110.0), 110.0) AS DOUBLE), 6) AS x2 FROM w"""


def _udf(name: str, f, source=hyphened):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select("doc_id", T.as_udf(f)("text").alias("text"))

    run.__name__ = name
    return run


postprocess_lines = _udf("postprocess_lines", T.postprocess_text)
postprocess_markdown = _udf("postprocess_markdown", T.postprocess_markdown)
parsed_text = _udf("parsed_text", T.format_text)
truncated_text = _udf("truncated_text", T.truncate_repeats)
tail_cut_text = _udf("tail_cut_text", T.clean_truncated_tail)
latex_text = _udf("latex_text", T.normalise_latex)
reversed_text = _udf("reversed_text", T.reversed_keeping_ascii)


def _page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text: a markup table of each page's list items, two to a row, the first spanning where odd."""
    li = F.regexp_extract_all("html", F.lit(r"<li>(.*?)</li>"), F.lit(1))
    rows = F.transform(F.sequence(F.lit(0), F.expr("(size(li) - 1) div 2")), lambda i: F.concat(F.lit("<tr><td"), F.when(i % 2 == 1, F.lit(' colspan="2"')).otherwise(F.lit("")), F.lit(">"), F.get("li", i * 2), F.lit("</td>"), F.when(i % 2 == 0, F.concat(F.lit("<td>"), F.coalesce(F.get("li", i * 2 + 1), F.lit("")), F.lit("</td>"))).otherwise(F.lit("")), F.lit("</tr>")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), li.alias("li")).filter("size(li) > 0").select("doc_id", F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("text"))


def table_otsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup tables as OTSL and back again."""
    t = _page_tables(spark, sf_dir)
    otsl = t.select("doc_id", T.as_udf(S.html_to_otsl)("text").alias("otsl"))
    return otsl.select("doc_id", "otsl", T.as_udf(S.otsl_to_html)("otsl").alias("html"))


def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _page_tables(spark, sf_dir)
    x = F.col("text")
    return t.select("doc_id", T.table_block(F.replace(x, F.lit("<td colspan"), F.lit("<tdcolspan"))).alias("repaired"), T.centered_table(x).alias("centered"), T.unwrapped_table(F.concat(F.lit("<html><body>"), x, F.lit("</body></html>"))).alias("bare"))


_LI = """p AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS li FROM pages), t AS (SELECT doc_id, '<table>' || list_reduce(list_prepend('', list_transform(range(0, (len(li) - 1) // 2 + 1), lambda i:
  '<tr><td' || CASE WHEN i % 2 = 1 THEN ' colspan="2"' ELSE '' END || '>' || li[i * 2 + 1] || '</td>' || CASE WHEN i % 2 = 0 THEN '<td>' || coalesce(li[i * 2 + 2], '') || '</td>' ELSE '' END || '</tr>')), lambda a, b: a || b) || '</table>' AS text FROM p WHERE len(li) > 0)"""
_WRAP = "word-wrap: break-word;"
SQL["table_formats"] = f"""WITH {_LI} SELECT doc_id, text AS repaired, replace(replace(text, '<table>', '<table border=1 style=''margin: auto; {_WRAP}''>'), '<td>', '<td style=''text-align: center; {_WRAP}''>') AS centered, text AS bare FROM t"""


def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid places of the cells of each page's table tokens."""
    from quirespark.operators.tables import token_grid

    t = _page_tables(spark, sf_dir)
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"(<tr>|</tr>|<td></td>|<td>|<td | ?colspan=\"\d+\"|>(?=[^<])|</td>)"), F.lit(1)), lambda x: x != "")
    return t.select("doc_id", F.inline(token_grid(tokens)))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as a parser model's layout lines, read back."""
    b = boxes(spark, sf_dir)
    line = F.format_string("<|box_start|>%d %d %d %d<|box_end|><|ref_start|>%s<|ref_end|><|rotate_up|>", F.col("x1").cast("int"), F.col("y1").cast("int"), F.col("x2").cast("int"), F.col("y2").cast("int"), F.when(F.col("kind").isin("text", "table", "image", "header"), F.col("kind")).otherwise(F.lit("nothing")))
    rows = b.select("doc_id", "idx", line.alias("line"))
    names = ("kind", "x1", "y1", "x2", "y2", "angle")
    read = T.as_udf(lambda s: [dict(zip(names, r)) for r in S.layout_lines(s)], "array<struct<kind:string,x1:double,y1:double,x2:double,y2:double,angle:int>>")
    return rows.select("doc_id", "idx", F.inline(read("line")))


SQL["layout_lines"] = f"""WITH {BOXES} SELECT doc_id, idx, kind, x1 / 1000 AS x1, y1 / 1000 AS y1, CAST(CAST(x2 AS INTEGER) AS DOUBLE) / 1000 AS x2, CAST(CAST(y2 AS INTEGER) AS DOUBLE) / 1000 AS y2, 0 AS angle FROM boxes WHERE kind IN ('text', 'table', 'image', 'header')"""


def ratio_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "benchmark")
    cut = T.as_udf(lambda t: T.split_by_ratio(t, [0.5, 0.3, 0.2]), "array<string>")
    return src.select("item_id", F.posexplode(cut("text")).alias("part", "text"))


def vl_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered titles of whole texts."""
    src = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("1.2"), "text").alias("title"))
    return src.select("item_id", T.as_udf(T.vl_title)("title").alias("title"))


SQL["vl_titles"] = r"""WITH s AS (SELECT item_id, text AS b FROM benchmark), t AS (SELECT item_id, CASE WHEN contains(b, chr(10)) THEN '1.2' || b ELSE '1.2 ' || regexp_replace(b, '^\s+', '') END AS t FROM s), r AS (SELECT item_id, rtrim(t, '.') AS t FROM t)
SELECT item_id, replace(replace(repeat('#', CAST(length(t) - length(replace(t, '.', '')) + 2 AS INTEGER)) || ' ' || t, '-' || chr(10), ''), chr(10), ' ') AS title FROM r"""

QUERIES = {
    f.__name__: f
    for f in (
        text_blocks, text_markup, text_spacing, section_titles, tiny_symbols, orientation_labels, argmax_steps, ctc_decode, base_decode, top_classes, compact_rows, banned_tokens, char_boxes, postprocess_lines, postprocess_markdown, parsed_text, truncated_text, tail_cut_text,
        latex_text, reversed_text, table_otsl, table_formats, table_grids, layout_lines, ratio_splits, vl_titles,
    )
}
