"""Queries over what the other modules do not reach: small rules, checks, image geometry, files. Each has its SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions import sequences as S
from quirespark.functions import text as T
from quirespark.functions.geometry import Box
from quirespark.operators import models, suppress, tables, windows
from quirespark.operators.settle import shared_folder
from quirespark.plans import pipelines, text_sql
from quirespark.plans.inputs import BOXES, HYPHENS, LOGITS, boxes, hyphened, logits, sides, table
from quirespark.plans.page_queries import Painter, _painted
from quirespark.plans.text_queries import _steps, table_otsl
from quirespark.sources import assets, images, sinks

SQL: dict[str, str] = {}
DOC = ["doc_id"]
SIGNS = (",", ".", ":", "a", "、", ";", "Z")


def box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of two boxes by mode, coordinates scaled, clamped and in thousandths."""
    b = boxes(spark, sf_dir)
    mode = F.element_at(F.array(*[F.lit(m) for m in ("large", "small", "union")]), (F.col("idx") % 3 + 1).cast("int"))
    other = Box(F.col("x1") + 5, F.col("y1") + 3, F.col("x2") + F.col("idx") % 2 * 9, F.col("y2") - 1)
    m = G.merge_box(Box.of(), other, mode)
    n = G.normalise_thousandths(F.col("x2") * 10, F.col("y1") * 12 - 50, F.col("x1") * 10, F.col("y2") * 12 - 50)
    pair = F.array("x1", "y2")
    return b.select("doc_id", "idx", *[m[c].alias("m_" + c) for c in ("x1", "y1", "x2", "y2")], *[F.round(n[c], 6).alias("n_" + c) for c in ("x1", "y1", "x2", "y2")], F.get(G.scale_coords(pair, F.lit(1.5)), 1).alias("scaled"), F.get(G.clamp_coords(pair, 10.0, 50.0), 0).alias("clamped_x"), F.get(G.clamp_coords(pair, 10.0, 50.0), 1).alias("clamped_y"))


_PICK = {"x1": ("x1", "x1 + 5", "least"), "y1": ("y1", "y1 + 3", "least"), "x2": ("x2", "x2 + idx % 2 * 9", "greatest"), "y2": ("y2", "y2 - 1", "greatest")}
_ONE, _TWO = "(x2 - x1) * (y2 - y1)", "(x2 + idx % 2 * 9 - x1 - 5) * (y2 - y1 - 4)"
_INSIDE = "least(x1 * 10, y1 * 12 - 50) >= 0 AND greatest(x2 * 10, y2 * 12 - 50) <= 1000"
SQL["box_rules"] = f"""WITH {BOXES} SELECT doc_id, idx, {', '.join(f"CASE idx % 3 WHEN 0 THEN CASE WHEN {_ONE} >= {_TWO} THEN {a} ELSE {b} END WHEN 1 THEN CASE WHEN {_ONE} <= {_TWO} THEN {a} ELSE {b} END ELSE {f}({a}, {b}) END AS m_{c}" for c, (a, b, f) in _PICK.items())},
  {', '.join(f"CASE WHEN {_INSIDE} THEN round(({v}) / 1000, 6) END AS n_{c}" for c, v in (('x1', 'x1 * 10'), ('y1', 'y1 * 12 - 50'), ('x2', 'x2 * 10'), ('y2', 'y2 * 12 - 50')))},
  y2 * 1.5::DOUBLE AS scaled, least(greatest(x1, 10.0::DOUBLE), 50.0::DOUBLE) AS clamped_x, least(greatest(y2, 10.0::DOUBLE), 50.0::DOUBLE) AS clamped_y FROM boxes"""


def region_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their confidence, block types, prompts, structure and the characters that end lines."""
    b = boxes(spark, sf_dir)
    sure = F.when(F.col("idx") % 4 != 0, F.col("score"))
    told = E.text_with_confidence(F.col("text"), sure)
    sign = F.element_at(F.array(*[F.lit(x) for x in SIGNS]), (F.col("idx") % 7 + 1).cast("int"))
    cells = F.when(F.col("idx") % 2 == 0, F.array(F.lit(1))).when(F.col("idx") % 3 == 0, F.array().cast("array<int>"))
    return b.select(
        "doc_id", "idx", told["text"].alias("told"), told["confidence"].alias("confidence"), F.when(told["confidence"] >= 0.05, told["text"]).alias("confident"), E.is_block_type(F.col("kind")).alias("block_type"),
        T.block_prompt(F.when(F.col("kind") == "formula", "equation").otherwise(F.col("kind"))).alias("prompt"), E.has_structure(cells, F.when(F.col("idx") % 5 == 0, "<table>")).alias("structured"), E.is_breakless_end(sign).alias("breakless"), T.needs_space_after(sign).alias("spaced"),
    )


SQL["region_rules"] = f"""WITH {BOXES} SELECT doc_id, idx, CASE WHEN idx % 4 <> 0 THEN text END AS told, CASE WHEN idx % 4 <> 0 AND text IS NOT NULL THEN score END AS confidence, CASE WHEN idx % 4 <> 0 AND score >= 0.05::DOUBLE THEN text END AS confident, kind IN ('text', 'table', 'image', 'header') AS block_type,
  chr(10) || CASE kind WHEN 'table' THEN 'Table' WHEN 'formula' THEN 'Formula' ELSE 'Text' END || ' Recognition:' AS prompt, idx % 2 = 0 OR idx % 5 = 0 AS structured, idx % 7 IN (0, 2, 4, 5) AS breakless, idx % 7 IN (3, 6) AS spaced FROM boxes"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words parted, footnotes, formulas without their marks, paragraphs without pictures: over whole texts."""
    t = F.col("text")
    pictured = F.replace(t, F.lit("\n"), F.lit('\n\n <img src="images/bbox_9.png"> x\n\n'))
    return hyphened(spark, sf_dir).select(
        "doc_id", T.merged_words_parted(t).alias("parted"), T.footnote_block(t).alias("footnote"), T.math_unwrapped(F.concat(F.lit(" $$$ "), t, F.lit(" $$$ "))).alias("bare"),
        T.formula_unwrapped(F.concat(F.lit(r" \[ "), t, F.lit(r"\] "))).alias("formula"), T.image_tags_dropped(pictured).alias("unpictured"),
    )


def _parted(x: str) -> str:
    g = text_sql._g  # noqa: SLF001
    x = g(x, "(''[a-z])([a-z])", r"\1 \2")
    for found in ("([a-z])([A-Z][a-z])", "([A-Za-z])([0-9][A-Za-z])"):
        x = g(g(x, found, r"\1 \2"), found, r"\1 \2")
    return g(x, "([0-9%])([A-Z])", r"\1 \2")


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
SQL["text_rules"] = rf"""WITH {HYPHENS}, s AS (SELECT doc_id, text, {_TRIM('text')} AS t FROM texts)
SELECT doc_id, {_parted('text')} AS parted, replace(replace(replace(text, '-' || chr(10), ''), chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10)) AS footnote, t AS bare,
  CASE WHEN starts_with(t, '$') AND ends_with(t, '$') THEN t ELSE '$$' || t || '$$' END AS formula,
  array_to_string(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10) || ' <img src="images/bbox_9.png"> x' || chr(10) || chr(10)), chr(10) || chr(10)), lambda p: NOT regexp_matches(p, '^\s*<img src="images/bbox_')), chr(10) || chr(10)) AS unpictured FROM s"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated headings of a document dropped; every third line is made a heading of its first letter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    head = F.concat(F.lit("\t**"), F.substring("line", 1, 1), F.lit("x** \t"))
    made = rows.withColumn("line", F.when(F.col("pos") % 3 == 0, head).otherwise(F.col("line")))
    return suppress.dedup_sections(made, DOC).select("doc_id", "pos", "line")


SQL["sections"] = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN chr(9) || '**' || substring(line, 1, 1) || 'x** ' || chr(9) ELSE line END AS line FROM l), h AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM m),
n AS (SELECT *, regexp_matches(t, '^\*\*.+\*\*$') AND row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) > 1 AS again FROM h) SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM n WHERE NOT again"""


def nearest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest right edge of a page's odd boxes to each left edge of its even ones."""
    e, r = sides(spark, sf_dir)
    return windows.nearest(e.select("doc_id", "idx", F.col("x1").alias("value")), r.select("doc_id", F.col("idx").alias("pos_idx"), F.col("x2").alias("position")), DOC)


SQL["nearest_edges"] = f"""WITH {BOXES}, p AS (SELECT e.doc_id, e.idx, e.x1 AS value, r.idx AS nearest, row_number() OVER (PARTITION BY e.doc_id, e.idx ORDER BY abs(e.x1 - r.x2), r.idx) AS n FROM boxes e JOIN boxes r ON e.doc_id = r.doc_id AND e.idx % 2 = 0 AND r.idx % 2 = 1)
SELECT doc_id, idx, value, nearest FROM p WHERE n = 1"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crops at most of each aspect bucket of a page."""
    b = boxes(spark, sf_dir).select("doc_id", "idx", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return windows.bucketed(b, 2, "idx", DOC).select("doc_id", "idx", "bucket")


SQL["bucketed"] = f"""WITH {BOXES}, r AS (SELECT doc_id, idx, (x2 - x1) / greatest(y2 - y1, 1) AS ratio FROM boxes), n AS (SELECT *, CASE WHEN ratio < 0.8 THEN 'tall' WHEN ratio < 1.2 THEN 'square' WHEN ratio < 2.5 THEN 'normal' WHEN ratio < 4.5 THEN 'wide' ELSE 'ultra_wide' END AS bucket FROM r)
SELECT doc_id, idx, bucket FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY idx) AS k FROM n) WHERE k <= 2"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores within bounds, equal lengths, finite values and shapes; all of it as one chain."""
    def holes(frame: DataFrame) -> DataFrame:
        return frame.withColumn("scores", F.transform("scores", lambda v, i: F.when((F.col("t") == 4) & (i == 2), F.lit(None)).otherwise(v)))

    def judged(frame: DataFrame) -> DataFrame:
        odd = F.when(F.col("t") == 5, float("nan")).when(F.col("t") == 6, float("inf")).otherwise(F.get("scores", 0))
        shape = F.struct(F.lit(2).alias("c"), F.lit(2).alias("h"), (F.col("t") % 3).alias("w"))
        values = F.slice("scores", F.lit(1), F.col("t") % 3 * 4)
        return frame.select("seq", "t", models.scores_valid(F.col("scores"), -0.2, 0.2).alias("scored"), models.same_length(F.col("scores"), values).alias("alike"), models.finite(odd).alias("finite"), models.shapes_valid(values, shape).alias("shaped"))

    return models.validated(models.chain(holes, judged)(logits(spark, sf_dir)), numbered=F.col("t") >= 0)


SQL["checks"] = f"""WITH {LOGITS} SELECT seq, t, t <> 4 AND len(list_filter(scores, lambda v: v < -0.2 OR v > 0.2)) = 0 AS scored, t % 3 * 4 = 8 AS alike, t NOT IN (5, 6) AS finite, t % 3 > 0 AS shaped FROM steps"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even boxes cut along x at the odd boxes of their page."""
    e, r = sides(spark, sf_dir)
    held = r.groupBy("doc_id").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("cells"))
    rows = e.select("doc_id", "idx", F.array("x1", "y1", "x2", "y2").alias("box")).join(held, "doc_id")

    @F.pandas_udf("array<struct<x1:double,x2:double>>")
    def cut(box: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([[{"x1": float(p[0]), "x2": float(p[2])} for p in tables.segments_over_cells(tuple(b), [tuple(c) for c in cs])] for b, cs in zip(box, cells)])

    return rows.select("doc_id", "idx", F.posexplode(cut("box", "cells")).alias("n", "p")).select("doc_id", "idx", "n", "p.x1", "p.x2")


# along x the cells' edges inside a box part it; what lies over a cell starts at the cell, not where the last one ended
SQL["pieces"] = f"""WITH RECURSIVE {BOXES}, c AS (SELECT e.doc_id, e.idx, e.x1, e.x2, greatest(r.x1, e.x1) AS lo, least(r.x2, e.x2) AS hi, row_number() OVER (PARTITION BY e.doc_id, e.idx ORDER BY r.x1, r.idx) AS k FROM boxes e JOIN boxes r ON e.doc_id = r.doc_id AND e.idx % 2 = 0 AND r.idx % 2 = 1),
s AS (SELECT doc_id, idx, 0 AS k, any_value(x1) AS pos, CAST([] AS STRUCT(x1 DOUBLE, x2 DOUBLE)[]) AS got FROM c GROUP BY doc_id, idx
  UNION ALL SELECT c.doc_id, c.idx, c.k, greatest(s.pos, c.hi), list_concat(list_concat(s.got, CASE WHEN c.lo > s.pos THEN [{{'x1': s.pos, 'x2': c.lo}}] ELSE [] END), CASE WHEN c.hi > c.lo THEN [{{'x1': c.lo, 'x2': c.hi}}] ELSE [] END) FROM s JOIN c ON c.doc_id = s.doc_id AND c.idx = s.idx AND c.k = s.k + 1),
e AS (SELECT doc_id, idx, arg_max(pos, k) AS pos, arg_max(got, k) AS got FROM s GROUP BY doc_id, idx),
f AS (SELECT e.doc_id, e.idx, CASE WHEN e.pos < b.x2 THEN list_append(e.got, {{'x1': e.pos, 'x2': b.x2}}) ELSE e.got END AS got FROM e JOIN boxes b ON e.doc_id = b.doc_id AND e.idx = b.idx),
u AS (SELECT doc_id, idx, unnest(got) AS p, generate_subscripts(got, 1) AS n FROM f), d AS (SELECT doc_id, idx, p.x1 AS x1, p.x2 AS x2, min(n) AS n FROM u GROUP BY doc_id, idx, p.x1, p.x2)
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY n) - 1 AS INTEGER) AS n, x1, x2 FROM d"""


def vote_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading ranks from pair votes made of the class scores."""
    at = F.sequence(F.lit(0), F.lit(7))
    votes = F.transform(at, lambda i: F.transform(at, lambda j: F.get("scores", i) * (i + 1) * 8 - F.get("scores", j) * 8))
    return logits(spark, sf_dir).select("seq", "t", F.array_join(F.transform(S.order_ranks(votes), lambda v: v.cast("string")), ",").alias("ranks"))


SQL["vote_ranks"] = f"""WITH {LOGITS}, u AS (SELECT seq, t, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS i FROM steps),
g AS (SELECT b.seq, b.t, b.i AS j, sum(CASE WHEN a.i < b.i THEN 1 / (1 + exp(-(a.s * (a.i + 1) * 8 - b.s * 8))) ELSE 1 - 1 / (1 + exp(-(b.s * (b.i + 1) * 8 - a.s * 8))) END) AS gained FROM u a JOIN u b ON a.seq = b.seq AND a.t = b.t AND a.i <> b.i GROUP BY b.seq, b.t, b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY seq, t ORDER BY gained, j) - 1 AS k FROM g) SELECT seq, t, string_agg(CAST(k AS VARCHAR), ',' ORDER BY j) AS ranks FROM r GROUP BY seq, t"""


def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best tokens of each sequence read as a table model's output."""
    words = S.table_vocabulary(["<table>", "<tr>", "<td>", "</tr> ", "</table>", "<td", ""])

    @F.pandas_udf("struct<tokens:string,n_cells:int,score:double>")
    def read(tokens: pd.Series, probs: pd.Series) -> pd.DataFrame:
        got = [S.decode_structure(list(zip(t, p)), [[float(k)] for k in range(len(t))], words) for t, p in zip(tokens, probs)]
        return pd.DataFrame({"tokens": [" ".join(t) for t, _, _ in got], "n_cells": [len(c) for _, c, _ in got], "score": [float(s) for _, _, s in got]})

    out = read("tokens", "probs")
    return _steps(spark, sf_dir).select("seq", out.alias("o")).select("seq", "o.tokens", "o.n_cells", F.round("o.score", 6).alias("score"))


SQL["structure_tokens"] = f"""WITH {LOGITS}, a AS (SELECT seq, t, CAST(8 - list_position(list_reverse(scores), list_max(scores)) AS INTEGER) AS token, list_max(scores) AS prob FROM steps),
e AS (SELECT seq, coalesce(min(t) FILTER (token = 7 AND t > 0), 99) AS stop FROM a GROUP BY seq), k AS (SELECT a.* FROM a JOIN e ON a.seq = e.seq WHERE t < stop AND token NOT IN (0, 7))
SELECT e.seq, coalesce(string_agg(list_extract(['<table>', '<tr>', '</tr>', '</table>', '<td', '<td></td>'], token), ' ' ORDER BY t), '') AS tokens, CAST(count(*) FILTER (token IN (5, 6)) AS INTEGER) AS n_cells, round(coalesce(avg(prob), 0.0::DOUBLE), 6) AS score FROM e LEFT JOIN k ON e.seq = k.seq GROUP BY e.seq"""


def table_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised table texts as markup: cell tokens with blanks about them."""
    t = table_otsl(spark, sf_dir)
    return t.select("doc_id", T.as_udf(S.table_output)(F.concat(F.lit(" \n"), "otsl", F.lit("  "))).alias("html"))


SQL["table_outputs"] = f"SELECT doc_id, html FROM ({text_sql.SQL['table_otsl']})"


def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text regions of painted pages over two cells, cut at the cells' edges and read again; the third bar meets one cell."""
    pages = _painted(spark, sf_dir)
    bars = pages.select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("region_idx"))
    y = F.col("region_idx") * 35.0 + 15.0
    regions = bars.select("doc_id", "page_idx", "region_idx", F.lit(20.0).alias("x1"), y.alias("y1"), F.lit(80.0).alias("x2"), (y + 10).alias("y2"), F.lit("old").alias("text"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("label"))
    cells = regions.select("doc_id", "page_idx", "region_idx", F.explode(F.array(F.lit(22.0), F.lit(40.0))).alias("x1"), "y1", "y2").filter("region_idx < 2 or x1 < 30").select("doc_id", "page_idx", "x1", "y1", (F.col("x1") + 10).alias("x2"), "y2")
    return pipelines.split_by_cells(regions, cells, pages, lambda: Painter("text_recognition")).select("doc_id", "region_idx", "x1", "y1", "x2", "y2", "text")


SQL["split_regions"] = """WITH b AS (SELECT n_nationkey AS doc_id, unnest([0, 1, 2]) AS j FROM nation), p AS (SELECT unnest([0, 1, 2, 3, 4]) AS n, unnest([20, 22, 32, 40, 50]) AS a, unnest([22, 32, 40, 50, 80]) AS b)
SELECT doc_id, CAST(j * 1000 + 100000 + n AS INTEGER) AS region_idx, CAST(p.a AS DOUBLE) AS x1, CAST(15 + 35 * j AS DOUBLE) AS y1, CAST(p.b AS DOUBLE) AS x2, CAST(25 + 35 * j AS DOUBLE) AS y2, (p.b - p.a) || 'x10' AS text FROM b, p WHERE j < 2
UNION ALL SELECT doc_id, CAST(j AS INTEGER), 20.0::DOUBLE, 85.0::DOUBLE, 80.0::DOUBLE, 95.0::DOUBLE, 'old' FROM b WHERE j = 2"""


def image_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, sizes, frames, masks and tensors of painted pages, by numbers that show them."""
    def run(batches):
        import numpy as np

        from quirespark.functions import pixels as P

        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"]):
                image = P.decode(bytes(content))
                right = 60 + 4 * int(doc) % 80
                bar = [(right, 25), (20, 15), (right, 15), (20, 25)]
                quads = P.crop_quads(image, [bar, [(10, 5), (30, 5), (30, 110), (10, 110)], [(5, 5)] * 4])
                ink = P.crop_margin(image)
                frame = P.letterbox(image, 64, 64, (1, 2, 3))
                tensor = P.to_tensor([image, image], bgr=True)
                planes = np.transpose(image[..., ::-1] / 255.0, (2, 0, 1))[None]
                stacked = P.stack_vertically(P.crop_many(image, [(20, 15, 30.5, 25), (0, 0, 50, 5)]), ["right"])
                formula = P.formula_tensor(image)
                rows.append((
                    int(doc), f"{quads[0].shape[1]}x{quads[0].shape[0]}", float(quads[0].mean()), f"{quads[1].shape[1]}x{quads[1].shape[0]}", quads[2] is None, f"{ink.shape[1]}x{ink.shape[0]}", "%dx%d" % P.detection_size(ink.shape[1], ink.shape[0], 64), "%dx%d" % P.recognition_size(ink.shape[1], ink.shape[0], 32), "%dx%d" % P.factor_size(ink.shape[1], ink.shape[0]),
                    int((frame == (1, 2, 3)).all(axis=2).sum()), int((P.mask(image, [(0, 0, 50, 50), (-5, -5, 2, 300)]) == 0).all(axis=2).sum()), f"{stacked.shape[1]}x{stacked.shape[0]}", int((stacked[:10] == 0).all(axis=2).sum(axis=0).nonzero()[0][0]), float(tensor[1, 2, 0, 0]), bool((P.rectified(planes)[0] == image).all()), "x".join(map(str, formula.shape)),
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "bar", "bar_mean", "turned", "flat", "ink", "detector", "line", "factor", "framed", "left_dark", "stacked", "stacked_at", "white", "rectified", "formula"])

    return _painted(spark, sf_dir).select("doc_id", "content").mapInPandas(run, "doc_id int, bar string, bar_mean double, turned string, flat boolean, ink string, detector string, line string, factor string, framed int, left_dark int, stacked string, stacked_at int, white double, rectified boolean, formula string").withColumn("white", F.round("white", 4)).withColumn("bar_mean", F.round("bar_mean", 4))


_FIT = lambda v, m: f"greatest(CAST(round_even({v} / {m}, 0) AS INTEGER) * {m}, {m})"
SQL["image_geometry"] = f"""WITH n AS (SELECT n_nationkey AS doc_id, 4 * n_nationkey % 80 AS k FROM nation), s AS (SELECT *, 60 + k AS w, 80 AS h FROM n), r AS (SELECT *, CASE WHEN greatest(w, h) > 64 THEN 64.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS ratio FROM s)
SELECT doc_id, (40 + k) || 'x10' AS bar, 0.0::DOUBLE AS bar_mean, '105x20' AS turned, true AS flat, w || 'x' || h AS ink, {_FIT('(w * ratio)', 32)} || 'x' || {_FIT('(h * ratio)', 32)} AS detector, CAST(ceil(32 * (w / CAST(h AS DOUBLE))) AS INTEGER) || 'x32' AS line, {_FIT('CAST(w AS DOUBLE)', 28)} || 'x' || {_FIT('CAST(h AS DOUBLE)', 28)} AS factor,
  64 * 16 AS framed, CAST(10 * (3 * (40 + k) + 30) - 300 AS INTEGER) AS left_dark, '50x15' AS stacked, 39 AS stacked_at, round(CAST((1 - 0.406) / 0.225 AS DOUBLE), 4) AS white, true AS rectified, '1x1x192x672' AS formula FROM r"""


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all tasks see, as a plain path."""
    return f"{shared_folder(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"


def _written_pages(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """(name, content) of painted pages, put as files into a folder of a mounted file system."""
    def put(batches):
        import os

        for b in batches:
            os.makedirs(folder, exist_ok=True)
            names = []
            for doc, content in zip(b["doc_id"], b["content"]):
                names.append(f"page_{doc}.ppm")
                # a task that is tried again replaces the whole file
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, os.path.join(folder, names[-1]))
            yield pd.DataFrame({"name": names, "content": b["content"]})

    return _painted(spark, sf_dir).select("doc_id", "content").mapInPandas(put, "name string, content binary")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files read back by either reader and checked against a registry, all or nothing."""
    from quirespark.sources import datasource

    folder = _folder(spark, "pages")
    known = _written_pages(spark, sf_dir, folder).select("name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))
    known = spark.createDataFrame(known.collect(), known.schema)  # a row a nation
    datasource.register(spark)
    read = images.read_images(spark, folder, "*.ppm", strict=True)
    ok = assets.verify(read.select("path", "content"), known)
    again = spark.read.format("page_images").option("path", f"{folder}/*.ppm").option("files_per_partition", "8").load().select(sinks.stem(F.col("path")).alias("stem"), F.col("width").alias("again_width"))
    sized = assets.find(ok.select("path", "name", "ok"), known)
    return sized.join(read.select("path", "width", "height", "error"), "path").withColumn("stem", sinks.stem(F.col("path"))).join(again, "stem").select("stem", "width", "height", "again_width", "size", "ok", "error")


SQL["image_files"] = """SELECT 'page_' || n_nationkey AS stem, 160 AS width, 120 AS height, 160 AS again_width, CAST(15 + 160 * 120 * 3 AS BIGINT) AS size, true AS ok, CAST(NULL AS VARCHAR) AS error FROM nation"""


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a renderer makes of each file: as many as the file's first digit says, at most twice its size."""
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("/in/"), "n_name", F.lit(".pdf")).alias("path"), (F.col("n_nationkey") % 3).cast("string").cast("binary").alias("content"))
    source = images.PdfSource(lambda content: int(content), lambda content, n, most: (min(100 * n, most[0]), 50, content + b"/%d" % n))
    return source.pages(files, (150, 150)).select(sinks.stem(F.concat("path", F.lit("#"), F.col("page_no").cast("string"))).alias("stem"), sinks.page_name(F.col("page_no")).alias("page"), "width", "height", F.col("content").cast("string").alias("content"))


SQL["document_pages"] = """SELECT n_name || '_' || n AS stem, 'page_00' || n AS page, CAST(least(100 * n, 150) AS INTEGER) AS width, 50 AS height, (n_nationkey % 3) || '/' || n AS content FROM nation, (SELECT unnest([1, 2]) AS n) WHERE n <= n_nationkey % 3"""


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a dictionary file in order, and what the whole file holds."""
    folder = _folder(spark, "dictionary")
    table(spark, sf_dir, "nation").orderBy("n_name").select(F.concat(F.lit(" "), "n_name").alias("value")).coalesce(1).write.text(folder)
    n = len(images.read_whole(spark, folder))
    return images.read_dictionary(spark, folder).select("pos", "entry", F.lit(n).alias("file_chars"))


SQL["dictionaries"] = """SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS pos, ' ' || n_name AS entry, CAST(sum(length(n_name) + 2) OVER () AS INTEGER) AS file_chars FROM nation"""


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of pages and crops of their pictures, written and read back; picture names as the Markdown has them."""
    folder = _folder(spark, "export")
    pages = _painted(spark, sf_dir)
    e = pages.select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    y = F.col("idx") * 35.0 + 15.0
    e = e.select("doc_id", "page_idx", "idx", F.element_at(F.array(*[F.lit(k) for k in ("image", "text", "chart")]), F.col("idx") + 1).alias("kind"), F.lit(20.4).alias("x1"), y.alias("y1"), F.lit(60.5).alias("x2"), (y + 10).alias("y2"))
    markdown = pages.select("doc_id", "page_idx", F.concat(F.lit("# page "), F.col("doc_id").cast("string"), F.lit("\n\ntext")).alias("markdown"))
    sinks.export_markdown_with_images(e, markdown, images.crops(pages, e), folder)
    read = spark.read.text(f"{folder}/pages/markdown", wholetext=True).select(F.col("doc_id").cast("int").alias("doc_id"), F.col("page_idx").cast("int").alias("page_idx"), F.regexp_replace("value", "\n$", "").alias("markdown"))
    sinks.save_documents(read.select("doc_id", "markdown"), f"{folder}/documents")
    whole = spark.read.text(f"{folder}/documents", wholetext=True).select(F.col("doc_id").cast("int").alias("doc_id"), F.length("value").alias("document_chars"))
    pics = spark.read.parquet(f"{folder}/images").select("doc_id", "page_idx", F.col("path").alias("image"), F.length("content").alias("image_bytes"))
    return read.join(pics, ["doc_id", "page_idx"]).join(whole, "doc_id")


SQL["exports"] = """SELECT n_nationkey AS doc_id, 0 AS page_idx, '# page ' || n_nationkey || chr(10) || chr(10) || 'text' AS markdown, CAST(length('# page ' || n_nationkey) + 7 AS INTEGER) AS document_chars, 'imgs/img_in_' || kind || '_box_20_' || (15 + 35 * j) || '_60_' || (25 + 35 * j) || '.jpg' AS image, CAST(13 + 41 * 10 * 3 AS INTEGER) AS image_bytes
FROM nation, (SELECT unnest(['image', 'chart']) AS kind, unnest([0, 2]) AS j)"""


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a layout-first parse joined into documents and post-processed."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), F.coalesce("text", F.lit("")).alias("markdown"), (F.length("text") % 3 != 0).alias("para_start"), (F.length("text") % 2 == 0).alias("para_end"))
    return pipelines.document_markdown(pages)


SQL["whole_documents"] = text_sql.SQL["document_markdown"]

QUERIES = {
    f.__name__: f
    for f in (box_rules, region_rules, text_rules, sections, nearest_edges, bucketed, checks, pieces, vote_ranks, structure_tokens, table_outputs, split_regions, image_geometry, image_files, document_pages, dictionaries, exports, whole_documents)
}
