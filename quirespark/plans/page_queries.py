"""Queries over whole pages and documents: stitching, tables, rendering, pipelines with stand-in models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import joins, lines, models, render, tables
from quirespark.plans import pipelines
from quirespark.plans.inputs import BOXES, boxes, table

SQL: dict[str, str] = {}
PAGE = ("doc_id", "page_idx")
#: tokens of a row of two cells
ROW = ("<tr>", *["<td></td>"] * 2, "</tr>")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(
        "doc_id", F.lit(0).alias("page_idx"), "idx", "kind", "label", F.col("score").alias("confidence"), "x1", "y1", "x2", "y2", "text", F.lit(None).cast("double").alias("seg_start_x"), F.lit(None).cast("double").alias("seg_end_x"), F.col("num_lines").cast("int").alias("num_lines"), F.col("idx").alias("rank")
    )


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.page_html(_elements(spark, sf_dir)).select("doc_id", "html")


SQL["page_html"] = f"""WITH {BOXES}, h AS (SELECT doc_id, idx, CASE
  WHEN kind = 'doc_title' THEN '<h1>' || coalesce(text, '') || '</h1>~' WHEN kind = 'paragraph_title' THEN '<h2>' || coalesce(text, '') || '</h2>~' WHEN kind = 'table' THEN '<p>[Table]</p>~'
  WHEN kind = 'formula' THEN '<p class="formula">$$' || coalesce(text, '') || '$$</p>~' WHEN kind IN ('image', 'chart') THEN '<figure>~<img alt="Figure" />~' || coalesce('<figcaption>' || text || '</figcaption>~', '') || '</figure>~'
  WHEN kind = 'figure_title' THEN coalesce('<figcaption>' || text || '</figcaption>~', '') WHEN kind = 'reference_content' THEN '<section class="references">~<p>' || coalesce(text, '') || '</p>~</section>~'
  WHEN kind = 'header' THEN '<header>' || coalesce(text, '') || '</header>~' WHEN kind = 'footnote' THEN '<footer>' || coalesce(text, '') || '</footer>~' ELSE coalesce('<p>' || text || '</p>~', '') END AS h FROM boxes)
SELECT doc_id, replace('<!DOCTYPE html>~<html>~<head>~<meta charset="UTF-8">~</head>~<body>~' || string_agg(h, '' ORDER BY idx) || '</body>~</html>', '~', chr(10)) AS html FROM h GROUP BY doc_id"""


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.page_markdown(_elements(spark, sf_dir)).select("doc_id", "markdown")


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.page_json(_elements(spark, sf_dir).select("doc_id", "page_idx", "idx", "kind", "text", "rank")).select("doc_id", "json")


def page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _elements(spark, sf_dir).withColumnRenamed("idx", "region_idx")
    return render.page_dump(b).select("doc_id", "dump")


def vl_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.vl_markdown(_elements(spark, sf_dir).withColumn("label", F.col("kind")), pretty=False).select("doc_id", "markdown")


def joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages, joined with continuation flags."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), F.coalesce("text", F.lit("")).alias("markdown"), (F.length("text") % 3 != 0).alias("para_start"), (F.length("text") % 2 == 0).alias("para_end"))
    return render.concat_pages(pages)


SQL["joined_documents"] = r"""WITH p AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS m, length(text) % 3 <> 0 AS s, length(text) % 2 = 0 AS e FROM conversations),
f AS (SELECT *, NOT s AND NOT coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY turn), true) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS r FROM f WHERE trim(m, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
j AS (SELECT doc_id, string_agg(CASE WHEN g THEN ' ' || regexp_replace(m, '^\s+', '') WHEN r = 1 THEN m ELSE chr(10) || chr(10) || m END, '' ORDER BY turn) AS m FROM k GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN any_value(f.n) = 1 THEN any_value(f.m) ELSE regexp_replace(coalesce(any_value(j.m), ''), '^\s+|\s+$', '', 'g') END AS markdown FROM f LEFT JOIN j ON f.doc_id = j.doc_id GROUP BY f.doc_id"""


def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-page export: joined pages, then post-processing."""
    return joined_documents(spark, sf_dir).withColumn("markdown", T.as_udf(T.postprocess_markdown)("markdown"))


def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the boxes that lie on each element, in lines."""
    e = _elements(spark, sf_dir)
    r = e.filter("idx % 2 = 0").select("doc_id", "page_idx", F.col("idx").alias("region_idx"), "x1", "y1", "x2", "y2", "text", "confidence", "label")
    out = lines.stitch_elements(e.filter("idx % 2 = 1").withColumn("text", F.lit(None).cast("string")), r, False)
    return out.select("doc_id", "idx", "text", "num_lines", F.round("seg_start_x", 6).alias("seg_start_x"), F.round("seg_end_x", 6).alias("seg_end_x"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts looked up for token slots by row and column, the last of equal slots."""
    b = boxes(spark, sf_dir)
    cells = b.select("doc_id", (F.col("idx") - 1).alias("idx"), F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("y1") / 20).cast("int")).alias("row"), F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("x1") / 40).cast("int")).alias("col"), "text")
    slots = b.select("doc_id", (F.col("idx") - 1).alias("pos"), F.expr("(idx - 1) div 2").cast("int").alias("row"), ((F.col("idx") - 1) % 2).alias("col"))
    return joins.grid_lookup(slots, cells, ["doc_id"]).select("doc_id", "pos", "text")


SQL["cell_texts"] = f"""WITH {BOXES}, c AS (SELECT doc_id, idx - 1 AS idx, CASE WHEN doc_id % 7 <> 0 THEN CAST(floor(y1 / 20) AS INTEGER) END AS row, CASE WHEN doc_id % 7 <> 0 THEN CAST(floor(x1 / 40) AS INTEGER) END AS col, text FROM boxes),
s AS (SELECT doc_id, idx - 1 AS pos, CAST((idx - 1) // 2 AS INTEGER) AS row, (idx - 1) % 2 AS col FROM boxes), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row, col ORDER BY idx DESC) AS n FROM c WHERE row IS NOT NULL)
SELECT s.doc_id, s.pos, CASE WHEN s.doc_id % 7 <> 0 THEN l.text ELSE p.text END AS text FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND s.row = l.row AND s.col = l.col AND l.n = 1 LEFT JOIN c p ON s.doc_id = p.doc_id AND s.pos = p.idx"""


def checkboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    mark = F.element_at(F.array(*[F.lit(x) for x in ("L", "x", "ü", "✖", "yes", " X ", "✓")]), (F.col("idx") * 3 % 7 + 1).cast("int"))
    return tables.checkbox(b.select("doc_id", "idx", mark.alias("text")), ["doc_id"])


SQL["checkboxes"] = f"""WITH {BOXES}, m AS (SELECT doc_id, idx, list_extract(['L', 'x', 'ü', '✖', 'yes', ' X ', '✓'], CAST(idx * 3 % 7 + 1 AS INTEGER)) AS text FROM boxes),
w AS (SELECT *, trim(text) AS t, bool_or(trim(text) IN ('✓', 'ü', 'Ü', 'L', '√', '☑')) OVER (PARTITION BY doc_id) AND bool_or(trim(text) IN ('✗', 'X', 'x', '✕', '✖', '☒')) OVER (PARTITION BY doc_id) AS both_ FROM m)
SELECT doc_id, idx, CASE WHEN t IN ('ü', 'Ü', '√', '☑') OR (t = 'L' AND both_) THEN '✓' WHEN t IN ('✕', '✖', '☒') OR (t IN ('X', 'x') AND both_) THEN '✗' ELSE text END AS text FROM w"""


def _table_rows(spark: SparkSession, sf_dir: str):
    """(tables of 2 x 2 cells over the page, their cells, text regions)."""
    b = boxes(spark, sf_dir).withColumn("page_idx", F.lit(0))
    # by doc_id alone: a constant among the keys would part these rows from the boxes, which lie by it
    ids = b.select("doc_id").distinct().withColumn("page_idx", F.lit(0))
    tokens = F.array(*[F.lit(t) for t in ("<table>", *ROW, *ROW, "</table>")])
    t = ids.select("doc_id", "page_idx", F.lit(0).alias("table_idx"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(140.0).alias("x2"), F.lit(120.0).alias("y2"), tokens.alias("tokens"), (F.col("doc_id") % 3 == 0).alias("is_e2e"), F.lit(False).alias("has_detected"))
    cells = ids.withColumn("cell_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    row, col = F.expr("cell_idx div 2").cast("int"), (F.col("cell_idx") % 2).cast("int")
    c = cells.select("doc_id", "page_idx", F.lit(0).alias("table_idx"), "cell_idx", (col * 70.0).alias("x1"), (row * 60.0).alias("y1"), (col * 70.0 + 70.0).alias("x2"), (row * 60.0 + 60.0).alias("y2"), row.alias("row"), col.alias("col"), F.lit(None).cast("string").alias("text"))
    r = b.select("doc_id", "page_idx", F.col("idx").alias("region_idx"), "x1", "y1", "x2", "y2", "text", F.col("score").alias("confidence"), "label")
    return t, c, r


def filled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c, r = _table_rows(spark, sf_dir)
    return tables.stitch_tables(t, c, r).select("doc_id", "html", "cells", F.size("used_regions").alias("n_used"))


def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and text boxes to ordered elements and Markdown."""
    t, c, r = _table_rows(spark, sf_dir)
    d = boxes(spark, sf_dir).select("doc_id", F.lit(0).alias("page_idx"), "idx", "label", "score", "x1", "y1", "x2", "y2")
    return pipelines.structure(d, r, t, c)["markdown"].select("doc_id", "markdown")


class Painter:
    """Stand-in models over pixmaps: dark runs are text, a crop reads as its size."""

    batch_size = 16

    def __init__(self, task: str):
        self.task = task

    def execute(self, items):
        from quirespark.functions.pixels import boxes_from_map, decode, gray

        out = []
        for i in items:
            image = decode(bytes(i["content"]))
            h, w = image.shape[:2]
            if self.task == "text_detection":
                found = boxes_from_map((gray(image) < 128).astype(float), w, h, least_score=0.3)
                out.append([{"x1": float(q[:, 0].min()), "y1": float(q[:, 1].min()), "x2": float(q[:, 0].max()), "y2": float(q[:, 1].max()), "score": s, "poly": [{"x": float(x), "y": float(y)} for x, y in q]} for q, s in found])
            elif self.task == "table_structure":
                cells = [[0.0, 0.0, w / 2, h], [w / 2, 0.0, float(w), h]]
                out.append({"tokens": list(ROW), "boxes": cells, "score": 0.8})
            elif self.task == "formula_recognition":
                out.append({"latex": f"x _ {w}", "score": 0.7})
            else:
                out.append({"text": f"{w}x{h}", "score": 0.9})
        return out


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages painted from the first boxes of customers' nations: three dark bars a page."""

    def run(batches):
        import numpy as np
        import pandas as pd

        from quirespark.functions.pixels import encode

        for b in batches:
            rows = []
            for k in b["n_nationkey"]:
                image = np.full((120, 160, 3), 255, np.uint8)
                for j in range(3):
                    image[15 + 35 * j : 25 + 35 * j, 20 : 60 + 4 * int(k) % 80 + 10 * j] = 0
                rows.append((int(k), 0, encode(image), 160, 120))
            yield pd.DataFrame(rows, columns=["doc_id", "page_idx", "content", "width", "height"])

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "doc_id int, page_idx int, content binary, width int, height int")


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, ordering, cropping and pooled recognition of painted pages."""
    out = pipelines.ocr(_painted(spark, sf_dir), lambda: Painter("text_detection"), lambda: Painter("text_recognition"))
    return out.select("doc_id", "region_idx", "x1", "y1", "x2", "y2", "text")


def _painted_layout(pages: DataFrame) -> DataFrame:
    bars = pages.select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    y = F.col("idx") * 30.0 + 5.0
    return bars.select("doc_id", "page_idx", "idx", F.element_at(F.array(*[F.lit(k) for k in ("text", "table", "formula", "text")]), F.col("idx") + 1).alias("kind"), F.lit(5.0).alias("x1"), y.alias("y1"), F.lit(80.0).alias("x2"), (y + 28.0).alias("y2"))


def ocr_under_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection parted by layout blocks, read, and refined block by block."""
    pages = _painted(spark, sf_dir)
    out = pipelines.overall_ocr(pages, _painted_layout(pages), lambda: Painter("text_detection"), lambda: Painter("text_recognition"))
    return out.select("doc_id", "region_idx", "x1", "y1", "x2", "y2", "text")


def table_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and formulas of a layout through their models, cells on the page."""
    pages = _painted(spark, sf_dir)
    layout = _painted_layout(pages)
    t, c = pipelines.analysed_tables(layout, pages, lambda: Painter("table_structure"))
    f = pipelines.recognised_formulas(layout, pages, lambda: Painter("formula_recognition")).select("doc_id", "page_idx", "latex")
    joined = t.select("doc_id", "page_idx", "table_idx", "confidence").join(c, ["doc_id", "page_idx", "table_idx"]).join(f, ["doc_id", "page_idx"])
    return joined.select("doc_id", "cell_idx", "row", "col", "x1", "x2", "latex", "confidence")


SQL["table_models"] = """SELECT n_nationkey AS doc_id, CAST(c AS INTEGER) AS cell_idx, 0 AS row, CAST(c AS INTEGER) AS col, 5 + c * 37.5::DOUBLE AS x1, 5 + (c + 1) * 37.5::DOUBLE AS x2, 'x_75' AS latex, 0.8::DOUBLE AS confidence FROM nation, (SELECT unnest([0, 1]) AS c)"""


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout-first parsing of painted pages, some without layout."""
    pages = _painted(spark, sf_dir)
    layout = pages.filter("doc_id % 5 <> 0").select("doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    y = F.col("idx") * 35.0 + 10.0
    d = layout.select("doc_id", "page_idx", "idx", F.when(F.col("idx") == 0, "paragraph_title").otherwise("text").alias("label"), F.lit(0.9).alias("score"), F.lit(10.0).alias("x1"), y.alias("y1"), F.lit(150.0).alias("x2"), (y + 20.0).alias("y2"))
    return pipelines.parse_layout(d, pages, lambda: Painter("region_recognition")).select("doc_id", "markdown")


SQL["parsed_pages"] = """SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 5 = 0 THEN '160x120' ELSE '## 140 x20' || chr(10) || chr(10) || '140x20' || chr(10) || chr(10) || '140x20' END AS markdown FROM nation"""

QUERIES = {f.__name__: f for f in (page_html, page_markdown, page_json, page_dump, vl_markdown, joined_documents, document_markdown, element_texts, cell_texts, checkboxes, filled_tables, page_structure, ocr_pages, ocr_under_layout, table_models, parsed_pages)}
