"""Class tables of detector families, and their thresholds and merge modes, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_17 = "paragraph_title image text number abstract content figure_title formula table table_title reference doc_title footnote header algorithm footer seal"
_25 = (
    "abstract algorithm aside_text chart content display_formula doc_title figure_title footer footer_image footnote formula_number header header_image image inline_formula number paragraph_title reference reference_content seal table text vertical_text vision_footnote"
)
#: family: (width, height of input, whether scores are clamped, labels in class order)
FAMILIES = {
    "basic_5": (608, 800, False, "text title list table figure"),
    "table_1": (608, 800, False, "table"),
    "coarse_3_small": (480, 480, False, "image table seal"),
    "coarse_3_large": (640, 640, False, "image table seal"),
    "coarse_3_transformer": (640, 640, True, "figure table seal"),
    "page_17_small": (480, 480, False, _17),
    "page_17_large": (640, 640, False, _17),
    "page_17_transformer": (640, 640, True, _17),
    "region_1": (640, 640, False, "region"),
    "page_20": (800, 800, False, "paragraph_title image text number abstract content figure_title formula table reference doc_title footnote header algorithm footer seal chart formula_number aside_text reference_content"),
    "page_23_small": (480, 480, False, f"{_17} chart_title chart formula_number header_image footer_image aside_text"),
    "page_23_medium": (640, 640, False, f"{_17} chart_title chart formula_number header_image footer_image aside_text"),
    "page_23_large": (640, 640, False, f"{_17} chart_title chart formula_number header_image footer_image aside_text"),
    "page_25": (800, 800, False, _25),
    "page_25_ordered": (800, 800, False, _25),
}
_LARGE_25 = {"chart", "display_formula", "doc_title", "inline_formula", "paragraph_title"}
_LOW_25 = {"display_formula": 0.4, "doc_title": 0.4, "inline_formula": 0.4, "paragraph_title": 0.4, "text": 0.4, "vertical_text": 0.4, "seal": 0.45}
_STRUCTURE = "paragraph_title image text number abstract content figure_table_chart_title formula table reference doc_title footnote header algorithm footer seal chart formula_number aside_text reference_content"
#: setting: (default threshold, class thresholds, class merge modes)
SETTINGS = {
    "generic": (0.5, {}, {}),
    "structure_thresholds": (0.3, {"paragraph_title": 0.3, "formula": 0.3, "text": 0.4, "seal": 0.45}, {}),
    "structure": (0.3, {"paragraph_title": 0.3, "formula": 0.3, "text": 0.4, "seal": 0.45}, {k: "large" if k in ("paragraph_title", "image", "formula", "chart") else "union" for k in _STRUCTURE.split()}),
    "page_25": (0.4, {k: _LOW_25.get(k, 0.5) for k in _25.split()}, {k: "large" if k in _LARGE_25 else "union" for k in _25.split()}),
    "page_25_ordered": (0.3, {}, {k: "large" if k in _LARGE_25 else "union" for k in _25.split()}),
}


def class_labels(spark: SparkSession) -> DataFrame:
    """(family, class_id, label) of every family."""
    rows = [(f, i, c) for f, (_, _, _, names) in FAMILIES.items() for i, c in enumerate(names.split())]
    return spark.createDataFrame(rows, "family string, class_id int, label string")


def class_settings(spark: SparkSession) -> DataFrame:
    """(setting, label, threshold, merge_mode); null where a class has the default."""
    rows = [(s, c, t.get(c), m.get(c)) for s, (_, t, m) in SETTINGS.items() for c in sorted({*t, *m})]
    return spark.createDataFrame(rows, "setting string, label string, threshold double, merge_mode string")
