"""Layout element types: labels, categories, roles and predicates, as column expressions over type strings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: type: (semantic category, reading-order role)
TYPES = {
    "doc_title": ("title", "doc_title"), "paragraph_title": ("title", "paragraph_title"), "text": ("text", "normal_text"), "content": ("text", "paragraph_title"), "abstract": ("text", "normal_text"),
    "image": ("visual", "vision"), "table": ("table", "vision"), "chart": ("visual", "vision"), "formula": ("formula", "normal_text"),
    "figure_title": ("caption", "vision_title"), "table_title": ("caption", "vision_title"), "chart_title": ("caption", "vision_title"), "figure_table_chart_title": ("caption", "vision_title"),
    "header": ("header", "header"), "header_image": ("header", "header"), "footer": ("footer", "footer"), "footer_image": ("footer", "footer"), "footnote": ("footer", "footer"),
    "seal": ("special", "unordered"), "number": ("special", "unordered"), "reference": ("special", "reference"), "reference_content": ("special", "normal_text"), "algorithm": ("special", "vision"),
    "formula_number": ("formula", "unordered"), "aside_text": ("special", "unordered"), "list": ("list", "normal_text"), "region": ("region", "normal_text"), "other": ("other", "normal_text"),
}
SYNONYMS = {
    "title": "paragraph_title", "paragraph": "text", "vertical_text": "text", "figure": "image", "flowchart": "chart", "equation": "formula", "display_formula": "formula", "inline_formula": "formula",
    "caption": "figure_table_chart_title", "vision_footnote": "footnote",
}
CAPTIONS = ("figure_title", "table_title", "chart_title", "figure_table_chart_title")
AUXILIARY = tuple("aside_text footer footer_image footnote header header_image number".split())
OCR_TYPES = (*AUXILIARY, *CAPTIONS, *"abstract algorithm content doc_title list paragraph_title reference reference_content text".split())
ORDERED = ("text", "content", "abstract", "doc_title", "paragraph_title", "table", "image", "chart", "formula", "seal", "reference", "reference_content", "list", *CAPTIONS)
BLOCK_TYPES = tuple(
    "text title table image code algorithm header footer page_number page_footnote aside_text equation equation_block ref_text list phonetic table_caption image_caption code_caption table_footnote image_footnote unknown".split()
)
_BREAKLESS = [",", ";", ":", "，", "；", "：", "、"]


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items())), key)


def type_of(label: Column) -> Column:
    """Element type of a raw label in any case, synonyms included; unknown and null: other."""
    return F.coalesce(_lookup({t: t for t in TYPES} | SYNONYMS, F.lower(label)), F.lit("other"))


def category(kind: Column) -> Column:
    return F.coalesce(_lookup({t: c for t, (c, _) in TYPES.items()}, kind), F.lit("other"))


def order_role(kind: Column) -> Column:
    """The role that reading order starts from; scanning may turn it into a cross role."""
    return F.coalesce(_lookup({t: r for t, (_, r) in TYPES.items()}, kind), F.lit("normal_text"))


def is_title(kind: Column) -> Column:
    return kind.isin("doc_title", "paragraph_title")


def is_visual(kind: Column) -> Column:
    return kind.isin("image", "chart")


def is_caption(kind: Column) -> Column:
    return kind.isin(*CAPTIONS)


def is_header(kind: Column) -> Column:
    return kind.isin("header", "header_image")


def is_footer(kind: Column) -> Column:
    return kind.isin("footer", "footer_image", "footnote")


def is_formula(kind: Column) -> Column:
    return kind.isin("formula", "formula_number")


def should_ocr(kind: Column) -> Column:
    return kind.isin(*OCR_TYPES)


def is_auxiliary(kind: Column) -> Column:
    return kind.isin(*AUXILIARY)


def takes_order_index(kind: Column) -> Column:
    return kind.isin(*ORDERED)


def is_block_type(value: Column) -> Column:
    return value.isin(*BLOCK_TYPES)


def recognition_task(kind: Column) -> Column:
    """table, formula, chart or ocr; null for regions that are not recognised."""
    return F.when(kind.isin("image", "header_image", "footer_image", "seal"), F.lit(None)).when(kind.isin("table", "chart", "formula"), kind).otherwise("ocr")


def is_breakless_end(char: Column) -> Column:
    """Punctuation that ends a line without ending its sentence."""
    return char.isin(*_BREAKLESS)


def table_type(value: Column) -> Column:
    """wired, wireless or unknown in any case; null for any other name."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("wired", "wireless", "unknown"), v)


def class_setting(settings: dict[str, float | str], label: Column, default: float | str | None) -> Column:
    """A class's own threshold or merge mode, else the default."""
    own = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in settings.items())), label) if settings else F.lit(None)
    return F.coalesce(own, F.lit(default))


# -- text regions


def has(value: Column) -> Column:
    """Presence of text, confidence, orientation, word boxes or a label."""
    return value.isNotNull()


def is_formula_region(label: Column) -> Column:
    return label.eqNullSafe(F.lit("formula"))


def text_with_confidence(text: Column, confidence: Column) -> Column:
    return F.when(text.isNotNull() & confidence.isNotNull(), F.struct(text.alias("text"), confidence.alias("confidence")))


def table_confidence(classification: Column, structure: Column) -> Column:
    """The smaller of two confidences, or the one there is."""
    return F.least(classification, structure)


def has_structure(cells: Column, html: Column) -> Column:
    return (F.coalesce(F.size(cells), F.lit(0)) > 0) | html.isNotNull()


# -- detector rows


def is_valid_score(score: Column) -> Column:
    return ~F.isnan(score) & (score >= 0) & (score <= 1.0 + 1.1920929e-07)


def is_valid_class(raw: Column, classes: int) -> Column:
    finite = ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    return finite & (F.round(F.when(finite, raw)) >= 0) & (F.round(F.when(finite, raw)) < classes + 5)


def adjust_score(score: Column, clamps: bool) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) if clamps else score


def compact_prediction(row: Column, classes: int, clamps: bool = False) -> Column:
    """Struct (class_id, score, x1, y1, x2, y2) of a six-number detector row in whichever layout is valid first.

    Layouts: class, score, box; box, score, class; score, class, box. Null if none fits.
    """
    at = lambda i: F.try_element_at(row, F.lit(i + 1))

    def form(c: int, s: int, box: tuple[int, ...]) -> Column:
        good = (~F.isnan(at(s)) & (F.abs(at(s)) < float("inf"))) if clamps else is_valid_score(at(s))
        value = F.struct(F.round(at(c)).cast("int").alias("class_id"), adjust_score(at(s), clamps).alias("score"), *(at(i).alias(n) for i, n in zip(box, ("x1", "y1", "x2", "y2"))))
        return F.when((F.size(row) >= 6) & good & is_valid_class(at(c), classes), value)

    return F.coalesce(form(0, 1, (2, 3, 4, 5)), form(5, 4, (0, 1, 2, 3)), form(1, 0, (2, 3, 4, 5)))


# -- orientation labels


_ANGLES = {a: float(n) for n in ("0", "90", "180", "270") for a in (n, f"{n}.0", f"{n}°", f"{n}deg")} | {
    "normal": 0.0, "upright": 0.0, "right": 90.0, "clockwise": 90.0, "inverted": 180.0, "upside_down": 180.0, "left": 270.0, "counterclockwise": 270.0,
}


def orientation_angle(label: Column, valid: tuple[float, ...] = (0.0, 90.0, 180.0, 270.0)) -> Column:
    """Angle of a numeric or named label; null (uncertain, to be read as 0) if unknown or outside the valid set."""
    text = F.lower(F.trim(label))
    number = text.try_cast("double")
    near = lambda v: F.exists(F.array(*[F.lit(a) for a in valid]), lambda a: F.abs(v - a) < 0.1)
    named = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in _ANGLES.items())), text)
    return F.when(number.isNotNull() & near(number), number).when(named.isNotNull() & near(named), named)


def orientation_label(label: Column) -> Column:
    return F.when(label.isin("0", "90", "180", "270"), F.concat(label, F.lit("°"))).otherwise(label)


def rotate_token_angle(tail: Column) -> Column:
    """0, 90, 180 or 270 by the rotation token in a layout line's tail, else null."""
    out = F.lit(None).cast("int")
    for name, angle in (("left", 270), ("down", 180), ("right", 90), ("up", 0)):
        out = F.when(tail.contains(f"<|rotate_{name}|>"), F.lit(angle)).otherwise(out)
    return out
