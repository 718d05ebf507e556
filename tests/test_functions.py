import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions import outlines as O
from quirespark.functions import pixels as P
from quirespark.functions import sequences as S
from quirespark.functions import text as T
from quirespark.functions.geometry import Box


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_box(*b):
    return Box(*(F.lit(float(v)) for v in b))


# -- geometry


def test_overlap_threshold(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 5, 20, 20)
    assert value(spark, G.overlaps(a, b, 3.0)) and not value(spark, G.overlaps(a, b, 5.0))


def test_six_ratios_differ(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 0, 25, 10)
    got = [round(value(spark, f(a, b)), 4) for f in (G.iou, G.iou_inclusive, G.ioa, G.overlap_over_second, G.ioa_smaller)]
    assert got == [0.2, round(66 / (121 + 231 - 66), 4), 0.5, 0.25, 0.5]
    flat = lit_box(3, 3, 3, 9)
    assert value(spark, G.ioa(flat, a)) == 0.0 and value(spark, G.iou(flat, flat)) == 0.0


def test_polygons_and_coordinates(spark):
    tri = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 3.0))])
    assert value(spark, G.poly_area(tri)) == 6.0 and value(spark, G.poly_perimeter(tri)) == 12.0
    none = F.array().cast("array<struct<x:double,y:double>>")
    assert tuple(value(spark, c) for c in G.poly_box(none)) == (0, 0, 0, 0) and value(spark, G.poly_area(none)) == 0
    eight = F.array(*[F.lit(float(v)) for v in (1, 2, 9, 3, 8, 7, 0, 6)])
    assert tuple(value(spark, G.box_from_coords(eight))) == (0, 2, 9, 7)
    assert tuple(value(spark, G.box_from_coords(F.slice(eight, 1, 3)))) == (0, 0, 0, 0)
    assert value(spark, G.intersection_box(lit_box(0, 0, 9, 9), lit_box(8.5, 0, 20, 9))) is None
    assert tuple(value(spark, G.normalise_thousandths(*(F.lit(v) for v in (900, 10, 100, 500))))) == (0.1, 0.01, 0.9, 0.5)
    assert value(spark, G.normalise_thousandths(*(F.lit(v) for v in (1, 1, 1, 5)))) is None
    assert tuple(value(spark, G.merge_box(lit_box(0, 0, 2, 2), lit_box(1, 1, 5, 5), F.lit("small")))) == (0, 0, 2, 2)
    assert tuple(value(spark, G.merge_box(lit_box(0, 0, 2, 2), lit_box(1, 1, 5, 5), F.lit("union")))) == (0, 0, 5, 5)


def test_outlines():
    square = [(0, 0), (4, 0), (4, 2), (0, 2), (2, 1), (1, 0)]
    cx, cy, w, h, _ = O.min_area_rect(square)
    assert (cx, cy) == pytest.approx((2, 1)) and sorted((w, h)) == pytest.approx([2, 4])
    assert len(O.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1)) == 3
    assert O.area(O.offset([(0, 0), (10, 0), (10, 10), (0, 10)], 1.5)) == pytest.approx((10 + 2 * 3.75) ** 2)
    assert O.inside_mask([(0, 0), (4, 0), (4, 4), (0, 4)], 6, 6).sum() == 16


# -- elements


def test_types(spark):
    assert value(spark, E.type_of(F.lit("Display_Formula"))) == "formula" and value(spark, E.type_of(F.lit("zzz"))) == "other"
    assert len(E.TYPES) == 28 and len(E.OCR_TYPES) == 20 and len(E.BLOCK_TYPES) == 22
    assert value(spark, E.table_confidence(F.lit(None).cast("double"), F.lit(0.4))) == 0.4
    assert value(spark, E.orientation_angle(F.lit("sideways"))) is None and value(spark, E.orientation_angle(F.lit("90.0"))) == 90.0
    assert value(spark, E.table_type(F.lit(" Wired "))) == "wired" and value(spark, E.table_type(F.lit("x"))) is None


# -- text


@pytest.mark.parametrize(("a", "b"), [("$ x $", "$x$"), ("$$ x $$", "$$ x $$"), ("$100", "$100"), ("a $ x $ b $ y$", "a $x$ b $y$")])
def test_tight_math(a, b):
    assert T.tighten_math(a) == b


@pytest.mark.parametrize(("a", "b"), [("1.2Title", "### 1.2 Title"), ("I. Introduction", "### I. Introduction"), ("Plain", "## Plain")])
def test_parsed_titles(a, b):
    assert T.vl_title(a) == b


@pytest.mark.parametrize(("a", "b"), [("a. b", "a.b"), ("a.)", "a)"), ("  lead  tail ", "lead tail "), ("encoder'sfeature", "encoder's feature"), ("48.1%AP", "48.1% AP"), ("end-\nless", "endless"), ("http://a-\nb", "http://a- b")])
def test_prose_lines(a, b):
    assert T.postprocess_text(a) == b


def test_markdown_lines():
    assert T.empty_formulas_dropped("a\n$$\n$$\n\nb") == "a\nb"
    assert T.empty_formulas_dropped("$$\n\n$$\nx") == "$$\nx" and T.empty_formulas_dropped("$$\nx\n$$") == "$$\nx"
    assert T.sections_deduped("**A**\nx\n **A** \ny") == "**A**\nx\ny"
    assert T.postprocess_markdown("# H  1\n```\na  b\n```\nc  d") == "# H  1\n```\na  b\n```\nc d\n"
    assert T.truncate_repeats("ab" * 30) == "ab" and T.truncate_repeats("same\n" * 12) == "same" and T.truncate_repeats("short") == "short"
    assert T.clean_truncated_tail("q" * 3 + "xy" * 5000) == "qqqxy"
    assert T.split_by_ratio("ABCDEFGHIJ", [0.5, 0.5]) == ["ABCDE", "FGHIJ"] and T.split_by_ratio("", [1, 1]) == ["", ""]
    assert T.normalise_latex(r"\mathrm { a b } + c  d \text{中文}") == r"\mathrm{ab}+c d中文"


def test_column_rules(spark):
    assert value(spark, T.content_block(F.lit("a-\nb"))) == "a    \nb"
    assert value(spark, T.first_line(F.lit("\n References\nx"), "\n", ["references"])) == "\n## References\n\nx"
    assert tuple(value(spark, T.titled(F.lit("2.1.1 Details")))) == (4, "2.1.1 Details")
    assert tuple(value(spark, T.titled(F.lit("Unnumbered Heading"), F.lit(4)))) == (4, "Unnumbered Heading")
    assert tuple(value(spark, T.titled(F.lit("References:")))) == (2, "References:")
    assert value(spark, T.formula_block(F.lit(r"\[ x \upmu \big{(} \]"))) == r"$$x \mu \big($$"
    assert value(spark, T.formula_unwrapped(F.lit(r"\[a\]"))) == "$$a$$" and value(spark, T.formula_unwrapped(F.lit("$a$"))) == "$a$"
    assert value(spark, T.math_unwrapped(F.lit(" $$ x $$ "))) == "x" and value(spark, T.is_cjk(F.lit("中")))
    assert value(spark, T.special_tokens_removed(F.lit("a-<|sn|>b<|sn|>c<|unk|>"))) == "ab c"
    assert value(spark, T.image_tags_dropped(F.lit('a\n\n<img src="images/bbox_1.jpg">\n\nb'))) == "a\n\nb"
    for text, box, conf, want in (("=", (10.0, 9.0), 0.33, "-"), ("=", (7.0, 6.0), 0.40, ","), ("0", (12.0, 13.0), 0.13, ";"), ("=", (7.0, 6.0), 0.9, "=")):
        assert value(spark, T.tiny_symbol(F.lit(text), F.lit(conf), F.lit(box[0]), F.lit(box[1]))) == want
    assert value(spark, T.merged_words_parted(F.lit("RT-DETRis is100x"))) == "RT-DETRis is100x"


@settings(max_examples=60, deadline=None)
@given(st.text("ab' .,-\n%1AZ", max_size=40))
def test_prose_never_grows_spaces(text):
    out = T.postprocess_text(text)
    assert "  " not in out and not out.startswith(" ")


# -- sequences


def test_ctc(spark):
    alphabet = ["_", "a", "b", "c"]
    one = S.ctc_decode(F.array(*map(F.lit, (0, 1, 1, 0, 1, 2, 2))), F.array(*map(F.lit, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3))), alphabet)
    two = S.ctc_decode(F.array(*map(F.lit, (3, 3, 4, 3, 0, 2, 0))), F.array(*map(F.lit, (0.95, 0.85, 0.75, 0.65, 0.55, 0.45, 0.35))), alphabet)
    a, b = value(spark, one), value(spark, two)
    assert (a["text"], a["columns"], b["text"], b["columns"]) == ("aab", [1, 4, 5], "ccb", [0, 3, 5])
    assert a["score"] == pytest.approx((0.8 + 0.5 + 0.4) / 3) and a["positions"] == pytest.approx([1 / 7, 4 / 7, 5 / 7])
    empty = value(spark, S.ctc_decode(F.array().cast("array<int>"), F.array().cast("array<double>"), alphabet))
    assert (empty["text"], empty["score"]) == ("", 0.0)
    assert T.reversed_keeping_ascii("مرحبا ab12") == " ab12ابحرم"


def test_top_k(spark):
    s = F.array(*map(F.lit, (0.1, 0.5, 0.5, 0.2)))
    got = value(spark, S.top_k(s, 9, {1: "one"}))
    assert [(r["class_id"], r["label"]) for r in got] == [(1, "one"), (2, "Unknown(2)"), (3, "Unknown(3)"), (0, "Unknown(0)")]
    with pytest.raises(ValueError):
        S.top_k(s, 0)
    with pytest.raises(Exception, match="no predictions"):
        value(spark, S.top_k(F.array().cast("array<double>"), 1))


TD = "<td></td>"


def row(*cells):
    return ["<tr>", *cells, "</tr>"]


def split(attr):
    """A cell whose opening tag comes in parts."""
    return ["<td", f" {attr}", ">", "</td>"]


WIDE, TALL = 'colspan="2"', 'rowspan="2"'


@pytest.mark.parametrize(
    ("tokens", "grid"),
    [
        (row(TD, TD) * 2, [(r, c, 1, 1) for r in (0, 1) for c in (0, 1)]),
        (row(f"<td {WIDE}></td>") + row(TD, TD), [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]),
        (row(f"<td {TALL}></td>", TD) + row(TD), [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]),
        (row(*split(WIDE)) + row(*split(TALL), TD) + row(TD), [(0, 0, 1, 2), (1, 0, 2, 1), (1, 1, 1, 1), (2, 1, 1, 1)]),
    ],
)
def test_cell_grid(tokens, grid):
    assert S.cell_grid(tokens) == grid


def test_tokens_of_cells():
    left, right, top, low = (0, 48), (48, 96), (0, 18), (18, 36)
    box = lambda x, y: (x[0], y[0], x[1], y[1])
    tokens, order = S.tokens_of_cells([box(x, y) for y in (top, low) for x in (left, right)], 4.0)
    assert [o[1:3] for o in order] == [(r, c) for r in (0, 1) for c in (0, 1)] and tokens.count(TD) == 4
    tokens, order = S.tokens_of_cells([box(left, (0, 36)), box(right, top), box(right, low)], 4.0)
    assert len(order) == 3 and any(TALL in t for t in tokens)
    assert S.table_html(row(TD, *split(WIDE)), ["k", None]) == f"<html><body><table><tr><td>k</td><td {WIDE}></td></tr></table></body></html>"


def markup(*rows, tag="td"):
    """A table of rows of (attributes, text) or text."""
    cell = lambda c: f"<{tag} {c[0]}>{c[1]}</{tag}>" if isinstance(c, tuple) else f"<{tag}>{c}</{tag}>"
    return f"<table>{''.join(f'<tr>{chr(32)}' + ''.join(map(cell, r)) + '</tr>' for r in rows)}</table>"


@pytest.mark.parametrize(
    ("html", "otsl"),
    [
        (markup(["k", "l"], ["m", "n"]), "<fcel>k<fcel>l<nl><fcel>m<fcel>n<nl>"),
        (markup(["k", ""]), "<fcel>k<ecel><nl>"),
        (markup([(WIDE, "K")], ["u", "v"]), "<fcel>K<lcel><nl><fcel>u<fcel>v<nl>"),
        (markup([(TALL, "K"), "u"], ["v"]), "<fcel>K<fcel>u<nl><ucel><fcel>v<nl>"),
        (markup([(f"{WIDE} {TALL}", "K"), "u"], ["v"]), "<fcel>K<lcel><fcel>u<nl><ucel><xcel><fcel>v<nl>"),
        (markup([(WIDE, "K")], ["u", "v"]).replace("<td col", "<tdcol"), "<fcel>K<lcel><nl><fcel>u<fcel>v<nl>"),
        (markup(["p &amp; q", "r &lt; s"]), "<fcel>p & q<fcel>r < s<nl>"),
        (markup(["k", "l"], tag="th").upper(), "<fcel>K<fcel>L<nl>"),
        ("plain", None), ("", None),
    ],
)
def test_otsl(html, otsl):
    assert S.html_to_otsl(html) == otsl
    if otsl:
        assert S.html_to_otsl(S.otsl_to_html(otsl)) == otsl


def test_otsl_fallbacks():
    assert S.otsl_to_html("k\tl\nm\tn") == markup(["k", "l"], ["m", "n"]).replace("<tr> ", "<tr>")
    assert S.otsl_squared("<fcel>k<fcel>l<nl><fcel>m") == "<fcel>k<fcel>l<nl><fcel>m<ecel><nl>"
    assert S.otsl_segments("x<fcel>a<ecel>") == ["x<fcel>a", "<ecel>"]
    assert S.table_output(" plain ") == "plain" and "<td>1</td>" in S.table_output("<fcel>1<nl>")
    assert S.table_vocabulary(["<tr>", "<td>", ""]) == ["sos", "<tr>", TD, "eos"]
    assert S.decode_structure([(0, 1.0), (1, 0.5), (2, 0.7), (3, 0.9), (1, 0.2)], [[], [], [1.0]], ["sos", "<tr>", TD, "eos"]) == (["<tr>", TD], [[1.0]], pytest.approx(0.6))


def test_order_ranks(spark):
    votes = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ((0, -5, 5), (0, 0, 5), (0, 0, 0))])
    assert value(spark, S.order_ranks(votes)) == [1, 0, 2]
    assert value(spark, S.banned_tokens(F.array(*map(F.lit, (1, 2, 3, 1, 2))), 3)) == [3]


# -- pixels


def test_images():
    import numpy as np

    image = np.full((20, 30, 3), 255, np.uint8)
    image[5:9, 6:20] = 0
    assert (P.decode(P.encode(image)) == image).all()
    assert P.crop_margin(image).shape == (4, 14, 3) and P.crop(image, (25, 10, 99, 99)).shape == (10, 5, 3) and P.crop(image, (40, 0, 50, 5)) is None
    assert P.crop_quad(image, [(6, 5), (20, 5), (20, 9), (6, 9)]).shape == (4, 14, 3)
    assert P.turn(image, 90).shape == (30, 20, 3) and P.letterbox(image, 60, 60).shape == (60, 60, 3)
    assert P.detection_size(2000, 1000) == (960, 480) and P.recognition_size(100, 50) == (96, 48)
    w, h = P.factor_size(1000, 333)
    assert w % 28 == h % 28 == 0
    assert P.to_tensor([image]).shape == (1, 3, 20, 30) and P.formula_tensor(image).shape == (1, 1, 192, 672)
    [(quad, score)] = P.boxes_from_map((image[..., 0] < 128).astype(float), 30, 20, ratio=1.0)
    assert score == 1.0 and quad[:, 0].min() < 6 and quad[:, 1].max() > 9
    assert P.stack_vertically([image, image[:, :10]], ["left"]).shape == (40, 30, 3)
    assert (P.mask(image, [(0, 0, 30, 20)], (1, 2, 3)) == (1, 2, 3)).all()
