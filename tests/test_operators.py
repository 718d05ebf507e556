import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.operators import clusters, lines, models, reading_order, render, suppress, tables, windows
from quirespark.operators.lines import Span

RNG = np.random.default_rng(7)


def random_boxes(n):
    p = RNG.integers(0, 60, (n, 2)).astype(float)
    return np.concatenate([p, p + RNG.integers(5, 40, (n, 2))], axis=1)


# -- suppression against plain loops


def plain_iou(a, b, one=0.0):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + one, min(a[3], b[3]) - max(a[1], b[1]) + one
    both = max(w, 0) * max(h, 0)
    size = lambda r: (r[2] - r[0] + one) * (r[3] - r[1] + one)
    return both / (size(a) + size(b) - both)


@pytest.mark.parametrize("n", [0, 1, 25])
def test_suppression(n):
    boxes, classes, scores = random_boxes(n).reshape(-1, 4), RNG.integers(0, 3, n), RNG.integers(0, 9, n) / 10
    left, keep = sorted(range(n), key=lambda i: -scores[i]), []
    while left:
        i = left.pop(0)
        keep.append(i)
        left = [j for j in left if classes[j] != classes[i] or plain_iou(boxes[i], boxes[j]) <= 0.3]
    assert suppress.nms(boxes, classes, scores, 0.3) == keep
    left, keep = sorted(range(n), key=lambda i: -scores[i]), []
    while left:
        i = left.pop(0)
        keep.append(i)
        left = [j for j in left if plain_iou(boxes[i], boxes[j], 1.0) < (0.6 if classes[j] == classes[i] else 0.98)]
    assert suppress.layout_nms(boxes, classes, scores) == keep
    assert len(suppress.nms(boxes, classes, scores, 0.3, 2)) <= 2


@pytest.mark.parametrize("most", [1 << 22, 40, 1])
def test_suppression_by_batches(most, monkeypatch):
    """The batch form of every suppression against its fold over one page."""
    import pyarrow as pa

    hits = suppress._hits
    monkeypatch.setattr(suppress, "_hits", lambda starts, test: hits(starts, test, most))
    pages = [random_boxes(n).reshape(-1, 4) for n in (0, 1, 7, 7, 25, 2)]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    boxes, n = np.concatenate(pages), starts[-1]
    classes, scores = RNG.integers(0, 3, n), RNG.integers(0, 9, n) / 10
    labels = [("text", "image", "reference", None)[k] for k in RNG.integers(0, 4, n)]
    columns = {c: pa.array(boxes[:, k]) for k, c in enumerate(("x1", "y1", "x2", "y2"))} | {"cls": pa.array(classes), "score": pa.array(scores), "label": pa.array(labels)}
    made = {}
    monkeypatch.setattr(suppress.paged, "picked", lambda frame, pick, keys: pick(columns, starts))
    for name, run, plain in (
        ("nms", lambda: suppress.apply_nms(None, 0.3, 5), lambda a, b: suppress.nms(boxes[a:b], classes[a:b], scores[a:b], 0.3, 5)), ("layout", lambda: suppress.apply_layout_nms(None), lambda a, b: suppress.layout_nms(boxes[a:b], classes[a:b], scores[a:b])),
        ("removed", lambda: suppress.remove_overlaps(None, 0.5), lambda a, b: [i for i in range(b - a) if i not in suppress.overlap_removed(boxes[a:b], labels[a:b])]), ("filtered", lambda: suppress.filter_overlaps(None, 0.5), lambda a, b: suppress.overlap_filtered(boxes[a:b], labels[a:b], 0.5)),
    ):
        at, rank = run()
        made[name] = list(zip(at.tolist(), rank.tolist()))
        assert made[name] == [(int(a + i), k) for a, b in zip(starts, starts[1:]) for k, i in enumerate(plain(a, b))], name
    assert len(made["nms"]) < n


def test_dropped_box_goes_on_comparing():
    boxes = np.array([(0, 0, 10, 10), (0, 0, 12, 12), (1, 1, 9, 9)], float)
    assert suppress.overlap_removed(boxes, ["text"] * 3) == {0, 2}
    assert suppress.overlap_removed(boxes[:2], ["image", "text"]) == {0}
    assert suppress.overlap_filtered(boxes[:2], ["image", "text"]) == [0, 1]
    assert suppress.overlap_filtered(boxes, ["text", "reference", "text"]) == [0]


def test_merging_grows_while_it_scans():
    boxes = np.array([(0, 0, 10, 10), (4, 0, 14, 10), (9, 0, 19, 10)], float)
    out = suppress.nms_merge(boxes, np.array(["a"] * 3), np.array([0.9, 0.8, 0.7]), {"a": "union"}, 0.25)
    assert out == [(0, (0, 0, 19, 10), "a", 0.9)]
    assert len(suppress.nms_merge(boxes, np.array(["a"] * 3), np.array([0.9, 0.8, 0.7]), {}, 0.25)) == 2


# -- order


def test_quad_order():
    assert reading_order.quad_order([(10, 50, 50, 70), (10, 10, 50, 30), (10, 30, 50, 50)]) == [1, 2, 0]
    assert reading_order.quad_order([(60, 10, 100, 30), (10, 12, 50, 32)]) == [1, 0]
    assert reading_order.quad_order([(60, 10, 100, 30), (10, 11, 50, 31), (10, 50, 50, 70), (60, 52, 100, 72)]) == [1, 0, 2, 3]
    assert reading_order.quad_order([]) == []


def test_xycut():
    assert reading_order.xycut([(10, 10, 100, 30), (10, 40, 100, 60), (10, 70, 100, 90)]) == [0, 1, 2]
    two = [(10, 10, 45, 30), (55, 10, 90, 30), (10, 40, 45, 60), (55, 40, 90, 60)]
    assert reading_order.xycut(two) == [0, 1, 2, 3] and reading_order.xycut(two, vertical=False) == [0, 2, 1, 3]
    assert reading_order.xycut([]) == [] and reading_order._segments([(0, 2), (5, 7)], 1) == [(0, 2), (5, 7)]


@pytest.mark.parametrize(
    ("boxes", "kinds", "order"),
    [
        ([(20, 110, 380, 135), (20, 560, 380, 585), (20, 25, 380, 45), (20, 5, 380, 20), (20, 145, 380, 170)], ["text", "footer", "header", "header", "text"], [3, 2, 0, 4, 1]),
        ([(20, 90, 380, 120), (20, 55, 380, 80), (20, 130, 380, 160)], ["text", "doc_title", "text"], [1, 0, 2]),
        ([(215, 120, 380, 150), (20, 40, 185, 70), (215, 40, 380, 70), (20, 120, 185, 150)], ["text"] * 4, [1, 2, 3, 0]),
        ([], [], []),
    ],
)
def test_enhanced_order(boxes, kinds, order):
    assert reading_order.enhanced_order(boxes, kinds, [2] * len(boxes)) == order


def test_captions_stay_by_their_picture():
    blocks = [reading_order.Block(b, i, k, n) for i, (b, k, n) in enumerate([((20, 20, 380, 45), "text", 1), ((20, 90, 220, 190), "image", 5), ((20, 192, 220, 210), "figure_title", 1), ((20, 230, 380, 255), "text", 1)])]
    reading_order.seat_captions(blocks)
    assert [b.at for b in blocks] == [0, 1, 2, 3]


def test_every_box_is_ordered_once():
    for _ in range(30):
        boxes = random_boxes(12)
        kinds = [("text", "image", "figure_title", "doc_title", "header", "number", "reference", "table")[i] for i in RNG.integers(0, 8, 12)]
        assert sorted(reading_order.enhanced_order(boxes, kinds)) == list(range(12))


# -- clusters


def test_box_reduction():
    boxes = np.array([(0, 0, 2, 2), (1, 1, 3, 3), (50, 50, 52, 52), (51, 50, 53, 52)], float)
    assert sorted(map(tuple, clusters.reduce_boxes(boxes, 2))) == [(0, 0, 3, 3), (50, 50, 53, 52)]
    assert len(clusters.reduce_boxes(boxes, 9)) == 4 and len(clusters.reduce_boxes(boxes, 0)) == 0
    assert len(clusters.cells_with_ocr(boxes[:1], [0.9], boxes, 3)) == 3


def test_title_levels():
    assert clusters.levels_of([40.0, 24.0, 18.0], True) == [2, 3, 4] and clusters.levels_of([5.0], True) is None
    assert clusters.vote(3, 2, 2) == 3 and clusters.vote(2, 3, None) == 2 and clusters.vote(None, None, None) == 2 and clusters.vote(None, 4, 3) == 3


# -- tables


def test_cell_matching():
    cell = lambda b, r=None, c=None: tables.Cell(b, r, c)
    same = [cell((0, 0, 20, 20)), cell((0, 0, 20, 20))]
    assert tables.match_cells(same, [(2, 2, 18, 18)], False, True) == {0: 0}
    near = [cell((0, 0, 20, 20)), cell((0, 9.99995, 20, 29.99995))]
    assert tables.match_cells(near, [(0, 10, 20, 20)], False, True) == {0: 0}
    rows = [cell((64.7, 42.3, 84.9, 57.7), 2, 2), cell((65.4, 58.3, 84, 71), 3, 2)]
    assert tables.match_cells(rows, [(67, 51, 83, 66)], False, True) == {0: 0}
    assert tables.match_cells(same, [(50, 50, 60, 60)], True, False) == {}


def test_row_matching():
    cells = [tables.Cell(b) for b in ((50, 2, 100, 20), (0, 0, 50, 20), (0, 22, 50, 40), (50, 21, 100, 40))]
    tokens = ["<table>", *["<tr>", *["<td></td>"] * 2, "</tr>"] * 2, "</table>"]
    spans = [Span((5, 5, 40, 15), "A"), Span((55, 5, 90, 15), "B"), Span((5, 25, 40, 35), "C"), Span((55, 25, 90, 35), "D")]
    mapping, used = tables.match_rows(cells, tokens, spans, 10.0, False)
    assert mapping == [1, 0, 2, 3] and used == {0, 1, 2, 3} and [cells[i].text for i in mapping] == ["A", "B", "C", "D"]


def test_cross_cell_split():
    cells = [(x, 0.0, x + 100.0, 50.0) for x in (0.0, 100.0)]
    parts = tables.split_span(Span((50, 10, 150, 40), "Col1 Col2"), cells)
    assert [p.box for p in parts] == [(50, 10, 100, 40), (100, 10, 150, 40)] and " ".join(p.text for p in parts).split() == ["Col1", "Col2"]
    assert tables.split_span(Span((10, 10, 90, 40), "x"), cells) is None
    tall = tables.split_span(Span((10, 10, 30, 90), "a\nb\nc"), [(0.0, 0.0, 50.0, 50.0), (0.0, 50.0, 50.0, 100.0)])
    assert [p.text for p in tall] == ["a", "b\nc"]
    assert tables.segments_over_cells((0, 0, 30, 5), [(5, 0, 10, 5), (20, 0, 25, 5)]) == [(0, 0, 5, 5), (5, 0, 10, 5), (10, 0, 20, 5), (20, 0, 25, 5), (25, 0, 30, 5)]


def test_checkboxes():
    assert tables.checkbox_text(["ü", "X", "L"]) == ["✓", "✗", "✓"] and tables.checkbox_text(["L", "A"]) == ["L", "A"]
    assert tables.merged_fragments(["<b>a</b>", "", " b "]) == "a<br/>b" and tables.joined_fragments(["a ", "b"]) == "a b"


# -- lines


@pytest.mark.parametrize(
    ("spans", "container", "text"),
    [
        ([((0, 0, 10, 10), "A"), ((12, 1, 20, 11), "B")], None, "A B"),
        ([((0, 0, 60, 10), "Line"), ((0, 20, 40, 30), "next")], (0, 0, 100, 40), "Line next"),
        ([((0, 0, 60, 10), "2024"), ((0, 20, 40, 30), "next")], (0, 0, 100, 40), "2024\nnext"),
        ([((0, 0, 20, 10), "Note:"), ((0, 20, 40, 30), "next")], (0, 0, 100, 40), "Note:next"),
        ([((0, 0, 98, 10), "hy-"), ((0, 20, 40, 30), "phen")], (0, 0, 100, 40), "hyphen"),
    ],
)
def test_joined_lines(spans, container, text):
    assert lines.joined_text([Span(b, t) for b, t in spans], container) == text


def test_formula_spans():
    spans = [Span((0, 0, 10, 10), "let"), Span((12, 0, 20, 10), "x", label="formula"), Span((22, 0, 30, 10), "be")]
    assert lines.joined_text(spans, None) == "let $x$ be"
    assert lines.line_facts(spans) == (0, 30, 1)


# -- rendering

COLS = "doc_id long, page_idx int, idx int, kind string, x1 double, y1 double, x2 double, y2 double, text string, confidence double, seg_start_x double, seg_end_x double, num_lines int, rank int"


def page(spark, *rows, page_idx=0):
    return spark.createDataFrame([(1, page_idx, i, k, *map(float, b), t, 1.0, None, None, n, i) for i, (k, b, t, n) in enumerate(rows)], COLS)


def test_page_markdown(spark):
    p = page(
        spark, ("doc_title", (0, 0, 100, 20), "Main\nTitle", 1), ("paragraph_title", (0, 25, 100, 35), "2.1 Method", 1), ("text", (0, 40, 100, 60), "one-\ntwo", 3), ("formula", (10, 64, 20, 70), "$x$", 1), ("text", (0, 62, 100, 72), "goes on", 2),
        ("footnote", (0, 80, 100, 90), "no", 1), ("content", (0, 91, 100, 95), "1 Intro\n2 Method", 1), ("image", (0, 96, 50, 99), None, 1), ("list", (0, 99, 9, 100), "a\nb", 2), ("formula_number", (0, 0, 1, 1), "(1)", 1), ("table", (0, 200, 50, 250), None, 1),
    )
    t = spark.createDataFrame([(1, 0, 0, "<html><body><table><tr></tr></table></body></html>", 0.0, 200.0, 50.0, 249.0)], "doc_id long, page_idx int, table_idx int, html string, x1 double, y1 double, x2 double, y2 double")
    md = render.page_markdown(p, t).first()["markdown"]
    assert md == (
        "# Main Title\n\n### 2.1 Method\n\nonetwo\n\n$$x$$goes on\n\n1 Intro  \n2 Method\n\n"
        '<div style="text-align: center;"><img src="imgs/img_in_image_box_0_96_50_99.jpg" alt="Image" width="50%" /></div>\n\n- a\n- b\n\n\n<div style="text-align: center;"><table border="1"><tr></tr></table></div>'
    )


def test_inline_formula(spark):
    p = page(spark, ("text", (0, 0, 20, 10), "let", 1), ("formula", (22, 0, 30, 10), "x", 1), ("text", (40, 0, 60, 10), "be", 1))
    assert render.page_markdown(p).first()["markdown"] == "let$x$ \n\nbe"


def test_pages_concatenate(spark):
    rows = [(1, 0, "ends mid", True, False), (1, 1, "  ", True, False), (1, 2, " goes on", False, True), (1, 3, "New", True, True), (2, 0, " only ", True, True), (3, 0, "中", True, False), (3, 1, "文", False, True)]
    pages = spark.createDataFrame(rows, "doc_id long, page_idx int, markdown string, para_start boolean, para_end boolean")
    assert {r["doc_id"]: r["markdown"] for r in render.concat_pages(pages).collect()} == {1: "ends mid goes on\n\nNew", 2: " only ", 3: "中文"}


def test_continuation_flags(spark):
    p = page(spark, ("header", (90, 0, 100, 5), "h", 1), ("text", (20, 10, 95, 20), "a", 1), ("text", (0, 30, 60, 40), "b", 1))
    r = windows.continuation_flags(p).first()
    assert (r["para_start"], r["para_end"]) == (False, True)


# -- models


class Fake:
    batch_size = 3

    def execute(self, items):
        if len(items) > 1 and any(i["content"] == b"bad" for i in items):
            raise RuntimeError("batch broke")
        if items[0]["content"] == b"bad":
            raise ValueError("bad item")
        return [{"text": i["content"].decode(), "score": 0.2 if i["content"] == b"dim" else 0.9} for i in items]


def test_models_keep_failing_rows(spark):
    rows = [(i, bytearray(c)) for i, c in enumerate((b"a", b"bad", b"c", b"dim", b"e"))]
    frame = spark.createDataFrame(rows, "idx int, content binary")
    got = {r["idx"]: (r["text"], r["error"]) for r in models.run_task(frame, "text_recognition", Fake, ["idx"], threshold=0.5).collect()}
    assert got[0] == ("a", None) and got[1] == (None, "ValueError: bad item") and got[3] == ("", None) and len(got) == 5


def test_validation(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.2], [1.0, 2.0])], "id int, scores array<double>, boxes array<double>")
    rules = {"scores": models.scores_valid(F.col("scores")), "lengths": models.same_length(F.col("scores"), F.col("boxes"))}
    assert models.validated(frame, **rules).count() == 1
    with pytest.raises(Exception, match="validation failed: high"):
        models.validated(frame, high=models.scores_valid(F.col("scores"), 0.3)).collect()
    assert models.chain(lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("b", F.col("a") + 1))(frame).first()["b"] == 2
