"""What must not grow with the table: width and number of exchanges, rows of a task, array calls on tiny pages."""

import json
import random

import numpy as np
import pytest

from quirespark.operators import clusters, paged, reading_order, suppress, tables, windows
from quirespark.plans import inputs, registry

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["region_match", "orphans", "two_column_order"])
def test_boxes_are_derived_after_their_exchange(spark, name):
    """Texts and labels of boxes used to be shuffled and sorted beside the columns that they come from."""
    lines = plan_of(registry.queries()[name](spark, SF)).split("\n")
    scans = [k for k, line in enumerate(lines) if "+- FileScan parquet" in line]
    assert scans
    for k in scans:
        below = next(lines[j] for j in range(k, -1, -1) if "Exchange" in lines[j])
        between = "".join(lines[lines.index(below) : k])
        assert "Item " not in between and "% 80" not in between


def test_markdown_joins_no_element_to_itself(spark):
    """Its joins by element shuffled every text twice more; page by page the rows stay where the numbering put them."""
    plan = plan_of(registry.queries()["page_markdown"](spark, SF))
    assert "idx" not in "".join(line for line in plan.split("\n") if "Join" in line).replace("page_idx", "")


def test_partitions_grow_with_the_files(spark, monkeypatch):
    want = sorted(map(tuple, inputs.boxes(spark, SF).select("doc_id", "idx", "x1", "text").collect()), key=repr)
    monkeypatch.setattr(inputs, "PART_BYTES", 10_000)
    parts = [inputs.boxes(spark, f"/root/testdata/{sf}").rdd.getNumPartitions() for sf in ("sf0.001", "sf0.01")]
    assert parts[0] > 4 and 5 < parts[1] / parts[0] < 20
    assert sorted(map(tuple, inputs.boxes(spark, SF).select("doc_id", "idx", "x1", "text").collect()), key=repr) == want


@pytest.mark.parametrize(("least", "gap"), [(0, 1), (0, 2), (0, 0), (1, 3), (2, 1)])
def test_stretches_are_those_of_the_profile(spark, least, gap):
    rnd = random.Random(least * 7 + gap)
    f = spark.createDataFrame([(k % 40, float(a := rnd.randint(-5, 60)), a + rnd.choice([-3.0, 0.0, 1.0, 5.5, 17.0])) for k in range(200)], "doc_id long, lo double, hi double")
    got = windows.covered_stretches(f, "lo", "hi", least, gap, ["doc_id"])
    assert "explode(sequence" not in plan_of(got)
    if gap > 0:
        want = windows.split_profile(windows.coverage(f, "lo", "hi", ["doc_id"]), least, gap, ["doc_id"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class _Counted:
    """numpy that counts the calls made through it."""

    def __init__(self):
        self.calls = 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(np, name)


def test_tiny_pages_make_no_array_calls(monkeypatch):
    """A call on four numbers costs more than the numbers: rounds over them made hundreds a page."""
    boxes = np.array([(0, 0, 9, 9), (1, 1, 9, 9), (40, 1, 50, 9), (41, 30, 50, 40)], float)
    counted = _Counted()
    monkeypatch.setattr(clusters, "np", counted)
    assert clusters.levels_of([10.0, 7.5, 7.5, 3.0], True) == [2, 3, 3, 4]
    assert clusters.reduce_boxes(boxes, 2).tolist() == [[0, 0, 50, 9], [41, 30, 50, 40]] or counted.calls
    assert counted.calls < 12
    monkeypatch.setattr(suppress, "np", counted)
    counted.calls = 0
    assert len(suppress.nms_merge(boxes, np.array(["a"] * 4), np.array([0.9, 0.8, 0.7, 0.6]), {"a": "union"}, 0.25)) == 3
    assert counted.calls < 8
    assert not hasattr(reading_order, "np")


@pytest.mark.parametrize("n", [1, 2, 7, 8, 30])
def test_plain_clusters_are_those_of_arrays(monkeypatch, n):
    rnd = random.Random(n)
    for _ in range(40):
        boxes = np.array([(x := rnd.randint(0, 79), y := rnd.randint(0, 79), x + rnd.random() * 40, y + rnd.random() * 20) for _ in range(n)])
        k = rnd.randint(1, n)
        few = clusters.reduce_boxes(boxes, k)
        monkeypatch.setattr(clusters, "FEW", 0)
        assert np.array_equal(few, clusters.reduce_boxes(boxes, k))
        monkeypatch.undo()


@pytest.mark.parametrize("gap", [1, 2, 5])
def test_segments_are_those_of_covered_positions(gap):
    rnd = random.Random(gap)
    for _ in range(200):
        spans = [(rnd.randint(-9, 40), rnd.randint(-9, 40)) for _ in range(rnd.randint(0, 6))]
        most = max((abs(e) for _, e in spans), default=0)
        at = sorted({p for s, e in spans for p in range(min(abs(s), abs(e)), max(abs(s), abs(e))) if p <= most}) if most else []
        want = []
        for p in at:
            if want and p - want[-1][1] + 1 <= gap:
                want[-1][1] = p + 1
            else:
                want.append([p, p + 1])
        assert reading_order._segments(spans, gap) == [tuple(w) for w in want]


def test_pages_reach_python_column_by_column(spark):
    f = spark.createDataFrame([(2, 1, "b", None), (1, 2, "d", 2.0), (1, 1, "c", 1.0)], "doc_id long, idx int, t string, v double")
    out = paged.per_page(f, lambda page: [{"idx": r["idx"], "t": r["t"], "v": r["v"], "n": len(page)} for r in page], "idx int, t string, v double, n int", ["doc_id"])
    assert sorted(map(tuple, out.collect())) == [(1, 1, "c", 1.0, 2), (1, 2, "d", 2.0, 2), (2, 1, "b", None, 1)]


def test_texts_are_objects_a_slice_at_a_time(spark):
    """A batch's ten thousand texts used to be Python objects all at once, before and after."""
    import pyarrow as pa

    from quirespark.functions import text as T

    values = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(3 * T.SLICE + 5)])
    assert T.by_slices(str.upper, values).to_pylist() == [v and v.upper() for v in values.to_pylist()]
    assert T.by_slices(str.upper, values.slice(0, 0)).to_pylist() == []
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, t string")
    out = rows.select("k", T.as_udf(str.upper)("t").alias("t"))
    assert "ArrowEvalPython" in plan_of(out) and sorted(map(tuple, out.collect())) == [(1, "A"), (2, None), (3, "")]


def test_tables_meet_their_texts_without_a_join(spark, monkeypatch):
    """Packed tables, cells and regions used to be joined page by page, each packed by an exchange and a list of its own."""
    monkeypatch.setattr(inputs, "PART_BYTES", 10_000)
    plan = plan_of(registry.queries()["filled_tables"](spark, SF))
    assert "Join" not in plan and "collect_list" not in plan
    # boxes lie by page, and tables, cells and regions are read from them: nothing but that is shuffled
    assert plan.count("Exchange") == 3 == plan.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("records", [1, 3, 10_000])
def test_pages_wait_for_all_their_arrow_batches(spark, records):
    box = "x1 double, y1 double, x2 double, y2 double"
    row = ["<tr>", "<td></td>", "<td></td>", "</tr>"]
    t = spark.createDataFrame([(k, j, 0.0, 20.0 * j, 100.0, 20.0 * j + 20, row if k != 4 else None, k == 3, False) for k in (1, 2, 3, 4, None) for j in (0, 1)], f"doc_id long, table_idx int, {box}, tokens array<string>, is_e2e boolean, has_detected boolean")
    c = spark.createDataFrame([(k, j, i, 50.0 * i, 20.0 * j, 50.0 * i + 50, 20.0 * j + 20, 0, i, None) for k in (1, 3, 4, None) for j in (0, 1) for i in (0, 1)], f"doc_id long, table_idx int, cell_idx int, {box}, row int, col int, text string")
    r = spark.createDataFrame(
        [(k, i, *b, s, 0.9, "text") for k in (1, 2, 3, 5, None) for i, (b, s) in enumerate([((5.0, 25.0, 45.0, 35.0), "low"), ((5.0, 5.0, 45.0, 15.0), "a\"é"), ((60.0, 5.0, 90.0, 15.0), None), ((60.0, 14.0, 90.0, 26.0), "edge"), ((30.0, 2.0, 80.0, 8.0), "over both")])],
        f"doc_id long, region_idx int, {box}, text string, confidence double, label string",
    )
    f = spark.createDataFrame([(1, 0, 60.0, 30.0, 90.0, 38.0, "x^2")], f"doc_id long, formula_idx int, {box}, latex string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = {(x["doc_id"], x["table_idx"]): (x["html"], x["cells"], x["used_regions"]) for x in tables.stitch_tables(t, c, r, f, ["doc_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k in (1, 2, 3, 4, None):
        mine = sorted((x for x in r.collect() if x["doc_id"] == k), key=lambda x: x["region_idx"])
        spans = [tables.Span((x["x1"], x["y1"], x["x2"], x["y2"]), x["text"], x["confidence"], x["label"]) for x in mine]
        used = set()
        for j in (0, 1):
            cells = [tables.Cell((50.0 * i, 20.0 * j, 50.0 * i + 50, 20.0 * j + 20), 0, i) for i in (0, 1)] if k != 2 else []
            one = tables.Table((0.0, 20.0 * j, 100.0, 20.0 * j + 20), cells, row if k != 4 else [], k == 3)
            before = set(used)
            tables.fill_table(one, spans, [((60.0, 30.0, 90.0, 38.0), "x^2")] if k == 1 else [], used)
            want[k, j] = (one.html, json.dumps([x.text for x in cells], ensure_ascii=False), sorted(mine[i]["region_idx"] for i in used - before))
    assert got == want and want[1, 0][2] == [1, 4] and want[None, 1][2] == [0] and 3 in want[3, 0][2] and 3 not in want[3, 1][2]


def test_shares_and_markup_are_those_of_single_calls():
    rnd = random.Random(8)
    some = lambda: (x := rnd.randint(0, 9), y := rnd.randint(0, 9), x + rnd.randint(-1, 9), y + rnd.randint(-1, 9))
    for _ in range(500):
        b, cells, least = some(), [some() for _ in range(6)], rnd.choice([0.05, 0.5, 0.7])
        assert tables.covering(b, cells, least) == [i for i, c in enumerate(cells) if tables.share(b, c) > least]
    texts = [None, "L", "é\"\\\n\x01 ", ""]
    assert tables._json_texts(texts) == json.dumps(texts, ensure_ascii=False)
