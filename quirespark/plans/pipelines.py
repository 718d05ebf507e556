"""Composite pipelines: pages to text, pages to structure, layout-first parsing, and their renderings.

Each takes model adapters by factory: Python runs at the model boundary and for
order-dependent folds, everything between is relational. What a model or a fold
gave and several later steps read is settled, so that no page meets a model twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions import sequences as S
from quirespark.functions import text as T
from quirespark.functions.geometry import Box
from quirespark.operators import clusters, joins, lines, models, reading_order, render, suppress, tables, windows
from quirespark.operators.settle import settled
from quirespark.sources.images import crops

PAGE = ["doc_id", "page_idx"]
Factory = Callable[[], models.ModelAdapter]


def oriented(pages: DataFrame, classifier: Factory | None) -> DataFrame:
    """``pages`` (content) with orientation_angle; unknown labels turn nothing."""
    if classifier is None:
        return pages.withColumn("orientation_angle", F.lit(0.0))
    said = models.run_task(pages, "document_orientation", classifier, PAGE)
    angle = said.select(*PAGE, F.coalesce(E.orientation_angle(F.col("label")), F.lit(0.0)).alias("orientation_angle"))
    out = pages.join(angle, PAGE, "left")
    out = settled(out, "oriented")
    turn = _turned(out.select(*PAGE, "content", "orientation_angle"))
    return out.drop("content").join(turn, PAGE)


def _turned(pages: DataFrame) -> DataFrame:
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches):
        from quirespark.functions.pixels import decode, encode, turn

        for b in batches:
            content = [c if not a else encode(turn(decode(bytes(c)), -a % 360)) for c, a in zip(b["content"], b["orientation_angle"])]
            yield pd.DataFrame({**{k: b[k] for k in PAGE}, "content": content})

    return pages.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in PAGE) + ", content binary")


def ocr(pages: DataFrame, detector: Factory, recogniser: Factory, classifier: Factory | None = None, seal: bool = False, threshold: float = 0.0) -> DataFrame:
    """Text regions of pages (doc_id, page_idx, content, width, height): detect, order, crop, recognise, turn back."""
    up = oriented(pages, classifier)
    found = models.run_task(up, "text_detection", detector, PAGE).filter("error is null").withColumnRenamed("item", "idx").drop("error")
    ranked = reading_order.poly_order(found) if seal else reading_order.order_pages(found, "quad")
    boxes = settled(ranked.drop("idx").withColumnRenamed("rank", "idx"), "text-boxes")
    parts = crops(up, boxes)
    read = models.pooled_recognition(parts, recogniser, [*PAGE, "idx"], threshold=threshold)
    joined = boxes.join(read.withColumnRenamed("score", "confidence"), [*PAGE, "idx"], "left").join(up.select(*PAGE, "orientation_angle", "width", "height"), PAGE)
    corners = G.poly_rotate_back(G.poly_of(Box.of()), F.col("orientation_angle"), F.col("width"), F.col("height"))
    back = G.poly_box(corners)
    return joined.select(*PAGE, F.col("idx").alias("region_idx"), *back.select(), "text", "confidence", F.lit(None).cast("string").alias("label"), "positions", "columns", "steps", "error")


def refined(regions: DataFrame, elements: DataFrame, pages: DataFrame, recogniser: Factory) -> DataFrame:
    """Text regions read anew where layout parts them, and where a block has none.

    A region over several blocks is cropped to each (over a pixel both ways) and
    read again; the parts that read as something replace it. Other regions that
    such a crop nearly is (IoU above 0.8) lose their text. Blocks other than
    pictures that no text then meets are read whole. Formulas, tables and seals
    take no part.
    """
    blocks = elements.filter(~F.col("kind").isin("formula", "formula_number", "table", "seal")).select(*PAGE, F.col("idx").alias("b_idx"), "kind", "x1", "y1", "x2", "y2")
    r = regions.select(*PAGE, F.col("region_idx").alias("idx"), "x1", "y1", "x2", "y2")
    hits = joins.overlap_join(r, blocks, 3.0)
    parts = hits.withColumn("part", G.intersection_box(Box.of(), Box.of("r_"), 1.0)).groupBy(*PAGE, "idx").agg(F.sort_array(F.collect_list(F.struct("r_b_idx", "part"))).alias("ps")).filter("size(ps) > 1")
    cut = parts.select(*PAGE, F.col("idx").alias("of"), F.posexplode(F.filter("ps", lambda p: p["part"].isNotNull())).alias("n", "p")).select(*PAGE, "of", "n", "p.part.*")
    jobs = cut.withColumn("idx", F.struct("of", "n"))
    read = models.pooled_recognition(crops(pages, jobs.select(*PAGE, "idx", "x1", "y1", "x2", "y2")), recogniser, [*PAGE, "idx"])
    good = settled(jobs.join(read.select(*PAGE, "idx", F.col("text").alias("new_text"), F.col("score").alias("new_score")), [*PAGE, "idx"]).filter("new_text != ''"), "read-parts")
    like = good.select(*PAGE, "of", *(F.col(c).alias("c_" + c) for c in ("x1", "y1", "x2", "y2")))
    twins = r.join(like, PAGE).filter((F.col("idx") != F.col("of")) & (G.iou(Box.of(), Box.of("c_")) > 0.8)).select(*PAGE, F.col("idx").alias("region_idx")).distinct()
    split = good.select(*PAGE, F.col("of").alias("region_idx")).distinct()
    stay = regions.join(split, [*PAGE, "region_idx"], "left_anti").join(twins.withColumn("__gone", F.lit(True)), [*PAGE, "region_idx"], "left")
    columns = [*PAGE, "region_idx", "x1", "y1", "x2", "y2", "text", "confidence", "label"]
    stay = stay.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text"))).select(*columns)
    top = regions.groupBy(*PAGE).agg(F.max("region_idx").alias("__top"))
    kind = regions.schema["region_idx"].dataType
    fresh = good.join(top, PAGE).select(*PAGE, F.when(F.col("n") == 0, F.col("of")).otherwise(F.col("__top") + 1 + F.col("of") * 1000 + F.col("n")).cast(kind).alias("region_idx"), "x1", "y1", "x2", "y2", F.col("new_text").alias("text"), F.col("new_score").alias("confidence"), F.lit(None).cast("string").alias("label"))
    now = settled(stay.unionByName(fresh), "refined")
    plain = blocks.filter(~F.col("kind").isin("image", "chart")).withColumnRenamed("b_idx", "idx")
    empty = joins.associate(plain, now.filter("text != ''"), within=False)
    whole = models.pooled_recognition(crops(pages, empty), recogniser, [*PAGE, "idx"]).filter("text != ''")
    extra = empty.join(whole.select(*PAGE, "idx", "text", F.col("score").alias("confidence")), [*PAGE, "idx"]).join(top, PAGE, "left")
    return now.unionByName(extra.select(*PAGE, (F.coalesce("__top", F.lit(0)) + 1_000_000 + F.col("idx")).cast(kind).alias("region_idx"), "x1", "y1", "x2", "y2", "text", "confidence", F.lit(None).cast("string").alias("label")))


def split_by_cells(regions: DataFrame, cells: DataFrame, pages: DataFrame, recogniser: Factory) -> DataFrame:
    """Regions that cover over half of two or more cells, cut at the cells' edges along x and read again."""
    from quirespark.operators import paged

    r = regions.withColumnRenamed("region_idx", "idx")
    pairs = joins._sides(r.select(*PAGE, "idx", "x1", "y1", "x2", "y2"), cells.select(*PAGE, "x1", "y1", "x2", "y2"), PAGE, "r_")  # noqa: SLF001
    hit = pairs.filter(G.overlap_over_second(Box.of(), Box.of("r_")) > 0.5)
    packed = hit.groupBy(*PAGE, "idx").agg(F.first(Box.of().struct()).alias("b"), F.collect_list(Box.of("r_").struct()).alias("cs")).filter("size(cs) > 1")

    def run(rows: paged.Rows) -> paged.Rows:
        rect = lambda s: (s["x1"], s["y1"], s["x2"], s["y2"])
        return [{"of": x["idx"], "n": n, **dict(zip(("x1", "y1", "x2", "y2"), p))} for x in rows for n, p in enumerate(tables.segments_over_cells(rect(x["b"]), [rect(c) for c in x["cs"]]))]

    parts = paged.per_page(packed, run, f"of {regions.schema['region_idx'].dataType.simpleString()}, n int, x1 double, y1 double, x2 double, y2 double", PAGE).withColumn("idx", F.struct("of", "n"))
    read = models.pooled_recognition(crops(pages, parts.select(*PAGE, "idx", "x1", "y1", "x2", "y2")), recogniser, [*PAGE, "idx"])
    good = settled(parts.join(read.select(*PAGE, "idx", "text", F.col("score").alias("confidence")), [*PAGE, "idx"]).filter("text != ''"), "read-pieces")
    columns = [*PAGE, "region_idx", "x1", "y1", "x2", "y2", "text", "confidence", "label"]
    stay = regions.join(good.select(*PAGE, F.col("of").alias("region_idx")).distinct(), [*PAGE, "region_idx"], "left_anti").select(*columns)
    kind = regions.schema["region_idx"].dataType
    return stay.unionByName(good.select(*PAGE, (F.col("of") * 1000 + 100_000 + F.col("n")).cast(kind).alias("region_idx"), "x1", "y1", "x2", "y2", "text", "confidence", F.lit(None).cast("string").alias("label")))


def recognised_formulas(elements: DataFrame, pages: DataFrame, recogniser: Factory) -> DataFrame:
    """keys, formula_idx, box, latex, score of formula elements, spaces that mathematics ignores dropped."""
    asks = elements.filter(F.col("kind") == "formula").select(*PAGE, "idx", "x1", "y1", "x2", "y2")
    read = models.run_task(crops(pages, asks), "formula_recognition", recogniser, [*PAGE, "idx"]).filter("error is null")
    return asks.join(read, [*PAGE, "idx"]).select(*PAGE, F.col("idx").alias("formula_idx"), "x1", "y1", "x2", "y2", T.as_udf(T.normalise_latex)("latex").alias("latex"), "score")


def detected_seals(elements: DataFrame, pages: DataFrame, detector: Factory) -> DataFrame:
    """``elements`` and, as further seal elements, the seal texts found inside them, moved to page coordinates."""
    asks = elements.filter(F.col("kind") == "seal").select(*PAGE, "idx", "x1", "y1", "x2", "y2")
    found = models.run_task(crops(pages, asks), "seal_detection", detector, [*PAGE, "idx"]).filter("error is null").select(*PAGE, "idx", "item", "score", *(F.col(c).alias("s_" + c) for c in ("x1", "y1", "x2", "y2")))
    moved = G.translate(Box.of("s_"), F.floor(F.col("x1")), F.floor(F.col("y1")))
    top = elements.groupBy(*PAGE).agg(F.max("idx").alias("__top"))
    rows = asks.join(found, [*PAGE, "idx"]).join(top, PAGE).select(*PAGE, (F.col("__top") + 1 + F.col("idx") * 1000 + F.col("item")).cast(elements.schema["idx"].dataType).alias("idx"), F.lit("seal").alias("kind"), F.col("score").alias("confidence"), *moved.select())
    return elements.unionByName(rows, allowMissingColumns=True)


def analysed_tables(elements: DataFrame, pages: DataFrame, structure: Factory, classifier: Factory | None = None, detector: Factory | None = None) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of table elements: tokens and cell boxes, type, and detected cells reconciled with the structure's.

    Boxes of the models are moved from their crop to the page.
    """
    asks = elements.filter(F.col("kind") == "table").select(*PAGE, "idx", "x1", "y1", "x2", "y2")
    parts = crops(pages, asks)
    if classifier is not None or detector is not None:
        parts = settled(parts, "table-crops")
    key = [*PAGE, "idx"]
    read = models.run_task(parts, "table_structure", structure, key).filter("error is null")
    out = asks.join(read.select(*key, "tokens", "boxes", F.col("score").alias("structure_confidence")), key)
    if classifier is not None:
        said = models.run_task(parts, "table_classification", classifier, key)
        out = out.join(said.select(*key, E.table_type(F.col("label")).alias("table_type"), F.col("score").alias("classification_confidence")), key, "left")
    else:
        out = out.withColumn("table_type", F.lit("unknown")).withColumn("classification_confidence", F.lit(None).cast("double"))
    out = settled(out, "table-tokens")
    placed = out.withColumn("grid", tables.token_grid(F.col("tokens"))).select(*PAGE, "idx", F.floor("x1").alias("dx"), F.floor("y1").alias("dy"), F.posexplode(F.arrays_zip("boxes", "grid")).alias("cell_idx", "c"))
    box = G.box_from_coords(F.col("c.boxes"))
    moved = G.translate(Box.at(box), F.col("dx"), F.col("dy"))
    cells = placed.select(*PAGE, F.col("idx").alias("table_idx"), "cell_idx", *moved.select(), F.col("c.grid.row").alias("row"), F.col("c.grid.col").alias("col"), F.lit(None).cast("string").alias("text"))
    detected = F.lit(False)
    if detector is not None:
        found = models.run_task(parts, "table_cells", detector, key).filter("error is null").join(asks.select(*key, F.floor("x1").alias("dx"), F.floor("y1").alias("dy")), key)
        there = G.translate(Box.of(), F.col("dx"), F.col("dy"))
        boxes = found.select(*PAGE, F.col("idx").alias("table_idx"), F.col("item").alias("idx"), *there.select())
        keys = (*PAGE, "table_idx")
        fewer = clusters.reduce_to_structure(boxes, cells.withColumnRenamed("cell_idx", "idx"), keys)
        cells = joins.reconcile_cells(cells.withColumnRenamed("cell_idx", "idx"), fewer, keys).withColumnRenamed("idx", "cell_idx")
        detected = F.lit(True)
    done = out.select(*PAGE, F.col("idx").alias("table_idx"), "x1", "y1", "x2", "y2", "tokens", "table_type", E.table_confidence(F.col("classification_confidence"), F.col("structure_confidence")).alias("confidence"), F.lit(detector is None).alias("is_e2e"), detected.alias("has_detected"))
    return done, cells


def overall_ocr(pages: DataFrame, elements: DataFrame, detector: Factory, recogniser: Factory) -> DataFrame:
    """Text regions of pages under a known layout: detect, part by blocks, order, read, refine."""
    found = models.run_task(pages, "text_detection", detector, PAGE).filter("error is null").select(*PAGE, F.col("item").alias("idx"), "x1", "y1", "x2", "y2")
    parts = joins.split_by_blocks(settled(found, "text-boxes"), elements.filter(E.should_ocr(F.col("kind"))))
    ordered = settled(reading_order.order_pages(parts, "quad").drop("idx").withColumnRenamed("rank", "idx"), "ordered-boxes")
    read = models.pooled_recognition(crops(pages, ordered), recogniser, [*PAGE, "idx"])
    regions = ordered.join(read.select(*PAGE, "idx", "text", F.col("score").alias("confidence")), [*PAGE, "idx"], "left").withColumnRenamed("idx", "region_idx").withColumn("label", F.lit(None).cast("string"))
    return refined(settled(regions, "regions"), elements, pages, recogniser)


def structure_elements(detections: DataFrame, how: str = "enhanced") -> DataFrame:
    """Layout elements of detections (label, score, idx, box): typed, suppressed, fixed, ordered."""
    typed = detections.withColumn("kind", E.type_of(F.col("label")))
    kept = suppress.remove_overlaps(typed, 0.5, label="kind").drop("rank")
    fixed = windows.label_fixes(kept)
    return reading_order.order_pages(fixed.withColumn("num_lines", F.lit(None).cast("int")), how)


def structure(detections: DataFrame, regions: DataFrame, table_rows: DataFrame | None = None, cells: DataFrame | None = None, formulas: DataFrame | None = None) -> dict[str, DataFrame]:
    """elements, tables and markdown of pages from what the models found.

    The order of steps is semantic: tables take their texts first, formulas fill
    and small ones clear, elements take what overlaps, seals shadow, and what
    remains becomes elements of its own before everything is ordered and numbered.
    """
    base = settled(structure_elements(detections).drop("rank"), "elements")
    elements = base.select(*PAGE, "idx", "kind", "label", F.col("score").alias("confidence"), "x1", "y1", "x2", "y2", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("seg_start_x"), F.lit(None).cast("double").alias("seg_end_x"), "num_lines")
    filled = settled(tables.stitch_tables(table_rows, cells, regions, formulas), "tables") if table_rows is not None and cells is not None else None
    used = regions.select(*PAGE, F.col("region_idx").alias("idx")).limit(0)
    if filled is not None:
        used = used.unionByName(filled.select(*PAGE, F.explode("used_regions").alias("idx")))
    if formulas is not None:
        elements = joins.fill_formulas(elements, formulas.withColumnRenamed("formula_idx", "idx"))
        elements = settled(joins.clear_inline_formulas(elements), "formulas")
    stitched = lines.stitch_elements(elements, regions, formulas is not None)
    r = regions.withColumnRenamed("region_idx", "idx")
    takers = elements.filter(~F.col("kind").isin("table", *(["formula"] if formulas is not None else [])))
    used = used.unionByName(joins.associate(r, takers).select(*PAGE, "idx"))
    orphans = joins.orphan_regions(r, settled(used.distinct(), "used"), elements)
    top = elements.groupBy(*PAGE).agg(F.max("idx").alias("__top"))
    extra = orphans.join(top, PAGE, "left").select(
        *PAGE, (F.coalesce("__top", F.lit(-1)) + 1 + F.col("idx")).cast(elements.schema["idx"].dataType).alias("idx"), F.when(E.is_formula_region(F.col("label")), "formula").otherwise("text").alias("kind"), F.lit(None).cast("string").alias("label"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "x1", "y1", "x2", "y2", "text", F.lit(None).cast("double").alias("seg_start_x"), F.lit(None).cast("double").alias("seg_end_x"), F.lit(None).cast("int").alias("num_lines"),
    )
    everything = reading_order.order_pages(stitched.unionByName(extra), "enhanced")
    numbered = settled(windows.order_indices(everything), "numbered")
    done = filled.join(table_rows.select(*PAGE, "table_idx", "x1", "y1", "x2", "y2"), [*PAGE, "table_idx"]) if filled is not None else None
    levels = clusters.title_levels(numbered)
    out = {"elements": numbered, "markdown": render.page_markdown(numbered, done, levels), "html": render.page_html(numbered, done)}
    return out | ({"tables": done} if done is not None else {})


def parse_layout(detections: DataFrame, pages: DataFrame, recogniser: Factory, pretty: bool = True) -> DataFrame:
    """doc_id, page_idx, markdown by layout-first parsing: filter, merge, recognise by task, post-process, render.

    A page without layout is one region. ``pages`` has content, width, height.
    """
    kept = suppress.filter_overlaps(detections, 0.7).drop("rank")
    blank = pages.join(kept.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, F.lit(0).alias("idx"), F.lit("text").alias("label"), F.lit(1.0).alias("score"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("width").cast("double").alias("x2"), F.col("height").cast("double").alias("y2"))
    blocks = kept.select(*PAGE, F.col("idx").cast("int").alias("idx"), "label", "score", "x1", "y1", "x2", "y2").unionByName(blank)
    typed = blocks.withColumn("kind", E.type_of(F.col("label"))).filter(~E.is_auxiliary(F.col("kind")))
    typed = settled(typed, "blocks")
    jobs = crops(pages, typed).join(typed.select(*PAGE, "idx", E.recognition_task(F.col("kind")).alias("task")), [*PAGE, "idx"]).filter("task is not null")
    jobs = settled(jobs, "block-crops")
    read = models.keyed_recognition(jobs, recogniser, [*PAGE, "idx"]).join(jobs.select(*PAGE, "idx", "task"), [*PAGE, "idx"])
    body = F.when(F.col("task") == "table", T.as_udf(S.otsl_to_html)(F.col("text"))).when(F.col("task") == "formula", T.formula_block(F.col("text"))).otherwise(T.as_udf(lambda t: T.format_text(T.truncate_repeats(t)))(F.col("text")))
    texts = read.select(*PAGE, "idx", body.alias("text"))
    return render.vl_markdown(typed.join(texts, [*PAGE, "idx"], "left").withColumn("rank", F.col("idx")), pretty=pretty)


def document_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, markdown of whole documents from page Markdown and continuation flags, post-processed."""
    return render.concat_pages(pages).withColumn("markdown", T.as_udf(T.postprocess_markdown)("markdown"))
