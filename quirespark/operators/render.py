"""Pages as Markdown, HTML and JSON.

Each element renders by a CASE over its type; windows bring what a rule needs of
its neighbours (the text before, the nearest non-formula on either side, title
votes); an ordered aggregate joins a page's parts, and a window over pages joins
a document's. No step holds more than one page or, for whole documents, one
document's Markdown.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions import text as T
from quirespark.functions.geometry import Box
from quirespark.operators.windows import continuation_flags, segment_flags

PAGE = ("doc_id", "page_idx")
CENTER, END = '<div style="text-align: center;">', "</div>"
NO_TABLE = "[Table]"


def _rows(*lines: str) -> str:
    return "".join(f"{x}\n" for x in lines)


def _best_table(elements: DataFrame, tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table elements with html of the first table of IoU above 0.5, and whether there is one."""
    t = tables.select(*keys, F.col("table_idx"), F.col("html").alias("t_html"), *(F.col(c).alias("t_" + c) for c in ("x1", "y1", "x2", "y2")))
    pairs = elements.filter(F.col("kind") == "table").join(t, list(keys)).filter(G.iou(Box.of(), Box.of("t_")) > 0.5)
    found = pairs.groupBy(*keys, "idx").agg(F.min_by(F.struct("t_html"), "table_idx").alias("__t"))
    return elements.join(found, [*keys, "idx"], "left")


def _first_table_as(html: Column, tag: str) -> Column:
    """The markup with its first bare table tag replaced."""
    at = F.instr(html, "<table>")
    return F.when(at > 0, F.concat(F.substr(html, F.lit(1), at - 1), F.lit(tag), F.substr(html, at + 7))).otherwise(html)


def _line_neighbours(elements: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """``elements`` with inline: the nearest non-formula on each side is text on the same line."""
    w = Window.partitionBy(*keys).orderBy(position)
    solid = F.when(~E.is_formula(F.col("kind")), F.struct("kind", "x1", "y1", "x2", "y2"))
    before = F.last(solid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(solid, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    on = lambda n: F.coalesce(n["kind"].isin("text", "reference_content") & G.same_line(Box.of(), Box.at(n)), F.lit(False))
    return elements.withColumn("__b", before).withColumn("__a", after).withColumn("inline", on(F.col("__b")) & on(F.col("__a"))).drop("__a", "__b")


def _image_markdown(page_width: Column) -> Column:
    r = lambda c: F.format_string("%.0f", F.bround(F.col(c).cast("double"), 0))
    share = F.least(F.greatest(F.floor((F.col("x2") - F.col("x1")) / F.when(page_width > 0, page_width).otherwise(1.0) * 100.0), F.lit(1)), F.lit(100))
    name = F.concat(F.lit("imgs/img_in_"), F.when(F.col("kind") == "chart", "chart").otherwise("image"), F.lit("_box_"), r("x1"), F.lit("_"), r("y1"), F.lit("_"), r("x2"), F.lit("_"), r("y2"), F.lit(".jpg"))
    return F.concat(F.lit(f'{CENTER}<img src="'), name, F.lit('" alt="Image" width="'), share.cast("string"), F.lit(f'%" />{END}'))


def markdown_parts(elements: DataFrame, tables: DataFrame | None = None, levels: DataFrame | None = None, pages: DataFrame | None = None, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, position, part, glued: each element's Markdown (null: none) and whether no blank line precedes it.

    ``elements`` has idx, kind, box, text, confidence, seg_start_x, seg_end_x and
    num_lines; ``levels`` are voted title levels (``clusters.title_levels``).
    """
    frame = elements
    on_page = Window.partitionBy(*keys)
    frame = frame.withColumn("page_w", F.max("x2").over(on_page))
    if pages is not None:
        frame = frame.join(pages.select(*keys, F.col("width").alias("__pw")), list(keys), "left").withColumn("page_w", F.coalesce("__pw", "page_w")).drop("__pw")
    # neighbours of formulas are taken before anything goes, as a column: a join by element would shuffle all texts twice
    frame = _line_neighbours(frame, keys, position)
    shown = frame.filter(~E.is_auxiliary(F.col("kind")))
    # doubtful text inside a table is a leftover of the table's cells; by page alone, so rows stay where they are
    t = frame.filter(F.col("kind") == "table").select(*(F.col(c).alias("t_" + c) for c in (*keys, "x1", "y1", "x2", "y2")))
    stray = (F.col("kind") == "text") & (F.col("confidence") < 0.7) & (G.ioa(Box.of(), Box.of("t_")) > 0.3)
    for k in keys:
        stray = (F.col(k) == F.col("t_" + k)) & stray
    shown = shown.join(t, stray, "left_anti")
    shown = segment_flags(shown, position, keys)
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    had_text = F.max(F.col("kind").isin("text", "reference_content").cast("int")).over(w) == 1
    shown = shown.withColumn("glued", (F.col("kind") == "text") & F.coalesce(had_text, F.lit(False)) & ~F.col("seg_start"))
    shown = _best_table(shown, tables, keys) if tables is not None else shown.withColumn("__t", F.lit(None).cast("struct<t_html:string>"))
    shown = shown.join(levels.select(*keys, "idx", "level"), [*keys, "idx"], "left") if levels is not None else shown.withColumn("level", F.lit(None).cast("int"))

    text, kind = F.col("text"), F.col("kind")
    cleaned = T.clean_ocr(text)
    keyword = F.upper(F.regexp_replace(T.strip(cleaned), ":+$", "")).isin(*T.KEYWORDS)
    titled = T.titled(cleaned, F.col("level"))
    plain = T.unwrapped_table(F.col("__t.t_html"))
    boxed = _first_table_as(plain, '<table border="1">')
    raw = T.strip(text)
    latex = F.when(raw.startswith("$$") & raw.endswith("$$"), F.substr(raw, F.lit(3), F.greatest(F.length(raw) - 4, F.lit(0)))).when(raw.startswith("$") & raw.endswith("$"), F.substr(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))).otherwise(raw)
    items = F.filter(F.transform(F.split(T.text_block(text), "\n"), T.strip), lambda x: x != "")
    part = (
        F.when(kind == "doc_title", F.concat(F.when(keyword, "## ").otherwise("# "), cleaned))
        .when((kind == "paragraph_title") & text.isNotNull(), F.concat(F.repeat(F.lit("#"), titled["level"]), F.lit(" "), titled["title"]))
        .when(kind == "paragraph_title", "## ")
        .when(kind == "table", F.coalesce(F.concat(F.lit(CENTER), T.clean_ocr(boxed), F.lit(END)), F.lit(NO_TABLE)))
        .when(kind == "formula_number", F.lit(None))
        .when((kind == "formula") & F.coalesce(raw != "", F.lit(False)), F.when(F.col("inline"), F.concat(F.lit("$"), latex, F.lit("$ "))).otherwise(F.concat(F.lit("$$"), latex, F.lit("$$"))))
        .when(kind == "formula", F.lit(None))
        .when(E.is_visual(kind), _image_markdown(F.col("page_w")))
        .when(kind == "seal", F.concat(F.lit("![Seal]"), F.coalesce(F.concat(F.lit("\n> "), text), F.lit(""))))
        .when(E.is_caption(kind), F.concat(F.lit(CENTER), cleaned, F.lit(" " + END)))
        .when(kind == "abstract", T.first_line(text, " ", ["abstract", "摘要"]))
        .when(kind == "reference", T.first_line(text, "\n", ["references", "参考文献"]))
        .when(kind == "content", T.content_block(text))
        .when(kind == "list", F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))
        .when(kind == "algorithm", F.regexp_replace(text, "^\n+|\n+$", ""))
        .when(T.has_bullets(cleaned), T.bullet_list(cleaned))
        .otherwise(T.text_block(text))
    )
    # titles without text still part their neighbours
    part = F.when((kind == "doc_title") & text.isNull(), F.lit("")).otherwise(part)
    glued = (F.col("glued") & ~F.coalesce(T.has_bullets(cleaned), F.lit(False))) | ((kind == "formula") & F.coalesce(F.col("inline"), F.lit(False)))
    return shown.select(*keys, F.col(position).alias("position"), part.alias("part"), glued.alias("glued")).filter("part is not null")


def _spaced(parts: Column, text: str, glued: Callable[[Column], Column] = lambda p: F.lit(False)) -> Column:
    """Texts of structs in order, a blank line before each that is not glued once there is output; in one pass over the parts."""
    # whatever precedes the first text is empty
    first = F.array_position(F.transform(parts, lambda p: p[text] != ""), True).cast("int")
    rest = F.transform(F.slice(parts, first + 1, F.size(parts)), lambda p: F.when(glued(p), p[text]).otherwise(F.concat(F.lit("\n\n"), p[text])))
    return F.when(first > 0, F.concat(F.get(parts, first - 1)[text], F.array_join(rest, ""))).otherwise("")


def _joined(parts: Column) -> Column:
    """Parts (structs position, part, glued) as one text."""
    return T.strip(_spaced(parts, "part", lambda p: p["glued"]))


def page_markdown(elements: DataFrame, tables: DataFrame | None = None, levels: DataFrame | None = None, pages: DataFrame | None = None, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, markdown of every page that has elements."""
    parts = markdown_parts(elements, tables, levels, pages, position, keys)
    joined = parts.groupBy(*keys).agg(_joined(F.sort_array(F.collect_list(F.struct("position", "part", "glued")))).alias("markdown"))
    return elements.select(*keys).distinct().join(joined, list(keys), "left").select(*keys, F.coalesce("markdown", F.lit("")).alias("markdown"))


def page_html(elements: DataFrame, tables: DataFrame | None = None, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, html of every page that has elements, in semantic tags with text escaped."""
    frame = _best_table(elements, tables, keys) if tables is not None else elements.withColumn("__t", F.lit(None).cast("struct<t_html:string>"))
    kind, text = F.col("kind"), T.escape_html(F.col("text"))
    said = F.coalesce(text, F.lit(""))
    wrap = lambda a, b: F.concat(F.lit(a), said, F.lit(b))
    caption = F.coalesce(F.concat(F.lit("<figcaption>"), text, F.lit("</figcaption>\n")), F.lit(""))
    styled = _first_table_as(T.unwrapped_table(F.col("__t.t_html")), '<table border="1" style="border-collapse: collapse;">')
    lines = F.filter(F.split(F.regexp_replace(F.col("text"), "\n$", ""), "\n", -1), lambda x: x.isNotNull())
    items = F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), T.escape_html(x), F.lit("</li>\n"))), ""), F.lit(""))
    part = (
        F.when(kind == "doc_title", wrap("<h1>", "</h1>\n"))
        .when(kind == "paragraph_title", wrap("<h2>", "</h2>\n"))
        .when(kind == "table", F.concat(F.coalesce(styled, F.lit(f"<p>{NO_TABLE}</p>")), F.lit("\n")))
        .when(E.is_formula(kind), wrap('<p class="formula">$$', "$$</p>\n"))
        .when(E.is_visual(kind), F.concat(F.lit('<figure>\n<img alt="Figure" />\n'), caption, F.lit("</figure>\n")))
        .when(kind == "seal", F.concat(F.lit('<figure class="seal">\n<img alt="Seal" />\n'), caption, F.lit("</figure>\n")))
        .when(E.is_caption(kind), caption)
        .when(kind == "abstract", wrap(_rows('<section class="abstract">', "<h3>Abstract</h3>") + "<p>", _rows("</p>", "</section>")))
        .when(kind.isin("reference", "reference_content"), wrap('<section class="references">\n<p>', "</p>\n</section>\n"))
        .when(kind == "list", F.concat(F.lit("<ul>\n"), items, F.lit("</ul>\n")))
        .when(E.is_header(kind), wrap("<header>", "</header>\n"))
        .when(E.is_footer(kind), wrap("<footer>", "</footer>\n"))
        .otherwise(F.coalesce(F.concat(F.lit("<p>"), text, F.lit("</p>\n")), F.lit("")))
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), part.alias("h")))), lambda s: s["h"]), "")
    head, tail = _rows("<!DOCTYPE html>", "<html>", "<head>", '<meta charset="UTF-8">', "</head>", "<body>"), _rows("</body>") + "</html>"
    return frame.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("html"))


def page_json(elements: DataFrame, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, json of every page: its elements in order, nulls left out."""
    cols = [c for c in elements.columns if c not in keys]
    rows = F.sort_array(F.collect_list(F.struct(F.col(position).alias("__p"), F.struct(*cols).alias("e"))))
    return elements.groupBy(*keys).agg(F.to_json(F.struct(F.transform(rows, lambda r: r["e"]).alias("layout_elements"))).alias("json"))


def concat_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_idx") -> DataFrame:
    """doc, markdown of pages (markdown, para_start, para_end) joined in order.

    A page that starts inside a paragraph follows one that ended inside it after
    a space, or directly if an ideograph is on either side; otherwise after a
    blank line. Blank pages are left out, but their end counts. A document of
    one page keeps that page's Markdown as it is.
    """
    w = Window.partitionBy(doc).orderBy(page)
    last = F.coalesce(F.lag("para_end").over(w), F.lit(True))
    alone = F.count(F.lit(1)).over(Window.partitionBy(doc)) == 1
    marked = pages.withColumn("__goes_on", ~F.col("para_start") & ~last).withColumn("__alone", alone)
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col("markdown").alias("m"), F.col("__goes_on").alias("g"))))
    body = F.filter(rows, lambda r: T.strip(r["m"]) != "")

    def piece(r: Column, before: Column) -> Column:
        tight = F.regexp_replace(r["m"], r"^\s+", "")
        wide = F.coalesce(T.is_cjk(before), F.lit(False)) | T.is_cjk(r["m"])
        return F.when(r["g"], F.concat(F.when(wide, F.lit("")).otherwise(F.lit(" ")), tight)).otherwise(F.concat(F.when(before.isNull(), F.lit("")).otherwise(F.lit("\n\n")), r["m"]))

    # each page beside the last character of the one before; the pair left over at the end is null
    ends = F.concat(F.array(F.lit(None).cast("string")), F.transform(body, lambda r: F.right(r["m"], F.lit(1))))
    joined = T.strip(F.array_join(F.zip_with(body, ends, piece), ""))
    return marked.groupBy(doc).agg(F.when(F.first("__alone"), F.first("markdown")).otherwise(joined).alias("markdown"))


def document_markdown(elements: DataFrame, tables: DataFrame | None = None, levels: DataFrame | None = None, pages: DataFrame | None = None, clean: bool = False, position: str = "rank") -> DataFrame:
    """doc_id, markdown of whole documents; ``clean`` post-processes the prose."""
    md = page_markdown(elements, tables, levels, pages, position)
    flags = continuation_flags(elements, pages, position)
    out = concat_pages(md.join(flags, list(PAGE), "left").withColumns({c: F.coalesce(c, F.lit(True)) for c in ("para_start", "para_end")}))
    return out.withColumn("markdown", T.as_udf(T.postprocess_markdown)("markdown")) if clean else out


def vl_markdown(elements: DataFrame, ignore: Sequence[str] = E.AUXILIARY, pretty: bool = True, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, markdown by raw label, for parser models; ``pretty`` centres titles and styles tables."""
    shown = elements.filter(~F.coalesce("label", F.lit("")).isin(*ignore))
    label, kind, text = F.coalesce("label", F.lit("")), F.col("kind"), F.coalesce("text", F.lit(""))
    title = T.as_udf(T.vl_title)(text)
    doc_title = T.clean_ocr(F.concat(F.lit("# "), text))
    block = F.replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))
    table = F.concat(F.lit("\n"), T.centered_table(text)) if pretty else T.unwrapped_table(F.concat(F.lit("\n"), text))
    part = (
        F.when(label.isin("paragraph_title", "abstract_title", "reference_title", "content_title"), title)
        .when(label == "doc_title", doc_title)
        .when(label.isin("table_title", "figure_title", "chart_title"), T.centered(text) if pretty else text)
        .when(label.isin("text", "ocr", "vertical_text", "reference_content"), block)
        .when(label == "abstract", T.first_line(text, " ", ["摘要", "abstract"], untrimmed=True))
        .when(label == "reference", T.first_line(text, "\n", ["参考文献", "references"], untrimmed=True))
        .when(label == "content", T.content_block(text))
        .when(label == "table", table)
        .when(label.isin("formula", "display_formula", "inline_formula"), text)
        .when(label == "algorithm", F.regexp_replace(text, "^\n+|\n+$", ""))
        .when(kind == "paragraph_title", title)
        .when(kind == "doc_title", doc_title)
    )
    if pretty:
        part = part.when(kind == "table", F.concat(F.lit("\n"), T.centered_table(text)))
    rows = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("__m").alias("m"))))
    return shown.withColumn("__m", part.otherwise(text)).groupBy(*keys).agg(_spaced(rows, "m").alias("markdown"))


def page_summary(regions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, n_regions, n_texts, mean_confidence and all_text (in order, by line) of each page's text regions."""
    texts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("region_idx", "text"))))
    return regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_regions"), F.count("text").alias("n_texts"), F.avg("confidence").alias("mean_confidence"), F.array_join(F.transform(texts, lambda s: s["text"]), "\n").alias("all_text")
    )


def page_dump(regions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, dump: one numbered line a region with its text, confidence and box."""
    line = F.format_string("[%d] %s (%s) at (%.1f, %.1f, %.1f, %.1f)", F.col("region_idx"), F.coalesce("text", F.lit("-")), F.coalesce(F.format_string("%.3f", F.col("confidence")), F.lit("-")), "x1", "y1", "x2", "y2")
    rows = F.sort_array(F.collect_list(F.struct("region_idx", line.alias("l"))))
    return regions.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda s: s["l"]), "\n").alias("dump"))


def pretty_json(value: str) -> str:
    return json.dumps(json.loads(value), indent=2, ensure_ascii=False)
