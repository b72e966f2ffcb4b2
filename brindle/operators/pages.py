"""Operators over extracted pages: text blocks, images, table of contents.

Blocks are rows (doc_id, page, x0, y0, x1, y1, text, height), images rows
(doc_id, page, image_no, xref, px_w, px_h, x0, y0, x1, y1, width, height), the
table of contents rows (doc_id, pos, title, page). An extractor makes them
(brindle.sources.extract); from there on all is declarative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config
from brindle.functions.text import clean_block, collapse

# Words that open a caption.
CAPTION_START = r"(?i)^\s*(fig(?:ure)?\.?|exhibit|diagram|screenshot|scr\.?|chart|plate|image)\b"
CAPTION_ANYWHERE = r"(?i)(fig(?:ure)?\.?\s*\d+[.\d]*\s*[:.\-–]?\s*[^\n]{0,120})"


def in_band(y0: Column, y1: Column, height: Column, config: Config = DEFAULT) -> Column:
    """Whether a block lies in the header or footer band of its page."""
    return (y1 <= height * config.band) | (y0 >= height * (1 - config.band))


def repeating_texts(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, text of bands that stand on each of the first pages."""
    first = blocks.where(F.col("page") <= config.sampled_pages)
    sampled = first.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    zone = first.where(in_band(F.col("y0"), F.col("y1"), F.col("height"), config)).select("doc_id", "page", F.trim("text").alias("text")).where("text <> ''")
    met = zone.groupBy("doc_id", "text").agg(F.count_distinct("page").alias("n"))
    return met.join(sampled, "doc_id").where("n = n_pages").select("doc_id", "text")


def content_start(toc: DataFrame) -> DataFrame:
    """doc_id, first_page: the least page of the table of contents."""
    return toc.groupBy("doc_id").agg(F.min("page").alias("first_page"))


def with_section(rows: DataFrame, toc: DataFrame) -> DataFrame:
    """Add the section of each row's page: the last entry before the first one, in the order of the contents, that lies on a later page.

    The running maximum of the entries' pages tells from which page on an entry
    holds; it never falls, so the title of a page is the last one carried forward
    to it. One pass over the pages and entries of a document.
    """
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    reach = toc.select("doc_id", "pos", "title", F.max("page").over(upto).alias("page"))
    marks = reach.groupBy("doc_id", "page").agg(F.max(F.struct("pos", "title")).alias("mark")).withColumn("kind", F.lit(0))
    pages = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), F.lit(1).alias("kind"))
    carried = F.last("mark", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page", "kind"))
    title = marks.unionByName(pages).withColumn("__mark", carried).where("kind = 1").select("doc_id", "page", F.col("__mark.title").alias("__section"))
    return rows.join(title, ["doc_id", "page"], "left").withColumn("section", F.coalesce("__section", F.lit("Unknown Section"))).drop("__section")


def text_passages(blocks: DataFrame, toc: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cleaned blocks of the content: no bands, no repeating texts, long enough, with their section."""
    rows = blocks.where(~in_band(F.col("y0"), F.col("y1"), F.col("height"), config)).withColumn("text", F.trim("text"))
    rows = rows.join(repeating_texts(blocks, config), ["doc_id", "text"], "left_anti")
    rows = of_content(rows, toc)
    rows = rows.withColumn("text", clean_block("text")).where(F.length("text") >= config.min_block)
    return with_section(rows, toc)


def table_markdown(cells: Column) -> Column:
    """Markdown of an array of rows of cells; null without a header or a row with any cell."""

    def clean(c: Column) -> Column:
        return collapse(F.coalesce(c, F.lit("")))

    rows = F.transform(cells, lambda r: F.transform(r, clean))
    data = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.exists(r, lambda c: c != ""))
    head = F.element_at(rows, 1)
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", r), F.lit(" |"))
    rule = line(F.transform(head, lambda _: F.lit("---")))
    valid = (F.size(rows) > 1) & F.exists(head, lambda c: c != "") & (F.size(data) > 0)
    return F.when(valid, F.concat_ws("\n", F.concat(F.array(line(head), rule), F.transform(data, line))))


def of_content(rows: DataFrame, toc: DataFrame) -> DataFrame:
    """Rows of pages from the start of the content on."""
    return rows.join(content_start(toc), "doc_id", "left").where(F.col("page") >= F.coalesce("first_page", F.lit(1))).drop("first_page")


def logo_xrefs(images: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, xref of images that are placed on many pages."""
    return images.groupBy("doc_id", "xref").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= config.repeat_pages).select("doc_id", "xref")


def figure_images(images: DataFrame, page_text: DataFrame, toc: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Images that are figures: no logo, icon, band or background, and only one at a place. page_text: doc_id, page, text. With a table of contents pages before the content are left out, of the logos' pages too."""
    images = images if toc is None else of_content(images, toc)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = images.join(logo_xrefs(images, config), ["doc_id", "xref"], "left_anti").where(F.least("px_w", "px_h") >= config.min_image_px).where((w > 1) & (h > 1))
    rows = rows.where(~in_band(F.col("y0"), F.col("y1"), F.col("height"), config)).withColumn("ratio", F.when(F.col("width") * F.col("height") > 0, w * h / (F.col("width") * F.col("height"))).otherwise(0.0))
    rows = rows.where((F.col("ratio") >= config.min_area) | ((w >= config.min_width_pt) & (h >= config.min_height_pt)))
    size = page_text.select("doc_id", "page", F.length("text").alias("__n"))
    rows = rows.join(size, ["doc_id", "page"], "left").where(~((F.col("ratio") >= config.full_page) & (F.coalesce("__n", F.lit(0)) >= config.full_page_text))).drop("__n", "ratio")
    return one_at_a_place(rows, config)


def one_at_a_place(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Greedy by image_no within a page: an image within the tolerance of a kept one on all four edges goes."""
    t = config.rect_tolerance

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, kept = None, []
        for pdf in batches:
            flags = []
            for d, p, *r in zip(pdf["doc_id"], pdf["page"], pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"]):
                if (d, p) != page:
                    page, kept = (d, p), []
                new = not any(all(abs(a - b) < t for a, b in zip(r, k)) for k in kept)
                if new:
                    kept.append(r)
                flags.append(new)
            yield pdf[flags]

    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "image_no").mapInPandas(keep, rows.schema)


def vector_figures(page_text: DataFrame, drawings: DataFrame, kept: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page, caption, context of pages without a kept image that name a figure and hold many drawings (doc_id, page, n_drawings): such a page is taken whole."""
    rows = page_text.join(drawings.where(F.col("n_drawings") >= config.min_drawings).select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    rows = rows.join(kept.select("doc_id", "page"), ["doc_id", "page"], "left_anti").withColumn("found", F.regexp_extract("text", CAPTION_ANYWHERE, 1)).where("found <> ''")
    return rows.select("doc_id", "page", F.substring(collapse("found"), 1, 160).alias("caption"), F.substring("text", 1, config.context_chars).alias("context"))


def document_passages(text: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """The three branches of a document's pages (doc_id, page, section, text) in one frame with chunk_type and branch; branch, page and place give the order."""
    out = None
    for n, (kind, rows) in enumerate((("text", text), ("table", tables), ("figure", figures))):
        one = rows.select("doc_id", "page", "section", "place", "text", F.lit(kind).alias("chunk_type"), F.lit(n).alias("branch"))
        out = one if out is None else out.unionByName(one)
    return out


def passage_metadata(passages: DataFrame, filename: Column, image_path: Column, image_text: Column) -> DataFrame:
    """Passages with what a store keeps of them: source_type, source_file, page, section, chunk_type, sensitivity_level, image_path, has_image_text."""
    return passages.select(
        "doc_id", F.lit("pdf").alias("source_type"), filename.alias("source_file"), F.col("page").cast("int").alias("page"), F.coalesce("section", F.lit("Unknown Section")).alias("section"), "chunk_type", F.lit("low").alias("sensitivity_level"),
        F.coalesce(image_path, F.lit("")).alias("image_path"), (F.coalesce(image_text, F.lit("")) != "").alias("has_image_text"), "branch", "place", "text",
    )


def captions(images: DataFrame, blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page, image_no, caption: the nearest short block below, else above, that overlaps the image sideways."""
    b = blocks.select("doc_id", "page", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"), collapse("text").alias("line"))
    near = images.select("doc_id", "page", "image_no", "x0", "y0", "x1", "y1").join(b, ["doc_id", "page"]).where(F.least("bx1", "x1") - F.greatest("bx0", "x0") > 0)
    below, above = F.col("by0") - F.col("y1"), F.col("y0") - F.col("by1")
    near = near.withColumn("side", F.when(below.between(0, config.caption_gap), 0).when(above.between(0, config.caption_gap), 1)).where("side is not null")
    near = near.withColumn("gap", F.when(F.col("side") == 0, below).otherwise(above)).where(F.col("line").rlike(CAPTION_START) | (F.length("line") <= 140))
    first = F.min(F.struct("side", "gap", "line"))
    return near.groupBy("doc_id", "page", "image_no").agg(first.alias("c")).select("doc_id", "page", "image_no", F.substring("c.line", 1, 160).alias("caption"))


def contexts(images: DataFrame, blocks: DataFrame, page_text: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page, image_no, context: blocks near the image from top to bottom, or the page's text where they say too little."""
    b = blocks.select("doc_id", "page", F.col("y0").alias("by0"), F.col("y1").alias("by1"), F.trim("text").alias("line")).where("line <> ''")
    pairs = images.select("doc_id", "page", "image_no", "y0", "y1").join(b, ["doc_id", "page"], "left")
    gap = F.greatest(F.col("by0") - F.col("y1"), F.col("y0") - F.col("by1"), F.lit(0.0))
    lines = F.collect_list(F.when(gap <= config.context_gap, F.struct("by0", "line")))
    one = pairs.groupBy("doc_id", "page", "image_no").agg(clean_block(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), " ")).alias("near"))
    both = one.join(page_text.select("doc_id", "page", F.col("text").alias("__page")), ["doc_id", "page"], "left")
    text = F.when(F.length("near") < 40, F.coalesce("__page", F.lit(""))).otherwise(F.col("near"))
    return both.select("doc_id", "page", "image_no", F.substring(text, 1, config.context_chars).alias("context"))


def figure_text(caption: Column, page: Column, context: Column, image_text: Column) -> Column:
    head = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("[Figure] "), caption)).otherwise(F.lit("[Figure]"))
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x)).otherwise(F.lit(""))
    return F.concat(head, F.lit(" — Page "), page.cast("string"), part(" — Context: ", context), part(" — Text in image: ", image_text))
