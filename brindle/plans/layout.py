"""Registered queries of page operators, with their DuckDB SQL.

The tables hold no page geometry, so placed blocks and images are derived from
the passages of pages by a rule, in the queries and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import pages
from brindle.session import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("source_type = 'pdf' and page is not null and text is not null").distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of pages of 600 x 800 points; every page has its document's name in the header."""
    c = _chunks(spark, d)
    own = c.select("doc_id", "page", (F.col("ord") * 37 % 300 + 40.0).alias("x0"), (F.col("ord") * 61 % 760 + 10.0).alias("y0"), F.lit(800.0).alias("height"), "text", F.col("ord").alias("pos"))
    head = c.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(40.0).alias("x0"), F.lit(12.0).alias("y0"), F.lit(800.0).alias("height"), F.concat(F.lit("Document "), "doc_id").alias("text"), F.lit(-1).alias("pos"))
    both = own.unionByName(head)
    return both.withColumn("x1", F.col("x0") + 250).withColumn("y1", F.col("y0") + 30)


def images(spark: SparkSession, d: str) -> DataFrame:
    """An image for each passage of tables and figures."""
    o = F.col("ord")
    rows = _chunks(spark, d).where("chunk_type in ('table', 'figure')").select("doc_id", "page", o.alias("image_no"), (F.length("text") % 40).alias("xref"), (o * 29 % 300 + 60).alias("px_w"), (o * 17 % 300 + 60).alias("px_h"), (o * 13 % 200 + 0.0).alias("x0"), (o * 31 % 500 + 20.0).alias("y0"), (o * 53 % 400 + 20.0).alias("w"), (o * 41 % 300 + 20.0).alias("h"))
    return rows.select("doc_id", "page", "image_no", "xref", "px_w", "px_h", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).where("section is not null")
    return c.groupBy("doc_id", F.col("section").alias("title")).agg(F.min("ord").alias("pos"), F.min("page").alias("page"))


def _page_text(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.text_passages(blocks(spark, d), contents(spark, d))
    return rows.select("doc_id", "page", "pos", "section", F.md5("text").alias("text_md5"))


def repeating_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.repeating_texts(blocks(spark, d))


def figure_images(spark: SparkSession, d: str) -> DataFrame:
    return pages.figure_images(images(spark, d), _page_text(spark, d), contents(spark, d)).select("doc_id", "page", "image_no")


def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    return pages.captions(images(spark, d), blocks(spark, d)).select("doc_id", "page", "image_no", F.md5("caption").alias("caption_md5"))


def figure_texts(spark: SparkSession, d: str) -> DataFrame:
    """The passage of each image: caption, page, what stands near it."""
    i, b = images(spark, d), blocks(spark, d)
    near = pages.contexts(i, b, _page_text(spark, d))
    rows = near.join(pages.captions(i, b), ["doc_id", "page", "image_no"], "left")
    return rows.select("doc_id", "page", "image_no", F.md5("context").alias("context_md5"), F.md5(pages.figure_text(F.col("caption"), F.col("page"), F.col("context"), F.lit(""))).alias("text_md5"))


def vector_figures(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose passages name a figure, with a made-up number of drawings, and no kept image."""
    text = _page_text(spark, d)
    drawings = text.select("doc_id", "page", (F.length("text") % 60).alias("n_drawings"))
    kept = pages.figure_images(images(spark, d), text, contents(spark, d))
    return pages.vector_figures(text, drawings, kept).select("doc_id", "page", "caption", F.md5("context").alias("context_md5"))


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Text, tables and figures of all pages in one frame with what a store keeps of them."""
    c = _chunks(spark, d)
    parts = [c.where(F.col("chunk_type") == kind).select("doc_id", "page", "section", F.col("ord").alias("place"), "text") for kind in ("text", "table", "figure")]
    rows = pages.passage_metadata(pages.document_passages(*parts), F.concat("doc_id", F.lit(".pdf")), F.when(F.col("chunk_type") == "figure", F.concat("doc_id", F.lit("/"), "place", F.lit(".png"))), F.when(F.col("chunk_type") == "figure", F.col("text")))
    return rows.select("doc_id", "source_file", "page", "section", "chunk_type", "branch", "place", "image_path", "has_image_text", F.md5("text").alias("text_md5"))


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of tables whose cells are the lines and columns of the passages of tables."""
    cells = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, r"\|"), lambda x: F.trim(x)))
    return _chunks(spark, d).where("chunk_type = 'table'").select("chunk_id", F.md5(pages.table_markdown(cells)).alias("markdown_md5"))


PLANS = [page_passages, repeating_texts, figure_images, figure_captions, figure_texts, vector_figures, page_documents, page_tables]

_C = "c AS MATERIALIZED (SELECT DISTINCT * FROM chunks WHERE source_type = 'pdf' AND page IS NOT NULL AND text IS NOT NULL)"
_B = """b AS MATERIALIZED (SELECT *, x0 + 250 AS x1, y0 + 30 AS y1 FROM (
        SELECT doc_id, page, ord * 37 % 300 + 40.0::DOUBLE AS x0, ord * 61 % 760 + 10.0::DOUBLE AS y0, text, ord AS pos FROM c UNION ALL SELECT DISTINCT doc_id, page, 40.0, 12.0, 'Document ' || doc_id, -1 FROM c))"""
_I = """i AS MATERIALIZED (SELECT doc_id, page, image_no, xref, px_w, px_h, x0, y0, x0 + w AS x1, y0 + h AS y1, w, h FROM (SELECT doc_id, page, ord AS image_no, length(text) % 40 AS xref, ord * 29 % 300 + 60 AS px_w, ord * 17 % 300 + 60 AS px_h,
        ord * 13 % 200 + 0.0::DOUBLE AS x0, ord * 31 % 500 + 20.0::DOUBLE AS y0, ord * 53 % 400 + 20.0::DOUBLE AS w, ord * 41 % 300 + 20.0::DOUBLE AS h FROM c WHERE chunk_type IN ('table', 'figure')))"""
_T = "t AS (SELECT doc_id, section AS title, min(ord) AS pos, min(page) AS page FROM c WHERE section IS NOT NULL GROUP BY 1, 2), f AS (SELECT doc_id, min(page) AS first_page FROM t GROUP BY 1)"
_R = """z AS (SELECT DISTINCT doc_id, page, trim(text) AS text FROM b WHERE page <= 5 AND (y1 <= 80 OR y0 >= 720) AND trim(text) <> ''),
    r AS (SELECT z.doc_id, z.text FROM z JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM b WHERE page <= 5 GROUP BY 1) s USING (doc_id) GROUP BY ALL HAVING count(*) = any_value(s.n))"""
_KEPT = """
            s AS (SELECT i.* FROM i LEFT JOIN f USING (doc_id) WHERE i.page >= coalesce(first_page, 1)), l AS (SELECT doc_id, xref FROM s GROUP BY 1, 2 HAVING count(DISTINCT page) >= 4),
            k AS (SELECT s.* FROM s LEFT JOIN p USING (doc_id, page) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = s.doc_id AND l.xref = s.xref) AND least(px_w, px_h) >= 90 AND NOT (y1 <= 80 OR y0 >= 720)
                AND (w * h / 480000 >= 0.05 OR w >= 170 AND h >= 120) AND NOT (w * h / 480000 >= 0.9 AND length(coalesce(p.text, '')) >= 450)),
            g AS (SELECT doc_id, page, list_reduce(list([{'n': image_no, 'a': x0, 'b': y0, 'c': x1, 'd': y1}] ORDER BY image_no), lambda q, x: CASE WHEN len(list_filter(q, lambda y: abs(y.a - x[1].a) < 3 AND abs(y.b - x[1].b) < 3 AND abs(y.c - x[1].c) < 3 AND abs(y.d - x[1].d) < 3)) > 0 THEN q ELSE list_concat(q, x) END) AS kept FROM k GROUP BY 1, 2),
            kept AS (SELECT doc_id, page, unnest(list_transform(kept, lambda y: y.n)) AS image_no FROM g)"""
_P = "p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord, text) AS text FROM c GROUP BY 1, 2)"


def sql(clean: str) -> dict[str, str]:
    """clean: SQL of a cleaned block of `text`."""
    line = r"trim(regexp_replace(b.text, '[\s\p{Z}]+', ' ', 'g'))"
    caption = rf"""k AS (SELECT doc_id, page, image_no, line, CASE WHEN below BETWEEN 0 AND 60 THEN 0 WHEN above BETWEEN 0 AND 60 THEN 1 END AS side, CASE WHEN below BETWEEN 0 AND 60 THEN below ELSE above END AS gap FROM (
            SELECT i.doc_id, i.page, i.image_no, {line} AS line, b.y0 - i.y1 AS below, i.y0 - b.y1 AS above FROM i JOIN b ON b.doc_id = i.doc_id AND b.page = i.page AND least(b.x1, i.x1) - greatest(b.x0, i.x0) > 0)
            WHERE length(line) <= 140 OR regexp_matches(line, '^\s*(fig(?:ure)?\.?|exhibit|diagram|screenshot|scr\.?|chart|plate|image)\b', 'i')),
        cap AS (SELECT doc_id, page, image_no, substr(line, 1, 160) AS caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, image_no ORDER BY side, gap, line) AS n FROM k WHERE side IS NOT NULL) WHERE n = 1)"""
    cell = r"trim(regexp_replace(trim(x), '[\s\p{Z}]+', ' ', 'g'))"
    return {
        "page_passages": f"""WITH {_C}, {_B}, {_T}, {_R},
            k AS (SELECT b.doc_id, b.page, b.pos, trim(b.text) AS text FROM b LEFT JOIN f USING (doc_id) WHERE NOT (y1 <= 80 OR y0 >= 720) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.text = trim(b.text)) AND b.page >= coalesce(first_page, 1)),
            e AS (SELECT doc_id, page, pos, {clean} AS text FROM k), u AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY pos) AS reach FROM t),
            s AS (SELECT x.doc_id, x.page, arg_max(u.title, u.pos) AS title FROM (SELECT DISTINCT doc_id, page FROM e) x JOIN u ON u.doc_id = x.doc_id AND u.reach <= x.page GROUP BY 1, 2)
            SELECT e.doc_id, e.page, e.pos, coalesce(s.title, 'Unknown Section') AS section, md5(e.text) AS text_md5 FROM e LEFT JOIN s USING (doc_id, page) WHERE length(e.text) >= 30
        """,
        "repeating_texts": f"WITH {_C}, {_B}, {_R} SELECT doc_id, text FROM r",
        "vector_figures": rf"""WITH {_C}, {_I}, {_T}, {_P}, {_KEPT}
            SELECT doc_id, page, substr(trim(regexp_replace(found, '[\s\p{{Z}}]+', ' ', 'g')), 1, 160) AS caption, md5(substr(text, 1, 700)) AS context_md5
            FROM (SELECT *, regexp_extract(text, '(fig(?:ure)?\.?\s*\d+[.\d]*\s*[:.\-–]?\s*[^\n]{{0,120}})', 1, 'i') AS found FROM p) WHERE found <> '' AND length(text) % 60 >= 20 AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.doc_id = p.doc_id AND kept.page = p.page)
        """.replace("FROM p) WHERE found", "FROM p) p WHERE found"),
        "page_documents": f"""WITH {_C}
            SELECT doc_id, doc_id || '.pdf' AS source_file, page, coalesce(section, 'Unknown Section') AS section, chunk_type, (list_position(['text', 'table', 'figure'], chunk_type) - 1)::INT AS branch, ord AS place,
                CASE WHEN chunk_type = 'figure' THEN doc_id || '/' || ord || '.png' ELSE '' END AS image_path, chunk_type = 'figure' AND text <> '' AS has_image_text, md5(text) AS text_md5 FROM c
        """,
        "figure_images": f"WITH {_C}, {_I}, {_T}, {_P}, {_KEPT} SELECT * FROM kept",
        "figure_captions": f"WITH {_C}, {_B}, {_I}, {caption} SELECT doc_id, page, image_no, md5(caption) AS caption_md5 FROM cap",
        "figure_texts": f"""WITH {_C}, {_B}, {_I}, {_P}, {caption},
            m AS (SELECT i.doc_id, i.page, i.image_no, string_agg(trim(b.text), ' ' ORDER BY b.y0, trim(b.text)) FILTER (greatest(b.y0 - i.y1, i.y0 - b.y1, 0) <= 180 AND trim(b.text) <> '') AS text FROM i LEFT JOIN b USING (doc_id, page) GROUP BY 1, 2, 3),
            n AS (SELECT doc_id, page, image_no, {clean} AS near FROM (SELECT * EXCLUDE (text), coalesce(text, '') AS text FROM m)),
            x AS (SELECT n.doc_id, n.page, n.image_no, substr(CASE WHEN length(near) < 40 THEN coalesce(p.text, '') ELSE near END, 1, 700) AS context, caption FROM n LEFT JOIN p USING (doc_id, page) LEFT JOIN cap USING (doc_id, page, image_no))
            SELECT doc_id, page, image_no, md5(context) AS context_md5, md5('[Figure]' || CASE WHEN coalesce(caption, '') <> '' THEN ' ' || caption ELSE '' END || ' — Page ' || page || CASE WHEN context <> '' THEN ' — Context: ' || context ELSE '' END) AS text_md5 FROM x
        """,
        "page_tables": f"""WITH {_C}, r AS (SELECT chunk_id, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l, '|'), lambda x: {cell})) AS cells FROM c WHERE chunk_type = 'table'),
            d AS (SELECT *, list_filter(cells[2:], lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS data FROM r)
            SELECT chunk_id, md5(CASE WHEN len(cells) > 1 AND len(list_filter(cells[1], lambda x: x <> '')) > 0 AND len(data) > 0
                THEN array_to_string(list_concat(['| ' || array_to_string(cells[1], ' | ') || ' |', '| ' || array_to_string(list_transform(cells[1], lambda x: '---'), ' | ') || ' |'], list_transform(data, lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) END) AS markdown_md5 FROM d
        """,
    }
