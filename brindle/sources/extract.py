"""Schemas of what page extractors give; an extractor is a callable (path, bytes) -> rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .files import extracted

BLOCKS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, height double, text string"
IMAGES = "doc_id string, page int, image_no int, xref int, px_w int, px_h int, x0 double, y0 double, x1 double, y1 double, width double, height double"
CONTENTS = "doc_id string, pos int, level int, title string, page int"
TABLES = "doc_id string, page int, table_no int, cells array<array<string>>"


def blocks(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    return extracted(files, extractor, BLOCKS)


def images(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    return extracted(files, extractor, IMAGES)


def contents(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    return extracted(files, extractor, CONTENTS)


def tables(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    return extracted(files, extractor, TABLES)
