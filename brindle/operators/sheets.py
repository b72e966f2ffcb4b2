"""Sheets as rows of text cells: passages, metadata, overviews, routing.

A sheet is a frame of string columns and `_row_number` (2 for the first row
below the header), as the sources give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config
from brindle.functions.text import clean_cell, column_key, file_name

ROW = "_row_number"


def cleaned(sheet: DataFrame) -> DataFrame:
    """All cells cleaned, rows without any text dropped."""
    headers = [c for c in sheet.columns if c != ROW]
    rows = sheet.select(ROW, *[clean_cell(F.col(f"`{h}`")).alias(h) for h in headers])
    return rows.where(F.exists(F.array(*[F.col(f"`{h}`") for h in headers]), lambda x: x != "")) if headers else rows


def row_text(headers: list[str], file: str, sheet: str) -> Column:
    """A bracketed line of file, sheet and row, then a line for each filled cell."""
    head = F.concat(F.lit(f"[{file} · {sheet} · row "), F.col(ROW).cast("string"), F.lit("]"))
    cells = [F.when(F.col(f"`{h}`") != "", F.concat(F.lit(f"{h}: "), F.col(f"`{h}`"))) for h in headers]
    return F.concat_ws("\n", head, *cells)


def row_attributes(headers: list[str], config: Config = DEFAULT) -> Column:
    """Map of the first columns' filled cells, cut in length; of equal keys the later column's value holds."""
    entries = [F.struct(F.lit(column_key(h)).alias("k"), F.substring(F.col(f"`{h}`"), 1, config.metadata_chars).alias("v")) for h in headers[: config.metadata_columns]]
    if not entries:
        return F.create_map().cast("map<string,string>")
    filled = F.filter(F.array(*entries), lambda e: e["v"] != "")
    last = F.filter(filled, lambda e, i: ~F.exists(F.slice(filled, i + 2, F.size(filled)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def passages(sheet: DataFrame, file: str, sheet_name: str, doc_id: str, kind: str, config: Config = DEFAULT) -> DataFrame:
    """chunk_id, doc_id, source_type, source_file, sheet_name, chunk_type, row_number, row_key, text, attrs for each row."""
    rows = cleaned(sheet)
    headers = [c for c in rows.columns if c != ROW]
    key = F.col(f"`{headers[0]}`") if headers else F.lit("")
    return rows.select(
        F.concat(F.lit(f"{doc_id}_row_"), F.col(ROW).cast("string")).alias("chunk_id"), F.lit(doc_id).alias("doc_id"), F.lit(kind).alias("source_type"), F.lit(file).alias("source_file"), F.lit(sheet_name).alias("sheet_name"),
        F.lit("excel_row").alias("chunk_type"), F.col(ROW).cast("int").alias("row_number"), key.alias("row_key"), row_text(headers, file, sheet_name).alias("text"), row_attributes(headers, config).alias("attrs"),
    )


def column_values(sheet: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """column_no, column_name, n_values, value_list of columns with at most distinct_values filled values. Columns are counted in one pass; sets stop growing one above the limit."""
    rows = cleaned(sheet)
    headers = [c for c in rows.columns if c != ROW]
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column_no"), F.lit(h).alias("column_name"), F.col(f"`{h}`").alias("value")) for i, h in enumerate(headers)])).alias("c")).select("c.*").where("value <> ''")
    distinct = cells.groupBy("column_no", "column_name", "value").agg(F.lit(1).alias("one"))
    few = distinct.groupBy("column_no", "column_name").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") <= config.distinct_values)
    lists = distinct.join(few, ["column_no", "column_name"]).groupBy("column_no", "column_name", "n_values").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return lists.select("column_no", "column_name", "n_values", F.array_join("v", ", ").alias("value_list"))


def overview(sheet: DataFrame, file: str, sheet_name: str, kind: str, config: Config = DEFAULT) -> DataFrame:
    """One row: the text that tells the number of rows, the columns and the values of those with few."""
    headers = [c for c in sheet.columns if c != ROW]
    total = cleaned(sheet).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.col("column_name"), F.lit(" values ("), F.col("n_values").cast("string"), F.lit("): "), F.col("value_list"), F.lit("."))
    values = column_values(sheet, config).agg(F.array_sort(F.collect_list(F.struct("column_no", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit(f"[{file} · {sheet_name} · overview]\nThe file '{file}' (sheet '{sheet_name}') contains "), F.col("n").cast("string"), F.lit(f" {kind} records in total.\nColumns: {', '.join(headers)}."))
    both = total.crossJoin(F.broadcast(values))  # two frames of one row
    return both.select(F.lit(file).alias("source_file"), F.lit("sheet_summary").alias("chunk_type"), F.col("n").alias("n_rows"), F.concat_ws("\n", head, F.transform("lines", lambda x: x["line"])).alias("text"))


def target_collection(path: Column | str) -> Column:
    """incident or defect by the file's name; null where it tells neither."""
    low = F.lower(file_name(path))
    return F.when(low.contains("incident"), "incident").when(low.contains("defect") | low.contains("bug"), "defect")
