"""Structure of documents and sheets: headings, sections, cells and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line_no, line of non-blank lines."""
    each = df.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return each.where(F.trim("line") != "")


def sections(rows: DataFrame, heading: Column) -> DataFrame:
    """doc, section, heading, lines, characters: gaps and islands over lines; lines before any heading are section 0."""
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_h", heading).withColumn("section", F.sum(F.col("_h").cast("int")).over(w))
    return numbered.groupBy("doc", "section").agg(F.min(F.when(F.col("_h"), F.col("line"))).alias("heading"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


def meaningful_range(cells: DataFrame) -> DataFrame:
    """Bounding box of cells (sheet, r, c, v) that hold something."""
    return cells.where("v is not null and v <> ''").groupBy("sheet").agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"), F.count("*").alias("cells"))


def header_rows(cells: DataFrame, first_rows: int = 20) -> DataFrame:
    """Header and first data row of each sheet: the first of the first rows that is at least half filled,
    else the first row with low confidence; data start at the next row that holds something."""
    filled = cells.where("v is not null and v <> ''")
    width = filled.groupBy("sheet").agg((F.max("c") - F.min("c") + 1).alias("width"), F.min("r").alias("top"))
    per_row = filled.groupBy("sheet", "r").agg(F.count("*").alias("n")).join(width, "sheet")
    head = per_row.groupBy("sheet").agg(F.min(F.when((F.col("n") >= F.ceil(F.col("width") / 2)) & (F.col("r") < F.col("top") + first_rows), F.col("r"))).alias("h"), F.first("top").alias("top"))
    head = head.select("sheet", F.coalesce("h", "top").alias("header_row"), F.when(F.col("h").isNull(), "low").otherwise("high").alias("confidence"))
    after = per_row.join(head, "sheet").where("r > header_row").groupBy("sheet").agg(F.min("r").alias("data_row"))
    return head.join(after, "sheet", "left")


def records(cells: DataFrame, header: DataFrame) -> DataFrame:
    """sheet, r, record (header -> value): empty headers are column letters, repeated ones get the column in brackets."""
    names = cells.join(header.select("sheet", F.col("header_row").alias("r")), ["sheet", "r"]).select("sheet", "c", F.coalesce(F.nullif(F.trim("v"), F.lit("")), T.column_letter(F.col("c"))).alias("name"))
    nth = F.row_number().over(Window.partitionBy("sheet", "name").orderBy("c"))
    names = names.withColumn("name", F.when(nth > 1, F.concat("name", F.lit("("), T.column_letter(F.col("c")), F.lit(")"))).otherwise(F.col("name")))
    body = cells.join(header.select("sheet", "data_row"), "sheet").where("r >= data_row and v is not null and v <> ''")
    return body.join(names, ["sheet", "c"]).groupBy("sheet", "r").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("record"))


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, chunk_no, chunk: sentences of long fields."""
    each = df.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, r"[.!?。\n]+\s*")).alias("chunk_no", "chunk"))
    return each.where(F.trim("chunk") != "")


def deduplicated_json(df: DataFrame, ordinal: str) -> DataFrame:
    """Of rows with equal content that of the smallest ordinal."""
    rest = [c for c in df.columns if c != ordinal]
    return df.groupBy(*rest).agg(F.min(ordinal).alias(ordinal))
