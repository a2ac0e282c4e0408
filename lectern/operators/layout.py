"""Layout blocks of a page: type, column and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X


def page_blocks(blocks: DataFrame, page: list[str], width: float, height: float, most: int | None = None) -> DataFrame:
    """Adds (block_type, column_index, reading_order); `most` cuts after the order is numbered.

    Two columns need two centres in the left 45 % and two in the right 45 % of the page.
    """
    own = Window.partitionBy(*page)
    clean = X.strip_markdown("text")
    cx = (F.col("x0") + F.col("x1")) / 2
    rows = blocks.withColumns({"_base": F.median("font_size").over(own), "_cx": cx})
    two = (F.count_if(F.col("_cx") < width * 0.45).over(own) >= 2) & (F.count_if(F.col("_cx") > width * 0.55).over(own) >= 2)
    kind = (
        F.when(F.col("y1") < height * 0.08, "header")
        .when(F.col("y0") > height * 0.92, "footer")
        .when(clean.rlike(X.CAPTION), "caption")
        .when(clean.rlike(X.FORMULA), "formula")
        .when(X.looks_like_table(X.lines(clean)), "table")
        .when(clean.rlike(r"^(\d+[.)]|[-*•])\s+"), "list")
        .when((F.col("_base") > 0) & (F.col("font_size") >= F.col("_base") * 1.45), "title")
        .when(F.col("is_bold") | ((F.col("_base") > 0) & (F.col("font_size") >= F.col("_base") * 1.18)), "heading")
        .otherwise("text")
    )
    rows = rows.withColumns({"block_type": kind, "column_index": F.when(two & (F.col("_cx") >= width * 0.5), 1).otherwise(0)}).drop("_base", "_cx")
    order = Window.partitionBy(*page).orderBy("column_index", "y0", "x0", "block_no", "text", "font_size")
    rows = rows.withColumn("reading_order", F.row_number().over(order) - 1)
    return rows if most is None else rows.where(F.col("reading_order") < most)
