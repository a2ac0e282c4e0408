"""Profiles of documents made of pages: counts, ratios and recommended strategies, in one aggregation by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import WHOLE_DOC_CHARS


def with_page_columns(pages: DataFrame) -> DataFrame:
    """Adds char_count, text_quality and the layout flags to pages (text, has_image)."""
    # words and lines are columns of their own, so that they are computed once and not in each expression
    rows = pages.withColumns({"_words": X.words("text"), "_lines": X.text_lines("text")})
    rows = rows.withColumns({"char_count": F.length("text"), "text_quality": X.page_quality("text", F.col("_words")), **X.layout_flags("text", F.col("has_image"), F.col("_lines"))})
    return rows.drop("_words", "_lines")


def chunk_strategy(c: dict[str, Column]) -> Column:
    """whole_doc, overlap, title or auto, from unrounded ratios."""
    return (
        F.when(c["total_chars"] <= WHOLE_DOC_CHARS, "whole_doc")
        .when(c["scan_suspected"] | (c["low_text_ratio"] > 0.5) | (c["garbled_ratio"] > 0.3) | (c["avg_chars"] < 300), "overlap")
        .when((c["table_ratio"] > 0.3) | (c["layout_sensitive_ratio"] > 0.4), "overlap")
        .when(c["column_ratio"] > 0.4, "title")
        .otherwise("auto")
    )


def document_profile(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row for each document. pages need char_count, text_quality, parser, has_image, ocr_used and the layout flags."""
    flag = lambda name: F.count_if(F.coalesce(F.col(name), F.lit(False)))
    sums = pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_units"),
        F.sum("char_count").alias("total_chars"),
        F.min("char_count").alias("min_chars"),
        F.max("char_count").alias("max_chars"),
        F.count_if(F.col("char_count") < 120).alias("low_text_units"),
        flag("has_image").alias("image_units"),
        flag("ocr_used").alias("ocr_units"),
        F.count_if(F.col("parser").isin("pdfplumber", "pytesseract")).alias("fallback_units"),
        flag("has_table").alias("table_units"),
        flag("has_formula").alias("formula_units"),
        flag("has_columns").alias("column_units"),
        flag("layout_sensitive").alias("layout_sensitive_units"),
        F.count_if(F.col("text_quality") == "garbled").alias("garbled_units"),
    )
    n = F.col("total_units")
    ratio = {k: F.col(f"{k}_units") / n for k in ("low_text", "image", "table", "formula", "column", "layout_sensitive", "garbled")}
    scan = (F.col("ocr_units") > 0) | ((ratio["low_text"] >= 0.6) & (ratio["image"] >= 0.5))
    recommended = (
        F.when(scan, "ocr_review")
        .when(ratio["low_text"] > 0.3, "low_text_review")
        .when(ratio["image"] > 0.4, "vision_or_image_review")
        .when(F.col("total_chars") <= WHOLE_DOC_CHARS, "whole_doc")
        .otherwise("native_text")
    )
    strategy = chunk_strategy(
        {"total_chars": F.col("total_chars"), "scan_suspected": scan, "avg_chars": F.col("total_chars") / n, **{f"{k}_ratio": v for k, v in ratio.items()}}
    )
    return sums.select(
        by, "total_units", "total_chars", F.round(F.col("total_chars") / n, 1).alias("avg_chars"), "min_chars", "max_chars",
        "low_text_units", "image_units", "ocr_units", "fallback_units", "table_units", "formula_units", "column_units", "layout_sensitive_units",
        *[F.round(v, 3).alias(f"{k}_ratio") for k, v in ratio.items()],
        scan.alias("scan_suspected"), recommended.alias("recommended_strategy"), strategy.alias("chunk_strategy"),
    )


def histogram(rows: DataFrame, by: str, what: str) -> DataFrame:
    """Counts as one map for each group, made of (by, what) counts, so that no group's rows are gathered."""
    counts = rows.groupBy(by, what).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(what), F.lit("unknown")).alias("k"), "n")))).alias(f"{what}_counts"))


def page_metrics(pages: DataFrame) -> DataFrame:
    """Extraction metrics of each page."""
    # a word of letters alone has no punctuation to strip, so a single letter is a word of length one
    w = F.col("_w")
    single = F.size(F.filter(w, lambda x: (F.length(x) == 1) & x.rlike(r"^\p{L}$")))
    pipes = F.size(F.filter(X.lines("text"), lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2))
    rows = pages.withColumns({"_w": X.words("text"), "_s": F.array_remove(F.transform(F.split("text", r"(?<=[.!?。])\s+|\n+"), X.strip), "")})
    complete = F.size(F.filter("_s", lambda s: F.size(X.words(s)) >= 5))
    out = rows.withColumns({"word_count": F.size(w), "_single": single, "_pipes": pipes, "_n": F.size("_s"), "_c": complete})
    wc = F.col("word_count")
    return out.withColumns(
        {
            "single_char_ratio": F.when(wc > 0, F.round(F.col("_single") / F.greatest(wc, F.lit(1)), 3)).otherwise(0.0),
            "table_readable": F.coalesce("has_table", F.lit(False)) & (F.col("_pipes") >= 2),
            "is_image_only": ~F.coalesce("ocr_used", F.lit(False)) & F.coalesce("has_image", F.lit(False)) & (F.col("char_count") < 80),
            "coherence_score": F.when(wc >= 10, F.when(F.col("_n") > 0, F.round(F.col("_c") / F.greatest("_n", F.lit(1)), 3)).otherwise(0.0)),
        }
    ).drop("_single", "_pipes", "_n", "_c", "_w", "_s")


def parse_quality(metrics: DataFrame, by: str = "doc_id") -> DataFrame:
    """Extraction metrics of each file; mean coherence over the pages that have one, 0 if none has."""
    n = F.count(F.lit(1))
    readable = F.count_if(F.col("has_table") & F.col("table_readable"))
    return metrics.groupBy(by).agg(
        n.alias("extracted_pages"),
        F.round(F.sum("char_count") / n, 1).alias("avg_chars_per_page"),
        F.count_if("has_table").alias("table_pages"),
        readable.alias("table_readable"),
        (F.count_if("has_table") - readable).alias("table_flat"),
        F.count_if("has_image").alias("image_pages"),
        F.count_if("is_image_only").alias("image_only_pages"),
        F.count_if(F.col("text_quality") == "garbled").alias("garbled_pages"),
        F.round(F.count_if(F.col("text_quality") == "garbled") / n, 3).alias("garbled_ratio"),
        F.coalesce(F.round(X.exact_mean("coherence_score"), 3), F.lit(0.0)).alias("avg_layout_coherence"),
    )


def title_flags(title: str | Column) -> dict[str, Column]:
    t = X.strip(F.coalesce(X.col(title), F.lit("")))
    return {"title_short": F.length(t) < 4, "title_numeric": t.rlike(r"^[\d\s.,]+$"), "title_caption": t.rlike(X.CAPTION)}


def chunk_flags(text: str | Column) -> dict[str, Column]:
    return {"chunk_short": F.length(X.col(text)) < 300, "chunk_long": F.length(X.col(text)) > 12_000}
