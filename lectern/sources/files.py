"""Files as tables: dispatch by suffix, metadata, sections, JSON, and logs that are appended to.

Extraction libraries plug in as a callable (path, content) -> list of pages; none is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import SUPPORTED
from lectern.operators import chunking

PAGE = "path string, page_num int, title string, text string, has_image boolean, parser string, ocr_used boolean"


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(X.col(path), r"(\.[^./\\]+)$", 1))


def is_supported(path: str | Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def file_type(path: str | Column) -> Column:
    out = F.lit("Unknown")
    for k, v in SUPPORTED.items():
        out = F.when(suffix(path) == k, v).otherwise(out)
    return out


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, title, file_type, file_size_kb, content); unsupported files raise at run time, a missing path at once."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    kind = F.when(is_supported("path"), file_type("path")).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), "path")))
    return rows.select("path", F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1).alias("title"), kind.cast("string").alias("file_type"), F.round(F.col("length") / 1024, 1).alias("file_size_kb"), "content")


def extracted_pages(files: DataFrame, extract: Callable[[str, bytes], list[dict]], fallback: Callable[[str, bytes], list[dict]] | None = None) -> DataFrame:
    """Pages of each file by an extractor; if it fails or finds nothing, by the fallback."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in PAGE.split(", ")]
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = extract(path, content)
                except Exception:
                    if fallback is None:
                        raise
                    pages = []
                pages = pages or (fallback(path, content) if fallback else [])
                out += [{"path": path, "page_num": k, "title": None, "has_image": False, "parser": "custom", "ocr_used": False} | p for k, p in enumerate(pages, 1)]
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, PAGE)


def kept_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    return pages.where(F.length(X.strip(F.coalesce("text", F.lit("")))) >= least)


def page_range(pages: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Inclusive, and only if both bounds are given."""
    return pages.where(F.col("page_num").between(first, last)) if first and last else pages


def markdown_sections(files: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Sections of markdown files as pages; numbered before those of less than 30 characters are left out."""
    rows = chunking.sections(files, text_col)
    rows = rows.withColumns({"page_num": F.col("section") + 1, "text": F.col("body")}).drop("section", "body", text_col)
    image = F.col("text").rlike(X.IMAGE)
    rows = rows.withColumns({"has_image": image, "text_quality": X.section_quality("text"), "warnings": X.section_warnings("text")})
    return kept_pages(rows.withColumns(X.layout_flags("text", image)), 30)


def image_count(text: str | Column) -> Column:
    return F.regexp_count(X.col(text), F.lit(r"!\[.*?\]\(.*?\)"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def done_items(spark: SparkSession, path: str) -> DataFrame:
    """Items that a log names; none if there is no log yet."""
    from pyspark.errors import AnalysisException

    schema = "item_key string, n_mcqs long"
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clear_log(spark: SparkSession, path: str) -> bool:
    """Removes a log, so that the next run starts anew; False if there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def recovered_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages (text, has_image, ocr_text, second_text) with the text that stands, and (parser, ocr_used, warnings).

    A page of fewer than `least` characters with an image takes the text that was recognised in it, if that is long enough;
    otherwise such a page goes. A garbled text gives way to the second extractor's, if that is long enough and not garbled.
    Null texts count as empty. pages may carry further columns; those named like a result are replaced.
    """
    text, second = X.strip(F.coalesce("text", F.lit(""))), F.coalesce("second_text", F.lit(""))
    seen = X.strip(F.coalesce("ocr_text", F.lit("")))
    low, image = F.length(text) < least, F.coalesce("has_image", F.lit(False))
    first = pages.withColumns({"_low": low, "_text": F.when(low, seen).otherwise(text)}).where(~low | (image & (F.length(seen) >= least)))
    bad = X.is_garbled("_text")
    better = bad & (F.length(second) >= least) & ~X.is_garbled("second_text")
    warnings = F.array_compact(F.array(F.when(F.col("_low"), "low_text_with_image"), F.when(bad, "garbled_text_detected")))
    done = first.withColumns(
        {
            "text": F.when(better, second).otherwise(F.col("_text")),
            "parser": F.when(better, "pdfplumber").when(F.col("_low"), "pytesseract").otherwise("pymupdf4llm"),
            "ocr_used": F.col("_low"),
            "warnings": warnings,
        }
    )
    return done.drop("_low", "_text", "ocr_text", "second_text")
