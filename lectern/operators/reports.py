"""Reports of a run: one robustness row for each file, logs of pages and chunks, and aligned tables as lines of text.

Everything is counted by file before tables meet, so joins are between one row for each file. Lines carry their order;
`write_lines` puts them into text files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import BLOOM

from . import profile


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, F.round(part / F.greatest(whole, F.lit(1)), 3)).otherwise(F.lit(empty))


def robustness(files: DataFrame, pages: DataFrame, chunks: DataFrame, checked: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each of files (doc_id, total_pages): what was parsed, chunked, asked and accepted, and at what latency.

    pages as for profile.document_profile, chunks (doc_id, chunk_type), checked as from questions.validated, calls
    (doc_id, status, provider, model, latency_seconds). A file without rows in one of them counts nothing there; its ratios
    of chunks are 0, those of pages without a known total 1, those of questions 1 by schema and 0 by content. Latencies are
    of successful calls that took time. A null chunk type counts as unknown, a null doc_id is a file of its own in none.
    """
    told = profile.document_profile(pages).select(
        "doc_id", F.col("total_units").alias("pages_extracted"), F.col("avg_chars").alias("avg_chars_per_page"), "scan_suspected", "chunk_strategy"
    )
    cut = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("chunk_type") == "conceptual").alias("_conceptual"))
    valid = F.col("layer").isNull()
    asked = checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_raw_mcqs"),
        F.count_if(valid).alias("valid_mcqs"),
        F.count_if(F.col("layer") == "schema").alias("schema_rejected"),
        F.count_if(F.col("layer") == "quality").alias("quality_rejected"),
        F.map_from_arrays(F.array(*[F.lit(b) for b in BLOOM]), F.array(*[F.count_if(valid & (F.col("bloom_level") == b)) for b in BLOOM])).alias("bloom_dist"),
    )
    timed = calls.where("status = 'success' AND latency_seconds > 0").withColumn("provider_call", F.concat(F.coalesce("provider", F.lit("")), F.lit("/"), F.substring_index(F.coalesce("model", F.lit("")), "/", -1)))
    spent = calls.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "skipped").alias("skipped_calls"),
        F.round(X.exact_mean(F.when((F.col("status") == "success") & (F.col("latency_seconds") > 0), F.col("latency_seconds"))), 2).alias("latency_per_call"),
    )
    reasons = checked.where(~valid).select("doc_id", F.substring_index("reason", ":", 1).alias("reject_reason"))
    parts = [told, cut, asked, spent, profile.histogram(chunks, "doc_id", "chunk_type"), profile.histogram(timed, "doc_id", "provider_call"), profile.histogram(reasons, "doc_id", "reject_reason")]
    rows = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, files.select("doc_id", "total_pages"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    none = F.create_map().cast("map<string,bigint>")
    return rows.select(
        "doc_id",
        F.coalesce("total_pages", n("pages_extracted")).cast("long").alias("total_pages"),
        n("pages_extracted").alias("pages_extracted"),
        _share(n("pages_extracted"), F.coalesce("total_pages", n("pages_extracted")), 1.0).alias("parse_success_rate"),
        F.coalesce("avg_chars_per_page", F.lit(0.0)).alias("avg_chars_per_page"),
        F.coalesce("scan_suspected", F.lit(False)).alias("scan_suspected"),
        F.coalesce("chunk_strategy", F.lit("auto")).alias("chunk_strategy"),
        n("total_chunks").alias("total_chunks"),
        _share(n("_conceptual"), n("total_chunks"), 0.0).alias("conceptual_ratio"),
        *[n(c).alias(c) for c in ("total_raw_mcqs", "valid_mcqs", "schema_rejected", "quality_rejected", "skipped_calls")],
        F.round(1 - n("schema_rejected") / F.greatest(n("total_raw_mcqs"), F.lit(1)), 3).alias("schema_pass_rate"),
        _share(n("valid_mcqs"), n("total_raw_mcqs"), 0.0).alias("content_pass_rate"),
        F.coalesce("latency_per_call", F.lit(0.0)).alias("latency_per_call"),
        *[F.coalesce(c, none).alias(c) for c in ("bloom_dist", "chunk_type_counts", "provider_call_counts", "reject_reason_counts")],
    )


def _cell(c: str | Column, width: int, right: bool) -> Column:
    """A text of exactly `width` characters, cut or filled with blanks; null is empty."""
    text = F.coalesce(X.col(c).cast("string"), F.lit(""))
    return F.lpad(F.substring(text, 1, width), width, " ") if right else F.rpad(F.substring(text, 1, width), width, " ")


def page_log(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, line): number, title and characters of each page. Null titles are empty, null texts have no characters."""
    line = F.concat(_cell("page_num", 7, False), _cell(F.substring("title", 1, 40), 43, False), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    return pages.select("doc_id", F.col("page_num").alias("ord"), line.alias("line"))


def chunk_log(chunks: DataFrame) -> DataFrame:
    """(doc_id, ord, line): id, topic, pages and characters of each chunk, then the mean of the characters.

    More than four pages show as the first, the last and their number.
    """
    size = F.size("pages")
    listed = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]"))
    short = F.concat(F.lit("["), F.get("pages", F.lit(0)).cast("string"), F.lit(".."), F.get("pages", size - 1).cast("string"), F.lit("]("), size.cast("string"), F.lit("p)"))
    chars = F.length(F.coalesce("text", F.lit("")))
    line = F.concat(_cell("chunk_id", 13, False), _cell(F.substring("topic", 1, 33), 36, False), _cell(F.when(size <= 4, listed).otherwise(short), 17, False), chars.cast("string"))
    rows = chunks.select("doc_id", F.col("grp").cast("long").alias("ord"), line.alias("line"))
    mean = chunks.groupBy("doc_id").agg((F.max("grp") + 1).cast("long").alias("ord"), F.concat(F.lit("Avg chars/chunk: "), F.round(F.avg(chars)).cast("long").cast("string")).alias("line"))
    return rows.unionByName(mean)


def table_lines(rows: DataFrame, columns: list[tuple[str, str | Column, int, bool]], order: str) -> DataFrame:
    """(ord, line): a heading, a rule, and one line for each row by `order`.

    columns: (heading, what, width, whether it is set to the right). Texts longer than their width are cut. A report has a
    row for each file at most, so one window numbers them.
    """
    line = lambda cells: F.concat_ws(" ", *cells)
    spark = rows.sparkSession
    head = spark.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).alias("ord"), line([_cell(F.lit(h), w, r) for h, _, w, r in columns]).alias("line")), F.struct(F.lit(1).alias("ord"), F.lit("─" * (sum(c[2] for c in columns) + len(columns) - 1)).alias("line")))).alias("x")
    ).select("x.*")
    body = rows.select((F.row_number().over(Window.orderBy(order)) + 1).alias("ord"), line([_cell(c, w, r) for _, c, w, r in columns]).alias("line"))
    return head.unionByName(body)


def percent(c: str, digits: int = 0) -> Column:
    return F.concat(F.round(F.col(c) * 100, digits).cast(f"decimal(12,{digits})").cast("string"), F.lit("%"))


def robustness_table(rows: DataFrame) -> DataFrame:
    """The rows of `robustness` as an aligned table."""
    pages = F.concat_ws("/", F.col("pages_extracted").cast("string"), F.col("total_pages").cast("string"))
    columns = [
        ("File", "doc_id", 38, False),
        ("Pages", pages, 9, True),
        ("Parse%", percent("parse_success_rate"), 7, True),
        ("Strategy", "chunk_strategy", 12, False),
        ("Chunks", "total_chunks", 6, True),
        ("Cncpt%", percent("conceptual_ratio"), 7, True),
        ("MCQs", "valid_mcqs", 5, True),
        ("Schema%", percent("schema_pass_rate"), 8, True),
        ("Valid%", percent("content_pass_rate"), 7, True),
        ("Lat/call", F.concat(F.round("latency_per_call", 1).cast("decimal(12,1)").cast("string"), F.lit("s")), 9, True),
    ]
    return table_lines(rows, columns, "doc_id")


def judge_table(rows: DataFrame, key: str) -> DataFrame:
    """Rows of means by dimension, as from questions.judge_stats, as an aligned table: every number to two places."""
    numbers = [c for c, t in rows.dtypes if c != key and t in ("double", "float", "bigint", "int")]
    columns = [(key, key, 38, False), *[(c, F.col(c).cast("decimal(12,2)"), max(len(c), 8), True) for c in numbers]]
    return table_lines(rows, columns, key)


def write_lines(lines: DataFrame, path: str, by: list[str]) -> None:
    """Text files with the lines in order; ranges of `by` and ord keep the files in order, too."""
    keys = [*by, "ord"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode("append").text(path)
