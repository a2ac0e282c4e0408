"""Pages to chunks: near-duplicate pages, consecutive titles, word overlap, fixed size or the whole document.

Rules that depend on what was kept or grouped before are in pagesets; the rest are windows by document over slim rows. No
task gets the texts of a whole document; (doc_id, page_num) tells pages apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import DUPLICATE, INSTRUCTIONAL_TOPICS, LONG_CHUNK_CHARS, MAX_PAGES, MIN_CHUNK_CHARS, OVERLAP, SPACE, STRUCTURAL_TOPICS, WEAK_IMAGE_CHARS
from lectern.sources.tables import staged

from . import pagesets


def _by_page():
    return Window.partitionBy("doc_id").orderBy("page_num")


def dedup_pages(pages: DataFrame, keep_last: int = 3) -> DataFrame:
    """Drop a page whose word set is more than 0.95 similar to one of the last three kept pages of its document."""
    return pagesets.joined(pages, pagesets.twins(pages, DUPLICATE, keep_last), how="left_anti")


def _title_groups(pages: DataFrame, max_pages: int) -> DataFrame:
    """(doc_id, page_num, title, grp), so that windows do not take texts along."""
    t = pages.select("doc_id", "page_num", "title", X.normalize_title("title").alias("_t"))
    t = t.withColumn("_new", F.coalesce((~F.lag("_t").over(_by_page()).eqNullSafe(F.col("_t"))).cast("int"), F.lit(1)))
    t = t.withColumn("_new", F.when(F.row_number().over(_by_page()) == 1, 1).otherwise(F.col("_new")))
    t = t.withColumn("_run", F.sum("_new").over(_by_page()))
    t = t.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("page_num")) - 1) / max_pages))
    return t.select("doc_id", "page_num", "title", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_run", "_part")).alias("grp"))


def groups_by_title(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Adds grp: consecutive pages with one normalized title, at most max_pages together."""
    return pagesets.joined(pages, _title_groups(pages, max_pages).drop("title"))


def groups_by_overlap(pages: DataFrame, max_pages: int = MAX_PAGES, least: float = OVERLAP) -> DataFrame:
    """Adds grp: a page goes on with a chunk if its words overlap those of the chunk's last two pages."""
    return pagesets.joined(pages, pagesets.overlap_groups(pages, max_pages, least))


def groups_fixed(pages: DataFrame, size: int, max_pages: int = MAX_PAGES) -> DataFrame:
    slim = pages.select("doc_id", "page_num")
    return pagesets.joined(pages, slim.withColumn("grp", (F.floor((F.row_number().over(_by_page()) - 1) / min(size, max_pages)) + 1).cast("int")))


def build_chunks(grouped: DataFrame) -> DataFrame:
    """Chunks of pages with grp: topic of the first page, texts in order, page numbers, whether any has an image."""
    pages = F.array_sort(F.collect_list(F.struct("page_num", "title", F.coalesce("text", F.lit("")).alias("text"))))
    rows = grouped.groupBy("doc_id", "grp").agg(pages.alias("p"), F.coalesce(F.bool_or("has_image"), F.lit(False)).alias("has_image"))
    return rows.select(
        "doc_id",
        F.col("grp").cast("int").alias("grp"),
        F.get("p", F.lit(0))["title"].alias("topic"),
        F.transform("p", lambda x: x["page_num"]).alias("pages"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"),
        "has_image",
    )


def whole_doc_chunks(pages: DataFrame) -> DataFrame:
    """One chunk for each document: pages with text, each under its title, between rules. Without any: an empty one."""
    text = X.strip("text")
    p = F.array_sort(F.collect_list(F.when(text != "", F.struct("page_num", "title", text.alias("text")))))
    rows = pages.groupBy("doc_id").agg(p.alias("p"), F.coalesce(F.bool_or(F.col("has_image") & (text != "")), F.lit(False)).alias("has_image"))
    head = lambda x: F.when(F.coalesce(x["title"], F.lit("")) != "", x["title"]).otherwise(F.concat(F.lit("Page "), x["page_num"].cast("string")))
    return rows.select(
        "doc_id",
        F.lit(1).alias("grp"),
        F.coalesce(F.get("p", F.lit(0))["title"], F.lit("Document")).alias("topic"),
        F.transform("p", lambda x: x["page_num"]).alias("pages"),
        F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), head(x), F.lit("]\n"), x["text"])), "\n\n---\n\n").alias("text"),
        "has_image",
        F.lit(True).alias("is_whole_doc"),
    )


def auto_groups(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """By title, unless the share of different topics says that titles tell too little or too much; then by overlap."""
    titled = _title_groups(pages, max_pages)
    heads = titled.groupBy("doc_id", "grp").agg(F.min_by("title", "page_num").alias("topic"))
    share = heads.groupBy("doc_id").agg(F.count_distinct("topic").alias("u"), F.count(F.lit(1)).alias("n"))
    share = staged(share.select("doc_id", ((F.col("u") / F.col("n") < 0.4) | ((F.col("u") / F.col("n") > 0.85) & (F.col("n") > 15))).alias("_by_overlap")), "shares")
    lapped = pagesets.overlap_groups(pagesets.joined(pages, share.where("_by_overlap").select("doc_id"), ("doc_id",), "left_semi"), max_pages, OVERLAP)
    kept = pagesets.joined(titled, share.where("NOT _by_overlap").select("doc_id"), ("doc_id",), "left_semi")
    return pagesets.joined(pages, kept.drop("title").unionByName(lapped))


def merge_weak_images(chunks: DataFrame) -> DataFrame:
    """Chunks that show images and say little join the chunk before them; at a document's start, the first that says more.

    Weak is a chunk with an image, of few characters, and of lines that are placeholders for images for the most part. What
    leads a document is judged together with all before it, so running counts of characters and lines tell where the lead
    ends; behind it a chunk is judged alone. A chunk of several is named by the one that the others join. A null text
    counts as empty; a document of one chunk stays as it is.
    """
    return _merged(chunks).drop("_n")


def _merged(chunks: DataFrame) -> DataFrame:
    """merge_weak_images, with _n, the place of each chunk in its document. Windows take counts along, not texts."""
    chunks = staged(chunks, "chunks")
    own = [c for c in chunks.columns if c != "doc_id"]
    place = Window.partitionBy("doc_id").orderBy("grp")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(X.lines(text), X.strip), lambda x: x != "")
    shown = F.filter(lines, lambda x: x.startswith("![") | F.contains(x, F.lit("intentionally omitted")))
    few = lambda image, chars, n, pictures: image & (chars < WEAK_IMAGE_CHARS) & ((n == 0) | (pictures / F.greatest(n, F.lit(1)) > 0.6))
    counted = chunks.select("doc_id", "grp", F.coalesce("has_image", F.lit(False)).alias("image"), F.length(text).alias("chars"), F.size(lines).alias("n"), F.size(shown).alias("pictures"))
    counted = staged(counted, "counts").withColumn("k", F.row_number().over(place))
    sofar = Window.partitionBy("doc_id").orderBy("k")
    together = [F.sum(c).over(sofar) for c in ("n", "pictures")]
    leading = few(F.first("image").over(sofar), F.sum("chars").over(sofar) + 2 * (F.col("k") - 1), *together)
    counted = counted.withColumns({"weak": few(*(F.col(c) for c in ("image", "chars", "n", "pictures"))), "leading": leading})
    whole = Window.partitionBy("doc_id")
    head = F.coalesce(F.min(F.when(~F.col("leading"), F.col("k"))).over(whole), F.max("k").over(whole))
    grouped = counted.withColumn("head", head).withColumn("group", F.sum(((F.col("k") > F.col("head")) & ~F.col("weak")).cast("int")).over(sofar))
    grouped = pagesets.joined(chunks.select("doc_id", "grp", F.struct(*own).alias("c")), grouped.select("doc_id", "grp", "k", "head", "group", "image"), ("doc_id", "grp"))
    rows = grouped.groupBy("doc_id", "group").agg(
        F.min_by(F.struct(*[F.col(f"c.{c}").alias(c) for c in own if c not in ("text", "pages")]), F.when(F.col("k") == F.col("head"), 0).otherwise(F.col("k"))).alias("c"),
        F.array_sort(F.collect_list(F.struct("k", F.coalesce("c.text", F.lit("")).alias("text"), F.col("c.pages").alias("pages")))).alias("parts"),
        F.bool_or("image").alias("image"),
    )
    merged = {
        "text": F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n"),
        "pages": F.flatten(F.transform("parts", lambda x: x["pages"])),
        "has_image": F.col("image"),
    }
    out = [merged.get(c, F.col("doc_id") if c == "doc_id" else F.col(f"c.{c}")).alias(c) for c in chunks.columns]
    return rows.select(*out, (F.col("group") + 1).alias("_n"))


def chunk_type(topic: Column, text: Column, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    clean = X.strip(F.regexp_replace(F.lower(F.coalesce(topic, F.lit(""))), r"[*_`#~]", ""))
    return (
        F.when(F.length(text) < min_chars, "stub")
        .when((F.length(text) <= LONG_CHUNK_CHARS) & X.contains_any(clean, STRUCTURAL_TOPICS), "structural")
        .when(X.contains_any(clean, INSTRUCTIONAL_TOPICS), "instructional")
        .otherwise("conceptual")
    )


def numbered(chunks: DataFrame, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Adds chunk_type and chunk_id. grp tells the chunks of a document apart; the window takes no texts along."""
    slim = chunks.select("doc_id", "grp").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("grp")))
    return _named(pagesets.joined(chunks, slim, ("doc_id", "grp")), min_chars)


def _named(chunks: DataFrame, min_chars: int) -> DataFrame:
    kind = chunk_type(F.col("topic"), F.col("text"), min_chars)
    return chunks.withColumns({"chunk_type": kind, "chunk_id": F.format_string("chunk_%03d", "_n")}).drop("_n")


def chunk_pages(pages: DataFrame, strategy: str = "auto", max_pages: int = MAX_PAGES, min_chars: int = MIN_CHUNK_CHARS, fixed_size: int = 3) -> DataFrame:
    """All steps: near-duplicate pages, grouping by strategy, weak images, types and ids."""
    pages = dedup_pages(pages)
    if strategy == "whole_doc":
        chunks = whole_doc_chunks(pages)
    else:
        make = {
            "auto": lambda: auto_groups(pages, max_pages),
            "title": lambda: groups_by_title(pages, max_pages),
            "overlap": lambda: groups_by_overlap(pages, max_pages),
            "fixed": lambda: groups_fixed(pages, fixed_size, max_pages),
        }
        if strategy not in make:
            raise ValueError(f"unknown strategy {strategy!r}")
        chunks = build_chunks(make[strategy]())
    return _named(_merged(chunks), min_chars)


def packed(rows: DataFrame, text_col: str, max_chars: int, separator: str = r"\n{2,}", glue: str = "\n\n") -> DataFrame:
    """Split long texts into parts of whole paragraphs: a part closes when the next paragraph would take it past max_chars.

    Separators are not counted; a paragraph that is longer alone is a part. Adds (part, part_text).
    """
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens = (F.size(acc["out"]) == 0) | (acc["n"] + F.length(p) > max_chars)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        longer = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, F.array(p))))
        return F.struct(F.when(opens, F.length(p)).otherwise(acc["n"] + F.length(p)).alias("n"), F.when(opens, F.concat(acc["out"], F.array(F.array(p)))).otherwise(longer).alias("out"))

    parts = F.transform(F.aggregate(F.split(F.col(text_col), separator), start, step)["out"], lambda a: F.array_join(a, glue))
    parts = F.when(F.length(text_col) <= max_chars, F.array(F.col(text_col))).otherwise(parts)
    return rows.select("*", F.posexplode(parts).alias("part", "part_text"))


_SLIDE = r"(?i)<!--\s*Slide number:\s*\d+\s*-->"


def sections(files: DataFrame, text_col: str = "markdown", max_chars: int = 6000) -> DataFrame:
    """Rows (section, title, body) of each file: by slide marks, else headings of level one and two, else paragraphs."""
    body = F.col(text_col)
    slides = F.transform(F.slice(F.split(body, _SLIDE), 2, F.size(F.split(body, _SLIDE))), X.strip)
    head = rf"(?dm)^#{{1,3}}{SPACE}+(.+)$"
    after = lambda s: X.strip(F.regexp_extract(s, rf"(?dms)^#{{1,3}}{SPACE}+[^\n]+$(.*)\z", 1))
    first = lambda s: F.get(F.filter(F.transform(X.lines(s), X.strip), lambda x: (x != "") & ~x.startswith("![")), F.lit(0))
    by_slide = F.transform(
        slides,
        lambda s, i: F.when(s.rlike(head), F.struct(X.clean_title(F.regexp_extract(s, head, 1)).alias("title"), after(s).alias("body"))).otherwise(
            F.struct(F.coalesce(X.clean_title(first(s)), F.concat(F.lit("Slide "), (i + 1).cast("string"))).alias("title"), s.alias("body"))
        ),
    )
    mark = rf"(?dm)^#{{1,2}}{SPACE}+(.+)$"
    by_head = F.transform(
        F.arrays_zip(F.regexp_extract_all(body, F.lit(mark), 1).alias("name"), F.transform(F.slice(F.split(body, mark), 2, F.size(F.split(body, mark))), X.strip).alias("rest")),
        lambda z, i: F.struct(
            F.when(X.strip(z["name"]).startswith("!["), F.coalesce(X.clean_title(first(z["rest"])), F.concat(F.lit("Section "), (i + 1).cast("string")))).otherwise(X.clean_title(z["name"])).alias("title"),
            z["rest"].alias("body"),
        ),
    )
    whole = F.array(F.struct(F.lit("Document").alias("title"), body.alias("body")))
    marked = files.withColumn("_s", F.when(body.rlike(_SLIDE), by_slide).when(body.rlike(mark), by_head).when(F.length(body) <= max_chars, whole))
    told = marked.where(F.col("_s").isNotNull()).select(*files.columns, F.posexplode("_s").alias("section", "_x")).select(*files.columns, "section", "_x.title", "_x.body")
    long = packed(marked.where(F.col("_s").isNull()).drop("_s"), text_col, max_chars)
    return told.unionByName(long.select(*files.columns, F.col("part").alias("section"), X.first_meaningful_line("part_text").alias("title"), F.col("part_text").alias("body")))
