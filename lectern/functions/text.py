"""Text kernel: scalar rules over texts, titles, concepts and lines, as Column expressions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import EXPLANATION_WORDS, LINE_ENDS, SPACE, SPACES

# Patterns of images, captions, formulas and tables.
IMAGE = r"!\[[^\n]*?\]\([^\n]*?\)"
CAPTION = r"(?i)^\s*(figure|fig\.|table|hinh|hinh\s+\d+|bang|bang\s+\d+|bảng|hình)(?![\p{L}\p{N}_])"
FORMULA = r"(?s)(\$\$.*?\$\$|\$[^$\n]{2,}\$|\\\(.+?\\\)|\\\[.+?\\\]|[A-Za-z]\s*=\s*[^,\n]{2,})"
MARKDOWN_TABLE = r"(?m)^\s*\|.+\|\s*$\n^\s*\|[\s:\-|]+\|\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_number(c: str | Column) -> Column:
    """An order of ids such as chunk_999, chunk_1000 or seg_012b by the number in them, then as text."""
    return F.struct(F.regexp_extract(col(c), r"(\d+)", 1).try_cast("long"), col(c))


def strip(c: str | Column) -> Column:
    return F.trim(col(c), F.lit(SPACES))


def words(c: str | Column) -> Column:
    """Runs without (Unicode) white space, in order."""
    return F.array_remove(F.split(F.translate(col(c), SPACES, " " * len(SPACES)), " "), "")


def word_set(c: str | Column) -> Column:
    return F.array_distinct(words(F.lower(col(c))))


def lines(c: str | Column) -> Column:
    return F.split(F.translate(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def collapse(c: str | Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.array_join(words(c), " ")


def exact_mean(c: str | Column) -> Column:
    """The mean of values of at most three decimals, summed exactly, so that it does not depend on the order of rows."""
    return F.avg(col(c).cast("decimal(18,3)")).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays of distinct values; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))).otherwise(0.0)


def strip_markdown(c: str | Column) -> Column:
    own = col(c)
    plain = F.when(F.contains(own, F.lit("![")), F.regexp_replace(own, IMAGE, "")).otherwise(own)
    return strip(F.translate(plain, "*_`#~", ""))


def own_lines(c: str | Column) -> Column:
    """Lines without white space at their ends."""
    return F.transform(lines(c), strip)


def title_of(c: str | Column, own: Column | None = None) -> Column:
    """The first heading of 4 to 199 characters, else the first line that is no list, table, image or heading; else null.

    own: own_lines(c), where they are at hand.
    """
    own = own_lines(c) if own is None else own
    heads = F.transform(F.filter(own, lambda x: x.startswith("#")), lambda x: strip(F.regexp_replace(x, "^#+", "")))
    heads = F.filter(heads, lambda x: ~x.startswith("![") & (F.length(x) > 3) & (F.length(x) < 200))
    plain = F.filter(own, lambda x: (F.length(x) > 3) & ~x.rlike(r"^(-|\*|\||!\[|#)"))
    return F.coalesce(F.get(heads, F.lit(0)), F.substring(F.get(plain, F.lit(0)), 1, 200))


def clean_title(c: str | Column) -> Column:
    flat = collapse(c)
    return F.substring(F.when(flat.startswith("!["), F.trim(F.regexp_replace(flat, IMAGE, ""))).otherwise(flat), 1, 80)


def first_meaningful_line(c: str | Column, own: Column | None = None) -> Column:
    own = F.filter(own_lines(c) if own is None else own, lambda x: (x != "") & ~x.rlike(r"^(!\[|-|\*|\||#)"))
    clean = F.filter(F.transform(own, lambda x: strip(F.regexp_replace(x, r"[*_`#]", ""))), lambda x: F.length(x) > 3)
    return F.coalesce(F.substring(F.get(clean, F.lit(0)), 1, 80), F.lit("Section"))


def normalize_title(c: str | Column) -> Column:
    t = strip(F.lower(F.regexp_replace(col(c), r"[*_`#~]", "")))
    return strip(F.regexp_replace(t, r"^(\d+[.)]\s*|chapter\s+\d+\s*[:\-]?\s*)", ""))


def normalize_concept(c: str | Column) -> Column:
    return F.regexp_replace(F.translate(strip(F.lower(col(c))), "-", " "), f"{SPACE}+", " ")


def normalize_name(c: str | Column) -> Column:
    """The variant that drops punctuation."""
    return collapse(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]+", " "))


def tokens(c: str | Column) -> Column:
    """Distinct word tokens; of those longer than three letters, trailing s are dropped."""
    found = F.regexp_extract_all(col(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.when(F.length(t) > 3, F.rtrim(t, F.lit("s"))).otherwise(t)))


def word_tokens(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def subset_either(a: Column, b: Column) -> Column:
    """Both non-empty and one within the other."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return both & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def garbled(w: Column) -> Column:
    """Of an array of words: at least 15, and more than a quarter of them single letters."""
    single = F.size(F.filter(w, lambda x: (F.length(x) == 1) & x.rlike(r"^\p{L}$")))
    return F.when(F.size(w) >= 15, single / F.greatest(F.size(w), F.lit(1)) > 0.25).otherwise(False)


def is_garbled(c: str | Column) -> Column:
    return garbled(words(c))


def page_quality(c: str | Column, w: Column | None = None) -> Column:
    """Label of a page: low_text, garbled, noisy or good. w: words(c), where they are at hand."""
    w = words(c) if w is None else w
    mean = F.length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1))
    return F.when(F.length(strip(c)) < 50, "low_text").when(garbled(w), "garbled").when((F.size(w) > 0) & (mean < 2), "noisy").otherwise("good")


def section_quality(c: str | Column) -> Column:
    return F.when(F.length(strip(c)) < 30, "low_text").when(F.size(words(c)) < 8, "sparse").otherwise("good")


def section_warnings(c: str | Column) -> Column:
    n = F.length(strip(c))
    both = F.array(F.when(n < 80, "short_section"), F.when(col(c).rlike(IMAGE) & (n < 200), "image_heavy_section"))
    return F.filter(both, lambda x: x.isNotNull())


def _table_line(x: Column) -> Column:
    cells = F.split(x, r"\s{2,}")
    short = F.size(F.filter(cells, lambda t: F.length(t) <= 18))
    pipes = F.length(x) - F.length(F.translate(x, "|", ""))
    # the plain pattern first: it does not go back over words
    return F.when(pipes >= 2, True).otherwise(x.rlike(r"\s\s") & x.rlike(r"\S+\s{2,}\S+\s{2,}\S+") & (F.size(cells) >= 3) & (short >= 2))


def looks_like_table(own: Column) -> Column:
    """Of an array of lines: at least two rows of cells."""
    return F.size(F.filter(F.transform(own, strip), _table_line)) >= 2


def looks_like_columns(own: Column) -> Column:
    return F.size(F.filter(own, lambda x: (F.length(x) >= 40) & x.rlike(r"[a-zA-Z0-9)]\s{6,}[A-Z0-9]"))) >= 3


def text_lines(c: str | Column) -> Column:
    """Lines with text, without white space at their right ends."""
    return F.filter(F.transform(lines(F.coalesce(col(c), F.lit(""))), lambda x: F.rtrim(x, F.lit(SPACES))), lambda x: x != "")


def layout_flags(c: str | Column, has_image: Column | None = None, own: Column | None = None) -> dict[str, Column]:
    """has_table, has_formula, has_caption, has_columns and layout_sensitive of a text. own: text_lines(c), where at hand."""
    image = F.lit(False) if has_image is None else F.coalesce(has_image, F.lit(False))
    text = F.coalesce(col(c), F.lit(""))
    own = text_lines(c) if own is None else own
    has = lambda k: F.contains(text, F.lit(k))
    # a search for a character spares most texts the pattern
    table = (has("|") & text.rlike(MARKDOWN_TABLE)) | looks_like_table(own)
    formula, columns = (has("=") | has("$") | has("\\")) & text.rlike(FORMULA), looks_like_columns(own)
    caption = F.exists(own, lambda x: strip_markdown(x).rlike(CAPTION))
    return {
        "has_table": table,
        "has_formula": formula,
        "has_caption": caption,
        "has_columns": columns,
        "layout_sensitive": table | formula | (caption & image) | columns,
    }


def merged_flag(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def contains_any(c: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.contains(c, F.lit(k))
    return out


def has_label(c: str | Column, keys: tuple[str, ...]) -> Column:
    """One of the keys occurs between characters that are no ASCII letter or digit."""
    import re

    return F.lower(col(c)).rlike("(^|[^a-z0-9])(" + "|".join(re.sub(r"([&.])", r"\\\1", k) for k in keys) + ")([^a-z0-9]|$)")


def grounded(evidence: str | Column, source_tokens: Column, least: float = 0.8) -> Column:
    """Every part of the evidence (split at `[...]`) has that share of its words in the source; empty evidence has none."""
    text = F.coalesce(strip(evidence), F.lit(""))
    parts = F.filter(F.transform(F.split(text, r"\[\.\.\.\]"), word_tokens), lambda p: F.size(p) > 0)
    good = F.forall(parts, lambda p: F.size(F.array_intersect(p, source_tokens)) / F.greatest(F.size(p), F.lit(1)) >= least)
    return F.when(text == "", False).otherwise(good)


def sanitize(c: str | Column, most: int) -> Column:
    """No control characters, one line, single blanks, at most so many characters."""
    plain = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.substring(collapse(plain), 1, most), f"{SPACE}+$", "")


def prompt_text(c: str | Column) -> Column:
    """For prompts: no comments, images as their captions, no headings up to level three, no runs of blank lines."""
    t = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "[Image: $1]")
    t = F.regexp_replace(t, r"(?m)^#{1,3}\s+.+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sanitize_explanation(c: str | Column) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    for old, new in EXPLANATION_WORDS:
        t = F.regexp_replace(t, f"(?iu){old}", new)
    return collapse(t)


def page_label(pages: Column) -> Column:
    """Page numbers as ranges: "Pages 1-3, 7"; empty for none."""
    own = F.array_sort(F.array_distinct(pages))
    runs = F.aggregate(
        own,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] == p - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), p.cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("a"), p.cast("int").alias("b"))))),
    )
    names = F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))))
    return F.when(F.size(own) == 0, "").otherwise(F.concat(F.when(F.size(own) == 1, "Page ").otherwise("Pages "), F.array_join(names, ", ")))
