"""Line dedup: remove lines that many sites share.

Method: lines are named by a hash, and the sites of each hash are gathered as HyperLogLog sketches that merge by
aggregation. A line whose estimate is clearly at or above the threshold is boilerplate, one clearly below is not; only
lines within a band around the threshold get exact distinct counts. DataFrame functions only.

Scale: what is shuffled for the decision is a hash and a sketch for each different line of each task, and partial
sketches meet before the shuffle, so a line on a third of all rows is no load. Texts are shuffled once, to meet the
hashes of their own boilerplate lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import hidden, read, with_key, written

#: White space at the ends of a line does not tell lines apart.
_TRIM = " \t\r\x0b\x0c"
#: Rows with at most so many different boilerplate lines hold them beside the text; of others each line meets its own.
FEW = 64


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(_TRIM)))


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(_TRIM)) != ""


def boilerplate_lines(lines: DataFrame, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """Of lines (h, site): the hashes h that at least min_sites sites have, null counting as one site."""
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, lg_k)).alias("about"))
    spread = written(spread.where(F.col("about") >= min_sites * (1 - band)), "spread")
    near = spread.where(F.col("about") < min_sites * (1 + band)).select("h")
    exact = (
        lines.join(near, "h", "left_semi").select("h", site.alias("site")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    )
    return spread.where(F.col("about") >= min_sites * (1 + band)).select("h").unionByName(
        exact.where(F.col("n") >= min_sites).select("h")
    )


def remove_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 8,
    band: float = 0.25,
    lg_k: int = 12,
) -> DataFrame:
    """Each row of docs with (n_lines, n_removed, clean_text) beside its columns.

    A line is boilerplate if at least min_sites different sites have it, apart from white space at its ends; every
    occurrence goes. n_lines counts the lines with a word, n_removed those that went; clean_text is what stays, joined
    by newlines (blank lines stay). A null text has no lines and stays null; an empty one stays empty. A null site is a
    site. No id is needed: rows are told apart by their place, so that null, repeated or missing ids and whole repeated
    rows do not matter. An empty table gives an empty result. Further columns stay; one named like a result gets an
    underscore. At 2**lg_k registers the error of an estimate is about 1.04 / 2**(lg_k / 2), so a band of a quarter lies
    beyond ten standard errors.
    """
    rows, name, back = hidden(docs, ("n_lines", "n_removed", "clean_text"))
    rows, text = with_key(rows, "key"), F.col(name[text_col])
    lines = written(
        rows.select("key", F.col(name[site_col]).cast("string").alias("site"), F.explode(F.split(text, "\n")).alias("line"))
        .where(_has_word(F.col("line")))
        .select("key", "site", _line_key(F.col("line")).alias("h")),
        "lines",
    )
    found = written(boilerplate_lines(lines.select("h", "site"), min_sites, band, lg_k), "boilerplate")
    marked, many = lines.select("key", "h").join(found, "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("gone")), Observation()
    marked = written(marked.observe(many, F.count(F.when(F.size("gone") > FEW, 1)).alias("n")), "marked")
    split = F.split(text, "\n")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<bigint>"))
    # texts move once, at any size, and meet both tables there
    joined = rows.join(marked.hint("merge"), "key", "left")
    kept = F.filter(split, lambda x: ~F.array_contains(gone, _line_key(x)) | ~_has_word(x))
    if many.get["n"]:
        # of rows with many such lines each line is looked up by itself, so that the work follows the number of lines
        crowded = marked.where(F.size("gone") > FEW)
        keys = written(crowded.select("key"), "crowded")
        each = rows.join(keys, "key").select("key", F.posexplode(split).alias("at", "line"))
        each = each.withColumn("h", F.when(_has_word(F.col("line")), _line_key(F.col("line")))).join(crowded.select("key", F.explode("gone").alias("h")), ["key", "h"], "left_anti")
        left = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("left"))
        joined = joined.join(left.hint("merge"), "key", "left")
        kept = F.when(F.size(gone) > FEW, F.coalesce(F.col("left.line"), F.array().cast("array<string>"))).otherwise(kept)
    kept = joined.withColumn("kept", kept)
    n_lines = F.coalesce(F.size(F.filter(split, _has_word)), F.lit(0)).cast("long")
    return kept.select(
        *back,
        F.when(text.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(text.isNull(), 0).otherwise(F.size(split) - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("clean_text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    clean = remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.md5("clean_text").alias("clean_md5"))


SQL = r"""
WITH l AS (
  SELECT trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line, coalesce('=' || source, '') AS site
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
), f AS (
  SELECT coalesce(list(line), []) AS gone FROM (
    SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8)
), s AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls,
    list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) AS ts
  FROM documents
), k AS (
  SELECT doc_id, ls, ts, list_filter(ls, lambda x, i: NOT list_contains(gone, ts[i])) AS kept FROM s, f
)
SELECT doc_id, CAST(coalesce(len(list_filter(ts, lambda x: x <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed,
  CASE WHEN ls IS NULL THEN NULL ELSE md5(coalesce(array_to_string(kept, chr(10)), '')) END AS clean_md5
FROM k
"""
