"""Mixing sources to target weights.

Method: capped water-filling. Every source's share of the budget is proportional to its weight, clamped at max_epochs
times its own size; what the clamp frees goes to the other sources by weight, again and again, until none is above. A
source then takes its documents whole as often as the target holds the source, and the rest as a seeded sample: documents
in the order of a hash of their id, each whole, up to the remaining number of words, the last one by the words that are
left. DataFrame functions only.

Scale: sizes shrink to totals by (source, bucket of the hash) before anything is ordered. They tell in which bucket a
source's sample ends, and only that bucket, a 4096th of the source, is put in order; what comes out is one cut for each
source, a place in the order of hashes. Documents meet the cut of their source by a join in which large sources are
broadcast, so that texts of large sources never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import hidden, join_hot, n_words, ranked, read, written

BUCKETS = 4096
RESULTS = ("size", "source_size", "target", "taken")


def water_fill(sources: DataFrame, budget: float, max_epochs: float, max_rounds: int = 10_000) -> tuple[float, DataFrame]:
    """sources (weight, size): the words for each unit of weight, and sources with `target`, none above max_epochs * size.

    Each round shares what the capped sources leave among the others and caps those that reach their cap; the level only
    rises, and it ends when no further source is capped. Targets sum to budget * the sum of sizes, if the caps allow it.
    """
    caps = sources.withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    total, weight = caps.agg(F.sum("size"), F.sum("weight")).first()
    n_capped, level = 0, 0.0
    if total:
        total = total * float(budget)
        level = total / weight
        for _ in range(max_rounds):
            over = F.col("cap") <= F.col("weight") * F.lit(level)
            n, held, weight = caps.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
            if n == n_capped:
                break
            n_capped = n
            level = (total - held) / weight if weight else float("inf")
        else:
            raise RuntimeError(f"water_fill: no end after {max_rounds} rounds")
    return level, caps.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def _place(rows: DataFrame, id_col: str, text_col: str | None, source_col: str, size: Column, seed: int) -> DataFrame:
    """Adds sk, the source; size; b and h: the place in the order of a source, by a hash of the id, or of the text where there is no id."""
    of_id = F.concat(F.lit(":"), F.col(id_col).cast("string"))
    of_text = F.concat(F.lit("::"), F.md5(F.coalesce(F.col(text_col), F.lit("")))) if text_col else F.lit("::")
    h = F.md5(F.concat(F.lit(str(seed)), F.coalesce(of_id, of_text)))
    return rows.withColumns(
        {
            "sk": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
            "size": size,
            "b": F.conv(F.substring(h, 1, 3), 16, 10).cast("int") % BUCKETS,
            "h": h,
        }
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str | None = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 11,
    size_col: str | None = None,
    results: tuple[str, str, str, str] = RESULTS,
) -> DataFrame:
    """Each row of docs with (size, source_size, target, taken) beside its columns; `results` names these four.

    Sources in code point order, null last, have the weights in turn. size: words of the text (null: 0), or what size_col
    says. taken: how many of the document's words the mix has, repeats counted: a multiple of size, but for one document of
    each source that is cut where the target is reached. A source's taken words sum to its target rounded down. Rows
    without an id are ordered by their texts. Rows with one place in the order (equal source, id and size; without an id,
    equal texts) get equal shares, so that a source in which they are cut stays short by fewer words than there are such
    rows. Reruns agree, whatever the order of the rows. Null or repeated ids, null texts and sources are allowed; an empty
    table gives an empty result. Further columns stay as they are; one named like a result gets an underscore.
    """
    rows, name, back = hidden(docs, results)
    size = F.coalesce(F.col(name[size_col]).cast("long"), F.lit(0)) if size_col else n_words(name[text_col])
    placed = _place(rows, name[id_col], name[text_col] if text_col else None, name[source_col], size, seed)
    seen = Observation()
    slim = written(placed.select("sk", "b", "h", "size").observe(seen, F.count(F.lit(1)).alias("n")), "sizes")
    totals = written(slim.groupBy("sk", "b").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "buckets")
    sources = totals.groupBy("sk").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).withColumn("none", (F.col("sk") == "").cast("int"))
    turn = (F.col("turn") % len(weights) + 1).cast("int")
    weighted = ranked(sources, ["none", "sk"], "turn").withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn))
    weighted = written(weighted.select("sk", "size", "n", "weight"), "sources")
    _, filled = water_fill(weighted, budget, max_epochs)
    filled = filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    filled = written(filled.withColumn("rest", (F.floor("target") - F.col("whole") * F.col("size")).cast("long")), "targets")

    # the bucket in which the sample of a source ends, and in it the place
    earlier = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("sk", "b", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    last = before.join(filled.select("sk", "rest"), "sk").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    ties = slim.join(last.select("sk", "b", "before", "rest"), ["sk", "b"]).groupBy("sk", "b", "h", "size", "before", "rest").agg(F.count(F.lit(1)).alias("m"))
    ties = ties.where("size > 0")
    inner = Window.partitionBy("sk").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inner), F.lit(0))
    cut = ties.withColumn("at", at).where((F.col("at") < F.col("rest")) & (F.col("at") + F.col("size") * F.col("m") >= F.col("rest")))
    cut = cut.select("sk", F.col("b").alias("cut_b"), F.col("h").alias("cut_h"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("at")) / F.col("m")).alias("cut_words"))
    goals = written(filled.withColumnRenamed("size", "source_size").join(cut, "sk", "left"), "goals")

    met = join_hot(placed, goals, "sk", "n", seen.get["n"])
    place, end = F.struct("b", "h", "size"), F.struct(F.col("cut_b").alias("b"), F.col("cut_h").alias("h"), F.col("cut_size").alias("size"))
    part = F.when(F.col("cut_h").isNull(), 0).when(place < end, F.col("size")).when(place == end, F.col("cut_words")).otherwise(0)
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    return met.select(*back, *[c.alias(r) for c, r in zip((F.col("size"), F.col("source_size"), F.col("target"), taken), results, strict=True)])


def repeated(mixed: DataFrame, text_col: str = "text", results: tuple[str, str, str, str] = RESULTS) -> DataFrame:
    """What mix() took, as rows: a document whole as often as taken holds its size, then its first words if words are left.

    Documents without words (null and empty texts too) are of no account to the mix; each stays once. Repeated rows are
    repeated each. All columns stay.
    """
    rows, name, back = hidden(mixed)
    text, size, taken = (F.col(name[c]) for c in (text_col, results[0], results[3]))
    whole = F.when(size > 0, F.floor(taken / F.greatest(size, F.lit(1)))).otherwise(1).cast("int")
    left = F.when(size > 0, taken % F.greatest(size, F.lit(1))).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), whole),
        F.when(left > 0, F.array(left.cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    words = F.filter(F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), " ")
    out = rows.withColumn("words", F.explode(copies))
    return out.withColumn(name[text_col], F.when(F.col("words") > 0, cut).otherwise(text)).select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    # texts are read once: what is written are ids, sources and sizes, and a hash where there is no id
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("n"), F.when(F.col("doc_id").isNull(), F.md5("text")).alias("t"))
    mixed = mix(written(docs, "documents"), text_col="t", size_col="n")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS sk, md5('11' || coalesce(':' || CAST(doc_id AS VARCHAR), '::' || md5(coalesce(md5(text), '')))) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY sk = '', sk) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY sk
), c AS (
  SELECT sk, n, w, n * CAST(2 AS DOUBLE) AS cap, CAST(n AS DOUBLE) / w AS r, (SELECT CAST(sum(n) AS BIGINT) * CAST(1.5 AS DOUBLE) FROM s) AS t FROM s
), v AS (
  SELECT *, (t - coalesce(sum(cap) OVER (ORDER BY r, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (ORDER BY r, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv,
    row_number() OVER (ORDER BY r, sk) AS rk FROM c
), g AS (
  SELECT sk, n, least(cap, coalesce(w * (SELECT min_by(lv, rk) FROM v WHERE cap > w * lv), cap)) AS target FROM v
), q AS (
  SELECT sk, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM g
), p AS (
  SELECT doc_id, size, n, target, whole, CAST(floor(target) AS BIGINT) - whole * n AS rest,
    coalesce(sum(size) OVER (PARTITION BY sk ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM d JOIN q USING (sk)
)
SELECT doc_id, size, n AS source_size, target,
  CAST(whole * size + greatest(0, least(size, rest - gone)) AS BIGINT) AS taken
FROM p
"""
