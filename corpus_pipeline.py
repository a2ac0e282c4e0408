"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, mixing and sharding.

Every stage takes any columns beside those of documents, whatever their names, and returns them. Nulls in any column,
empty and very long texts, repeated rows and ids, and empty tables have a defined result, which each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from lectern.llm.common import WORD, free, hidden, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words; repeated rows share one fate."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id, rows without one last.

    Rows are compared by their texts, so ids may repeat, with equal or other texts, or be null; of rows with one id and one
    class the first by place stays. Texts without words are like no other; of those only rows that are repeated whole, with
    their doc_id, go.
    """
    rows, name, back = hidden(docs)
    doc_id, text = F.col(name["doc_id"]), F.coalesce(F.col(name["text"]), F.lit(""))
    whole = F.when(doc_id.isNotNull() & ~text.rlike(WORD), F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    # the key of a row is written, so that all readings agree on it
    keyed = written(rows.select("*", F.monotonically_increasing_id().alias("key"), whole.alias("whole")), "keyed")
    classes = jaccard_join.similar_documents(keyed, id_col="key", text_col=name["text"]).select(F.col("id").alias("key"), "class_id")
    met = keyed.select(doc_id.alias("doc_id"), "key", "whole").join(classes, "key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key")
    kept = met.groupBy(F.coalesce("whole", F.col("class_id").cast("string"))).agg(first.alias("key")).select("key")
    return keyed.join(kept, "key", "left_semi").select(*back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows share one fate."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of each source cut where its target is reached; n_chars follows.

    Sources and ids may be null. Texts without words count for nothing and stay once; rows that are equal in source, id and
    text are cut alike.
    """
    names = tuple(free(c, docs) for c in mixing.RESULTS)
    taken = mixing.repeated(mixing.mix(docs, results=names), results=names)
    return taken.select(*docs.columns).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards and slots; equal texts, null ones too, share a shard, and every row has a slot of its own.

    A column that is named like one of sharding.RESULTS gets an underscore.
    """
    return sharding.shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Alignment, components and schedules have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
