"""Whole jobs: pages to an outline, units, a graph and questions; and chunks to judged questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, concept_graph, generation, knowledge, questions, segments
from lectern.sources.tables import staged

_CHILD = "struct<concept_id:string,name:string,last_page:int>"
_OUTLINE = (
    f"struct<main_concept:string,concept_hierarchy:array<struct<concept_id:string,name:string,evidence:string,last_page:int,children:array<{_CHILD}>>>,"
    "relationships:array<struct<from_concept:string,to_concept:string,relation:string,evidence:string>>>"
)


def outline(pages: DataFrame, model: Callable) -> tuple[DataFrame, DataFrame]:
    """One call for each document: its concept hierarchy, and relations between concepts. Replies that are no outline give none."""
    seen = segments.with_sequence(pages.where(X.strip("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("[Page "), F.col("seq").cast("string"), F.lit("]\n"), X.strip("text")).alias("t"))))
    docs = seen.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), segments.RULE).alias("text"))
    prompt = F.concat(F.lit("Outline the document as JSON with main_concept, concept_hierarchy and relationships; last_page counts pages from 1.\n"), X.prompt_text("text"))
    told = generation.called(docs.select("doc_id", prompt.alias("prompt")), model, json_mode=False, temperature=0.1).where("status = 'success'")
    told = told.select("doc_id", F.from_json(knowledge.unfenced("raw"), _OUTLINE).alias("o"))
    tree = told.select("doc_id", F.posexplode("o.concept_hierarchy").alias("pos", "c")).select(
        "doc_id", (F.col("pos") + 1).alias("l1_ord"), "c.concept_id", "c.name", "c.last_page", F.coalesce("c.children", F.array().cast(f"array<{_CHILD}>")).alias("children")
    )
    rels = told.select("doc_id", F.posexplode("o.relationships").alias("pos", "r")).select("doc_id", (F.col("pos") + 1).alias("rel_ord"), "r.from_concept", "r.to_concept", "r.relation", "r.evidence")
    return tree, rels


def knowledge_job(pages: DataFrame, outline_model: Callable, unit_model: Callable, question_model: Callable, difficulty: str = "medium") -> dict[str, DataFrame]:
    """segments, relations, units, edges and questions of each document.

    Each step is a table: model calls are made once, and plans do not grow from step to step.
    """
    tree, rels = outline(pages, outline_model)
    tree, rels = staged(tree, "outline"), staged(rels, "told")
    cut = staged(segments.merged_small(segments.built(segments.flattened(tree, pages), pages, absorb_trailing=False), tree), "segments")
    rels = staged(segments.remapped_relations(cut, tree, rels), "relations")
    parts = staged(segments.with_connections(segments.with_context(segments.split_long(cut)), rels), "parts")
    told = staged(generation.extracted_units(segments.to_chunks(parts.where("NOT skip")), unit_model), "told")
    units = staged(knowledge.dedup_units(_in_order(told)).where("prominence <> 'peripheral'"), "units")
    names = tree.where("size(children) > 0").select("doc_id", "l1_ord", F.transform("children", lambda c: c["name"]).alias("names"))
    edges = staged(concept_graph.concept_edges(units, rels, names, parts.select("doc_id", "segment_id", "label", "concepts")), "edges")
    out = staged(generation.single_questions(units, edges, question_model), "single")
    if difficulty in ("medium", "hard"):
        more = generation.cross_questions(units, edges, question_model, horizontal_only=difficulty != "hard", total=6 if difficulty == "medium" else 8)
        out = out.unionByName(staged(more, "cross"))
    kept = out.where(questions.difficulty_gate("priority", difficulty)).withColumn("is_cross", F.col("anchor_ku_id_b") != "")
    return {"segments": parts, "relations": rels, "units": units, "edges": edges, "questions": kept}


def _in_order(units: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return units.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(X.by_number("chunk_id"), "ord")))


def chunk_job(pages: DataFrame, model: Callable, levels: tuple[str, ...], difficulty: str, done: DataFrame | None = None, strategy: str = "auto", log: str | None = None) -> dict[str, DataFrame]:
    """Chunks to flat questions: work list without what is done, budgets, calls, parsed rows, validation; judge with generation.judge_calls.

    log: a path to which calls are appended as they are made; a later run asks for what it lacks, and calls, questions and
    progress (items, chunks, mcqs) cover the whole log. Without one, progress covers this run's calls.
    """
    chunks = staged(chunking.chunk_pages(pages, strategy), "chunks")
    items = generation.with_budget(generation.work_list(chunks, levels), len(levels))
    items = items if done is None else generation.remaining(items, done)
    items = items.withColumn("prompt", generation.flat_prompt(difficulty))
    if log is None:
        asked = staged(generation.with_counts(generation.called(items, model)), "calls")
    else:
        asked = generation.called_in_parts(items, model, log)
    flat = generation.parsed_flat_questions(asked.where("status = 'success'").select("doc_id", F.col("chunk_id").alias("source_chunk"), "level_ord", "raw"))
    order = F.row_number().over(_by_place())
    checked = questions.validated(flat.withColumn("ord", order).drop("raw"))
    progress = generation.checkpoint_summary(asked.where("status <> 'error'"))
    return {"chunks": chunks, "calls": asked, "questions": checked, "stats": questions.validation_stats(checked), "progress": progress}


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(X.by_number("source_chunk"), "level_ord", "pos")
