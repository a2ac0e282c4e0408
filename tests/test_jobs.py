"""Whole jobs with stand-in models."""

import json
import re

import pytest
from lectern.operators import generation, graph
from lectern.plans import jobs

PAGE = "doc_id string, page_num int, title string, text string, has_image boolean"


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for d in ("d1", "d2"):
        for p in range(1, 9):
            topic = ("Gates", "Cells", "Training", "Lab work")[(p - 1) // 2]
            rows.append((d, p * 2, topic, f"{topic} on page {p}. " + f"The {topic.lower()} unit number {p} keeps the state of the network for many steps in time. " * 6, False))
    return spark.createDataFrame(rows, PAGE)


def outliner(prompt, json_mode):
    kids = [{"concept_id": f"c1.{k}", "name": n, "last_page": 2 * k} for k, n in enumerate(("Gates", "Cells"), 1)]
    tree = [{"concept_id": "c1", "name": "Memory", "children": kids}, {"concept_id": "c2", "name": "Training", "last_page": 6}, {"concept_id": "c3", "name": "Lab work", "last_page": 8}]
    return "```json\n" + json.dumps({"main_concept": "Nets", "concept_hierarchy": tree, "relationships": [{"from_concept": "Training", "to_concept": "Gates", "relation": "APPLIES_TO", "evidence": "e"}]}) + "\n```"


def extractor(prompt, json_mode):
    topic = re.search(r"Topic: (.*)", prompt)[1]
    sentence = re.search(r"The .*? in time\.", prompt)[0]
    unit = lambda kind, name: {"type": kind, "concept": name, "content": f"{name} {kind}", "verbatim_evidence": sentence, "prominence": "primary", "completeness": "complete", "source_pages": [1]}
    return json.dumps([unit("definition", topic), unit("mechanism", topic), unit("procedure", f"use of {topic}")])


def asker(prompt, json_mode):
    return json.dumps({"question": "What holds of " + prompt[-20:].strip() + "?", "options": dict(zip("ABCD", ("one", "two", "three", "four"), strict=True)), "answer": "B", "explanation": "B fits"})


def test_knowledge_job(spark, pages):
    out = jobs.knowledge_job(pages, outliner, extractor, asker, "hard")
    seg = {(r.doc_id, r.segment_id): r for r in out["segments"].collect()}
    assert [seg["d1", f"seg_00{k}"].label for k in (1, 2, 3, 4)] == ["Gates", "Cells", "Training", "Lab work"]
    assert list(seg["d1", "seg_002"].source_pages) == [6, 8] and seg["d1", "seg_004"].skip
    units = out["units"].where("doc_id = 'd1'").collect()
    assert {u.owner_concept for u in units} == {"Gates", "Cells", "Training"} and len(units) == 9
    kinds = {r.relation for r in out["edges"].collect()}
    assert kinds == {"APPLIES_TO", "SIBLING_OF"}
    q = out["questions"].collect()
    assert sum(r.is_cross for r in q) >= 2 and {r.answer for r in q} == {"A", "B", "C", "D"}
    assert all(r.priority <= 2 for r in jobs.knowledge_job(pages, outliner, extractor, asker, "easy")["questions"].collect())


def flat(prompt, json_mode):
    return json.dumps({"questions": [{"question": "What does this page say at all?", "A": "a", "B": "b", "C": "c", "D": "d", "answer": "A", "explanation": "e", "bloom_level": "apply", "difficulty": "medium"}]})


def test_chunk_job(spark, pages):
    out = jobs.chunk_job(pages, flat, ("apply", "analyze"), "medium", strategy="title")
    n = out["chunks"].where("chunk_type = 'conceptual'").count()
    assert out["calls"].count() == 2 * n
    s = {r.doc_id: r for r in out["stats"].collect()}
    assert s["d1"].valid == 1 and s["d1"].total_raw == n  # one a document stays, the rest are duplicates
    done = out["calls"].where("bloom_level = 'apply'").select("item_key")
    assert jobs.chunk_job(pages, flat, ("apply", "analyze"), "medium", done, "title")["calls"].count() == n


def test_chunk_job_resumes_by_its_log(spark, pages, tmp_path):
    """A run that fails for some items leaves the others in the log; the next asks for what is missing alone."""
    log, levels = str(tmp_path / "log"), ("apply", "analyze")

    def failing(prompt, json_mode):
        if "level analyze" in prompt:
            raise RuntimeError("no answer")
        return flat(prompt, json_mode)

    first = jobs.chunk_job(pages, failing, levels, "medium", strategy="title", log=log)
    n = first["chunks"].where("chunk_type = 'conceptual'").count()
    assert first["progress"].collect() == [(n, n, n)]
    late = jobs.chunk_job(pages, lambda p, j: json.dumps({"skip": True}) if "level analyze" in p else 1 / 0, levels, "medium", strategy="title", log=log)
    assert late["progress"].collect() == [(2 * n, n, n)] and late["calls"].where("status = 'success'").count() == 2 * n
    assert late["calls"].where("n_mcqs = 0").count() == n
    again = jobs.chunk_job(pages, lambda p, j: 1 / 0, levels, "medium", strategy="title", log=log)
    assert again["progress"].collect() == [(2 * n, n, n)]
    s = {r.doc_id: r for r in again["stats"].collect()}
    assert s["d1"].valid == 1


def test_whole_documents_are_asked_for_more(spark, pages):
    out = jobs.chunk_job(pages, flat, ("apply",), "medium", strategy="whole_doc")
    assert out["calls"].count() > 0 and out["calls"].where("n_questions < 2 OR NOT contains(prompt, concat(n_questions, ' different'))").count() == 0


def test_providers():
    now = [0.0]

    def limited(prompt, json_mode):
        raise RuntimeError("HTTP 429")

    p = generation.Providers([("a", limited), ("b", lambda prompt, json_mode, temperature: f"b{temperature}")], clock=lambda: now[0])
    assert p("x", True) == "b0.2" and p.until == {"a": 60.0}
    q = generation.Providers([("a", limited)], clock=lambda: now[0])
    with pytest.raises(RuntimeError, match="429"):
        q("x", True)
    with pytest.raises(RuntimeError, match="cooling"):
        q("x", True)


def test_nodes(spark):
    tree = [{"l1_ord": 1, "name": "Memory", "names": ["LSTM", "Simple Recurrent Nets (Elman nets)"]}]
    segs = [{"segment_id": "seg_001", "label": "LSTM", "concepts": ["LSTM"], "parent_concept_name": "Memory"}, {"segment_id": "seg_002", "label": "x", "concepts": [], "parent_concept_name": "Memory"}]
    n = graph.Nodes(tree, segs)
    unit = lambda k, c, o: {"ku_id": k, "concept": c, "owner_concept": o}
    assert n.of_unit(unit("seg_001a_ku_01", "cell", "")) == "LSTM"
    assert n.of_unit(unit("seg_009_ku_01", "recurrent nets", "simple recurrent net")) == "Simple Recurrent Nets (Elman nets)"
    assert n.of_unit(unit("seg_002_ku_01", "zzz", "")) == "Memory" and n.of_unit(unit("q_ku_1", "zzz", "")) is None
    assert n.of_end("whatever", "seg_001") == "LSTM" and n.of_end("Memory", None) == "Memory" and n.of_end("whatever", None) is None
    df = spark.createDataFrame([("d", 1, "Memory", ["LSTM", "GRU"])], "doc_id string, l1_ord int, name string, names array<string>")
    none = spark.createDataFrame([], "doc_id string, segment_id string, label string, concepts array<string>, parent_concept_name string")
    units = spark.createDataFrame([("d", "s_ku_1", "lstms", "")], "doc_id string, ku_id string, concept string, owner_concept string")
    rels = spark.createDataFrame([("d", 1, "LSTMs", "GRU", "CONTRASTS_WITH"), ("d", 2, "Memory", "nothing", "EXTENDS")], "doc_id string, rel_ord int, from_concept string, to_concept string, relation string")
    own, ends = graph.display_nodes(units, rels, df, none)
    assert [tuple(r) for r in own.collect()] == [("d", "s_ku_1", "LSTM")]
    assert [tuple(r) for r in ends.collect()] == [("d", 1, "LSTM", "GRU", "CONTRASTS_WITH")]
    edges = graph.display_edges(df.selectExpr("doc_id", "name AS l1", "explode(names) AS name"), ends).collect()
    assert sorted((r.source, r.target, r.relation) for r in edges) == [("LSTM", "GRU", "CONTRASTS_WITH"), ("Memory", "GRU", "CONTAINS"), ("Memory", "LSTM", "CONTAINS")]
    shown = graph.visible_relations(spark.createDataFrame([("d", "a", "b", "EXTENDS"), ("d", "a", "c", "SIBLING_OF"), ("d", "b", "c", None)], "doc_id string, a string, b string, relation string"))
    assert shown.count() == 4 and shown.where("relation = 'RELATED_TO'").count() == 2
