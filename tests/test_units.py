"""Questions, knowledge units, graph, segments, generation, files and streams on small cases."""

import json
import random

import pytest
from lectern.operators import concept_graph, generation, graph, knowledge, questions, segments
from lectern.sources import files
from lectern.streaming import calls
from pyspark.sql import functions as F

from . import plain_graph

MCQ = "doc_id string, ord int, question string, A string, B string, C string, D string, answer string, explanation string, bloom_level string, difficulty string, source_chunk string"
GOOD = ("d", 1, "What does the gate decide?", "keep", "drop", "add", "skip", "a", "It keeps.", "Apply", "medium", "chunk_001")


def change(n, **k):
    names = [x.split()[0] for x in MCQ.split(", ")]
    return tuple(k.get(c, n if c == "ord" else v) for c, v in zip(names, GOOD, strict=True))


def test_validation(spark):
    rows = [
        (GOOD, None, None, 1.0),
        (change(2), "quality", "Duplicate question", 0.8),
        (change(3, question=" what DOES the  gate decide? "), "quality", "Duplicate question", 0.8),
        (change(4, B=None, answer=None), "schema", "Missing fields: ['B', 'answer']", None),
        (change(5, answer="e"), "schema", "Invalid answer: 'E' (must be A/B/C/D)", None),
        (change(6, bloom_level="guess"), "schema", "Invalid bloom_level: 'guess'", None),
        (change(7, difficulty="odd"), "schema", "Invalid difficulty: 'odd'", None),
        (change(8, question="Why?"), "quality", "Question too short (4 chars)", 1.0),
        (change(9, question="Another question here?", C=" "), "quality", "Option C is empty", 0.8),
        (change(10, question="Another question here?", C="DROP"), "quality", "Duplicate options", 0.8),
        (change(11, question="Another question here?", explanation=" "), "quality", "Explanation is empty", 0.8),
        (change(12, question="Hard and early?", difficulty="hard", bloom_level="remember"), "quality", "Bloom/Difficulty mismatch: difficulty=hard but bloom=remember", 0.8),
        (change(13, question="Hard and early?", difficulty="hard", bloom_level="create"), None, None, 1.0),
        (change(14, question="Hard and early?", difficulty="easy", bloom_level="create"), "quality", "Duplicate question", 0.6),
    ]
    got = {r.ord: r for r in questions.validated(spark.createDataFrame([r[0] for r in rows], MCQ)).collect()}
    for row, layer, reason, score in rows:
        r = got[row[1]]
        assert (r.layer, r.reason, r.quality_score) == (layer, reason, score), row
    stats = questions.validation_stats(questions.validated(spark.createDataFrame([r[0] for r in rows], MCQ))).first()
    assert (stats.total_raw, stats.valid, stats.pass_rate) == (14, 2, 14.3)


def test_export(spark):
    df = spark.createDataFrame([GOOD, change(2, answer="x"), change(3, D="\x00")], MCQ)
    assert [r.error for r in questions.prepared(df).orderBy("ord").collect()] == [None, "invalid answer: X", "missing option D"]
    assert questions.kahoot(questions.prepared(df).where("error is null")).first()["Correct Answer"] == 1
    with pytest.raises(Exception, match="cannot export"):
        questions.strict(questions.prepared(df)).collect()
    r = questions.forms_payload(questions.prepared(df).where("error is null")).first().request
    assert json.loads(r)["createItem"]["item"]["questionItem"]["question"]["grading"]["correctAnswers"]["answers"] == [{"value": "keep"}]


def test_quizizz_file(spark, tmp_path):
    questions.write_quizizz(questions.prepared(spark.createDataFrame([GOOD], MCQ)), str(tmp_path / "q"))
    texts = [p.read_text("utf-8") for p in (tmp_path / "q").glob("part-*")]
    assert all(t.startswith("\ufeff") for t in texts) and any("keep" in t for t in texts)


def test_rotation(spark):
    rows = [change(k, answer="C", explanation="C is right, A is not; Cat stays.") for k in range(1, 6)]
    got = questions.rotated(spark.createDataFrame(rows, MCQ)).orderBy("ord").collect()
    assert [r.answer for r in got] == ["A", "B", "C", "D", "A"]
    assert got[0].A == "add" and got[0].C == "keep" and got[0].explanation == "A is right, C is not; Cat stays."
    assert got[2].explanation == rows[0][8]


def reply(**k):
    unit = {"ku_id": "seg_1_ku_01", "type": "definition", "concept": "Gate", "content": "c", "verbatim_evidence": "the gate keeps the state", "related_kus": [], "prominence": "primary", "completeness": "complete", "source_pages": 5}
    return unit | k


def test_parse_units(spark):
    raws = [
        json.dumps([reply(), reply(ku_id="other", source_pages="3, 4", related_concepts="ReAct")]),
        "```json\n" + json.dumps({"knowledge_units": [reply(type="odd"), reply(related_kus=[{"target_concept": "T", "relation": "ENABLES", "evidence": "e"}], source_pages=[7])]}) + "\n```",
        json.dumps(reply(source_pages="none")), "garbage", "", json.dumps({"items": [reply(prominence="huge"), "text"]}),
    ]
    got = knowledge.parse_units(spark.createDataFrame([(k, "seg_1", r) for k, r in enumerate(raws)], "doc_id int, chunk_id string, raw string")).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ku_id, list(r.source_pages), list(r.related_concepts)) for r in got] == [
        (0, "seg_1_ku_01", [5], []), (0, "seg_1_ku_02", [3, 4], ["ReAct"]), (1, "seg_1_ku_01", [7], ["T"]), (2, "seg_1_ku_01", [0], []),
    ]


def test_ownership(spark):
    schema = "k int, concept string, local_concept string, owner_concept string, owner_level string, parent_l1 string, parent_l2 string, topic string, parent_concept_name string, owner_concepts array<string>"
    rows = [
        (0, "lstm", None, None, None, None, None, "LSTM", "RNN", ["LSTM", "GRU", "RNN"]),
        (1, "rnn", None, "", "", "", "", "LSTM", "RNN", ["LSTM", "RNN"]),
        (2, "other", "gru", None, None, None, None, "Gates", "RNN", ["LSTM", "GRU"]),
        (3, "x", None, "unknown", "", None, None, "Gates", "", []),
    ]
    got = {r.k: r for r in knowledge.with_ownership(spark.createDataFrame(rows, schema)).collect()}
    assert (got[0].owner_concept, got[0].owner_level, got[0].parent_l1, got[0].parent_l2, got[0].local_concept) == ("LSTM", "L2", "RNN", "LSTM", "lstm")
    assert (got[1].owner_concept, got[1].owner_level, got[1].parent_l2) == ("RNN", "L1", "LSTM")
    assert (got[2].owner_concept, got[2].owner_level, got[2].parent_l2) == ("GRU", "L2", "GRU")
    assert (got[3].owner_concept, got[3].owner_level, got[3].parent_l1) == ("Gates", "L1", "Gates")


def test_fuzzy_join(spark):
    rng = random.Random(4)
    words = ["deep", "nets", "recurrent", "cell", "gates", "memory"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 4)))
    names, keys = {name().title() for _ in range(60)}, {name() for _ in range(40)}
    tok = lambda s: {t.rstrip("s") if len(t) > 3 else t for t in s.lower().split()}
    want = set()
    for n in names:
        exact = [k for k in keys if k == n.lower()]
        want |= {(n, k) for k in (exact or [k for k in keys if tok(k) <= tok(n) or tok(n) <= tok(k)])}
    got = knowledge.fuzzy_join(spark.createDataFrame([(1, n) for n in names], "doc_id int, name string"), spark.createDataFrame([(1, k) for k in keys], "doc_id int, key string"))
    assert {(r.name, r.key) for r in got.collect()} == want


def test_degree_cap(spark):
    rng = random.Random(7)
    rels = ["CONTRASTS_WITH", "EXTENDS", "SIMILAR_TO", "SIBLING_OF", "PART_OF"]
    pairs = sorted({tuple(sorted(rng.sample([f"k{i:02d}" for i in range(14)], 2))) for _ in range(50)})
    rows = [("d", a, b, rng.choice(rels), k) for k, (a, b) in enumerate(pairs)]
    got = knowledge.cap_degrees(spark.createDataFrame(rows, "doc_id string, a string, b string, relation string, edge_seq int"), 4).collect()
    degree = {}
    for r in got:
        for x in (r.a, r.b):
            degree[x] = degree.get(x, 0) + 1
    assert max(degree.values()) <= 4 and 0 < len(got) < len(rows)


def unit(k, concept, kind="definition", owner="", l1="L", prominence="primary", related=()):
    return {"ord": k, "ku_id": f"seg_001_ku_{k:02d}", "type": kind, "concept": concept, "local_concept": concept, "owner_concept": owner or concept, "parent_l1": l1, "parent_l2": "", "verbatim_evidence": "one two three four five six seven", "prominence": prominence, "related_kus": [dict(zip(("target_concept", "relation", "evidence"), r, strict=True)) for r in related]}


def test_document_edges():
    units = [unit(1, "lstm", related=[("GRUs", "CONTRASTS_WITH", "")]), unit(2, "gru"), unit(3, "gate", "mechanism", "lstm"), unit(4, "peephole", "failure_mode", "lstm"), unit(5, "rnn")]
    rel = lambda k, a, b, r: {"rel_ord": k, "from_concept": a, "to_concept": b, "relation": r}
    e = plain_graph.document_edges(units, [rel(1, "rnn", "lstm", "EXTENDS"), rel(2, "lstm", "gru", "SIMILAR_TO")], [["lstm", "gru", "rnn"]])
    ids = lambda a, b: (f"seg_001_ku_0{a}", f"seg_001_ku_0{b}")
    kinds = {(a, b): r for a, b, r in e}
    assert kinds[ids(1, 2)] == "CONTRASTS_WITH"  # the first relation of a pair stays
    assert kinds[ids(1, 5)] == "EXTENDS"
    assert kinds[ids(2, 5)] == "SIBLING_OF"  # lstm and rnn follow each other, gru and rnn do not
    assert all(a < b for a, b, _ in e) and len(kinds) == len(e)
    assert plain_graph.document_edges([], [], []) == []


def test_graph_operator(spark):
    schema = "doc_id string, ord int, ku_id string, type string, concept string, local_concept string, owner_concept string, parent_l1 string, parent_l2 string, verbatim_evidence string, prominence string, related_kus array<struct<target_concept:string,relation:string,evidence:string>>"
    units = [unit(1, "lstm", related=[("gru", "CONTRASTS_WITH", "")]), unit(2, "gru")]
    df = spark.createDataFrame([("d", *[u[c.split(" ")[0]] if c.split(" ")[0] != "related_kus" else [tuple(x.values()) for x in u["related_kus"]] for c in schema.split(", ")[1:]]) for u in units], schema)
    none = spark.createDataFrame([], "doc_id string, rel_ord int, from_concept string, to_concept string, relation string")
    tree = spark.createDataFrame([], "doc_id string, l1_ord int, names array<string>")
    assert [(r.a[-2:], r.b[-2:], r.relation) for r in concept_graph.concept_edges(df, none, tree).collect()] == [("01", "02", "CONTRASTS_WITH")]


def test_concept_edges_against_the_plain_version(spark):
    """Documents with few names, so that degrees decide, and with segments that units do not name."""
    rng = random.Random(11)
    words = ["deep", "nets", "recurrent-cell", "Gate", "gates", "memory", "x"]
    name = lambda: rng.choice([" ".join(rng.sample(words, rng.randrange(1, 4))), rng.choice(words), "", None, "+", " - "])
    kinds, rels = ["definition", "mechanism", "failure_mode", "procedure", "application", "trade_off"], [*concept_graph.MODES, "PART_OF", None]
    units, relations, trees, segs = [], [], [], []
    for d in range(12):
        n = rng.randrange(1, 40)
        for k in range(n):
            related = [(name(), rng.choice(rels), "") for _ in range(rng.randrange(4))]
            units.append((f"d{d}", k, f"seg_{k % 5:03d}_ku_{k:02d}", rng.choice(kinds), name(), name(), name(), name(), name(), rng.choice([None, "w " * rng.randrange(40)]), rng.choice(["primary", "supporting", "peripheral", None]), related or None))
        relations += [(f"d{d}", k, name(), name(), rng.choice(rels)) for k in range(rng.randrange(40))]
        trees += [(f"d{d}", k, [name() for _ in range(rng.randrange(6))]) for k in range(rng.randrange(4))]
        segs += [(f"d{d}", f"seg_{k:03d}", name(), rng.choice([None, [name(), name(), "only here"]])) for k in range(rng.randrange(8))]
    schema = "doc_id string, ord int, ku_id string, type string, concept string, local_concept string, owner_concept string, parent_l1 string, parent_l2 string, verbatim_evidence string, prominence string, related_kus array<struct<target_concept:string,relation:string,evidence:string>>"
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    tables = [spark.createDataFrame(units, schema), spark.createDataFrame(relations, "doc_id string, rel_ord int, from_concept string, to_concept string, relation string"), spark.createDataFrame(trees, "doc_id string, l1_ord int, names array<string>"), spark.createDataFrame(segs, "doc_id string, segment_id string, label string, concepts array<string>")]
    for with_segments in (True, False):
        got = {}
        for r in concept_graph.concept_edges(*tables[: 4 if with_segments else 3], most=3).orderBy("doc_id", "edge_seq").collect():
            got.setdefault(r.doc_id, []).append((r.a, r.b, r.relation))
        for d in range(12):
            mine = lambda rows: [r[1:] for r in rows if r[0] == f"d{d}"]  # noqa: E731, B023
            own = [dict(zip(columns[1:], r, strict=True)) for r in mine(units)]
            for u in own:
                u["related_kus"] = [{"target_concept": t, "relation": r or "", "evidence": e} for t, r, e in u["related_kus"] or []]
            rel = [dict(zip(("rel_ord", "from_concept", "to_concept", "relation"), (*r[:3], r[3] or ""), strict=True)) for r in mine(relations)]
            seg = [{"segment_id": i, "label": x, "concepts": c or []} for i, x, c in mine(segs)] if with_segments else []
            want = plain_graph.document_edges(own, rel, [t[1] for t in mine(trees)], sorted(seg, key=lambda s: plain_graph.by_number(s["segment_id"])), 3)
            assert got.get(f"d{d}", []) == want
    assert concept_graph.concept_edges(*[t.limit(0) for t in tables]).count() == 0


def merged_one_by_one(rows, kids):
    """Small siblings join their right neighbour, pass by pass, one document in plain Python."""

    def join(a, b):
        names = a["concepts"] + [c for c in b["concepts"] if c not in a["concepts"]]
        return a | {"label": f"{a['label']} + {b['label']}", "concepts": names, "source_pages": sorted({*a["source_pages"], *b["source_pages"]}), "text": segments.RULE.join(t for t in (a["text"], b["text"]) if t.strip())}

    if not any(len(r["text"]) < segments.SMALL and r["parent_concept_id"] for r in rows):
        return rows
    out, families = [r for r in rows if not r["parent_concept_id"]], {}
    for r in rows:
        if r["parent_concept_id"]:
            families.setdefault(r["parent_concept_id"], []).append(r)
    for parent, family in families.items():
        family.sort(key=lambda r: r["source_pages"][0])
        if all(len(r["text"]) < segments.SMALL for r in family):
            whole = family[0]
            for r in family[1:]:
                whole = join(whole, r)
            name = family[0]["parent_concept_name"] or parent
            out.append(whole | {"label": name, "concepts": [name, *kids.get(parent, [])], "concept_id": parent, "parent_concept_id": "", "parent_concept_name": ""})
            continue
        while True:
            todo, done = family[::-1], []
            while todo:
                r = todo.pop()
                done.append(join(r, todo.pop()) if len(r["text"]) < segments.SMALL and todo else r)
            if len(done) == len(family):
                break
            family = done
        out += family
    out.sort(key=lambda r: r["source_pages"][0])
    return [r | {"segment_id": f"seg_{k:03d}", "ord": k} for k, r in enumerate(out, 1)]


def test_merged_small_against_the_plain_version(spark):
    rng = random.Random(8)
    schema = "doc_id string, ord int, label string, concepts array<string>, last_page int, parent_concept_id string, concept_id string, parent_concept_name string, source_pages array<int>, text string, segment_id string"
    names = [x.split()[0] for x in schema.split(", ")]
    rows, tree = [], []
    for d in range(25):
        text = lambda: rng.choice(["x" * rng.randrange(1, 60), "y" * rng.randrange(1, 600), "z" * 700, "  \n "]) if d else "z" * 800  # noqa: E731, B023
        page = 0
        for k in range(1, rng.randrange(2, 60)):
            parent = rng.choice(["", "p", "q", "r"]) if d % 5 else rng.choice(["p", "p", "p", ""])
            pages = list(range(page + 1, page + 1 + rng.randrange(1, 4)))
            page += rng.randrange(0, 3)
            rows.append((f"d{d}", k, f"s{k}", [f"c{k}", f"shared{k % 3}"], pages[-1], parent, f"id{k}", rng.choice(["", parent.upper()]), pages, text(), f"seg_{k:03d}"))
        tree += [(f"d{d}", p, [(f"{p} child {j}",) for j in range(3)] if p != "r" else None) for p in "pqr"]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in segments.merged_small(df, spark.createDataFrame(tree, "doc_id string, concept_id string, children array<struct<name:string>>")).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.asDict())
    for d in range(25):
        want = merged_one_by_one([dict(zip(names, r, strict=True)) for r in rows if r[0] == f"d{d}"], {p: [f"{p} child {j}" for j in range(3)] for p in "pq"})
        assert got.get(f"d{d}", []) == want


def test_segments(spark):
    pages = spark.createDataFrame([("d", p, f"Slide {p}", f"text {p} " + "x" * (30 if p < 8 else 600), False) for p in range(1, 21)], "doc_id string, page_num int, title string, text string, has_image boolean")
    cut = lambda rows: spark.createDataFrame([("d", k, f"s{k}", [f"c{k}"], last, pid, f"id{k}", "P" if pid else "") for k, (last, pid) in enumerate(rows, 1)], "doc_id string, ord int, label string, concepts array<string>, last_page int, parent_concept_id string, concept_id string, parent_concept_name string")
    spans = lambda df: [(r.source_pages[0], r.source_pages[-1]) for r in df.orderBy("ord").collect()]
    assert spans(segments.built(cut([(6, ""), (12, ""), (20, "")]), pages)) == [(1, 6), (7, 12), (13, 20)]
    assert spans(segments.built(cut([(10, ""), (99, "")]), pages)) == [(1, 10), (11, 20)]
    assert spans(segments.built(cut([(5, ""), (None, ""), (5, ""), (8, "")]), pages, absorb_trailing=False)) == [(1, 5), (6, 8)]
    small = segments.built(cut([(2, "p"), (4, "p"), (12, "p"), (20, "")]), pages)
    tree = spark.createDataFrame([("d", 1, "p", "P", None, [("id1", "c1", 2)])], "doc_id string, l1_ord int, concept_id string, name string, last_page int, children array<struct<concept_id:string,name:string,last_page:int>>")
    merged = segments.merged_small(small, tree)
    assert spans(merged) == [(1, 12), (13, 20)]
    parts = segments.split_long(merged, 2000).orderBy("segment_id").collect()
    assert [r.segment_id for r in parts[:2]] == ["seg_001a", "seg_001b"] and all(len(r.text) <= 2700 for r in parts)
    assert sorted({p for r in parts for p in r.source_pages}) == list(range(1, 21))
    only = segments.merged_small(segments.built(cut([(2, "p"), (4, "p")]), pages, absorb_trailing=False), tree).collect()
    assert len(only) == 1 and only[0].label == "P" and list(only[0].concepts) == ["P", "c1"]
    seen = segments.with_context(small).orderBy("ord").collect()
    assert list(seen[2].seen) == ["c1", "P", "c2"] and [r.l1_seen for r in seen] == [False, True, True, False]


def flaky(prompt, json_mode):
    if "fail" in prompt:
        raise RuntimeError("down")
    return "" if "empty" in prompt else prompt.upper()


def test_calls_and_resume(spark):
    df = spark.createDataFrame([(1, "a"), (2, "fail"), (3, "empty")], "k int, prompt string")
    got = {r.k: r for r in generation.called(df, flaky).collect()}
    assert (got[1].raw, got[1].status, got[1].retry_count) == ("A", "success", 0)
    assert (got[2].raw, got[2].status, got[2].error) == (None, "error", "RuntimeError: down") and got[3].status == "empty"
    chunks = spark.createDataFrame([("d", "c1", None), ("d", "c2", "stub"), ("d", "c3", "conceptual")], "doc_id string, chunk_id string, chunk_type string")
    items = generation.work_list(chunks, ("apply", "analyze"))
    assert items.count() == 4
    done = spark.createDataFrame([("d__c1__apply",)], "item_key string")
    assert {r.item_key for r in generation.remaining(items, done).collect()} == {"d__c1__analyze", "d__c3__apply", "d__c3__analyze"}
    assert generation.estimated_seconds(10, 2) == 36


def writer(prompt, json_mode, temperature):
    if prompt.startswith("Repair"):
        return json.dumps({"question": "Repaired?", "options": {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}, "answer": "b", "explanation": "B fits"})
    return "no json"


def test_repair_and_parse(spark):
    df = spark.createDataFrame([("d", 1, "p")], "doc_id string, ord int, prompt string")
    asked = generation.repaired(generation.called(df, writer), writer)
    r = generation.parsed_questions(asked).first()
    assert (r.question, r.A, r.D, r.answer, r.ok) == ("Repaired?", "1", "4", "B", True)
    flat = [("```json\n" + json.dumps({"mcqs": [{"question": "q", "A": "1", "answer": "A"}, {"question": "r", "answer": "Z"}]}) + "```",), ('{"skip": true}',), ("x",)]
    assert [x.question for x in generation.parsed_flat_questions(spark.createDataFrame(flat, "raw string")).collect()] == ["q"]


def extractor(prompt, json_mode):
    if "c2" in prompt:
        raise ValueError("no")
    return json.dumps([
        reply(ku_id="", related_kus=[{"target_concept": f"T{k}", "relation": r, "evidence": e} for k, (r, e) in enumerate([("EXTENDS", "gate keeps"), ("CONTRASTS_WITH", "the state"), ("CONTRASTS_WITH", "invented wholly"), ("CONTRASTS_WITH", "keeps state"), ("CONTRASTS_WITH", "gate state"), ("EXTENDS", "gate")])]),
        reply(ku_id="", verbatim_evidence="something else entirely"), reply(ku_id="", completeness="incomplete"),
    ])


def test_extraction(spark):
    rows = [("d", "c1", "Gates", "The gate keeps the state.", "RNN", ["Gates", "RNN"]), ("d", "c2", "t", "x", "", [])]
    got = generation.extracted_units(spark.createDataFrame(rows, "doc_id string, chunk_id string, topic string, text string, parent_concept_name string, owner_concepts array<string>"), extractor).collect()
    assert [r.ku_id for r in got] == ["c1_ku_01"]
    assert [(e.target_concept, e.relation) for e in got[0].related_kus] == [("T1", "CONTRASTS_WITH"), ("T3", "CONTRASTS_WITH"), ("T0", "EXTENDS")]


def scores(prompt, json_mode):
    return json.dumps({"relevance": 4, "answerability": 4, "bloom_alignment": 3, "answer_correctness": 1})


def test_judge(spark):
    chunks = spark.createDataFrame([("d", "chunk_001", "text"), ("d", "chunk_002", "")], "doc_id string, chunk_id string, text string")
    got = generation.judge_calls(spark.createDataFrame([GOOD, change(2, source_chunk="chunk_002")], MCQ), chunks, scores).collect()
    assert [(r.semantic_avg, r.passed) for r in got] == [(3.67, True)]


def fails(path, content):
    raise OSError("broken")


def lines(path, content):
    return [{"text": t, "title": t[:5]} for t in content.decode().split("\n")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("first page\nsecond page")
    f = files.binary_files(spark, str(tmp_path))
    r = f.first()
    assert (r.title, r.file_type, r.file_size_kb) == ("a", "PDF", 0.0)
    got = files.extracted_pages(f, fails, lines).orderBy("page_num").collect()
    assert [(x.page_num, x.text, x.parser) for x in got] == [(1, "first page", "custom"), (2, "second page", "custom")]
    assert files.page_range(files.extracted_pages(f, lines), 2, 2).count() == 1 and files.page_range(f, None, 3) is f
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(Exception, match="unsupported"):
        files.binary_files(spark, str(tmp_path)).collect()
    files.append_log(spark.createDataFrame([("k1", 2)], "item_key string, n_mcqs long"), str(tmp_path / "log"))
    files.append_log(spark.createDataFrame([("k2", 1)], "item_key string, n_mcqs long"), str(tmp_path / "log"))
    assert files.done_items(spark, str(tmp_path / "log")).count() == 2 and files.done_items(spark, str(tmp_path / "none")).count() == 0
    md = spark.createDataFrame([(1, "# Head\nshort\n# Next\nA body that is surely longer than thirty characters.")], "doc_id int, markdown string")
    assert [(x.page_num, x.title) for x in files.markdown_sections(md).collect()] == [(2, "Next")]
    (tmp_path / "m.json").write_text('[\n{"a": 1},\n{"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "m.json"), "a int").count() == 2


def test_stream(spark, sf_dir, tmp_path):
    from lectern.plans.views import VIEWS

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    rows = spark.sql(VIEWS["call_log"][1], events=stream)
    q = calls.windowed_stats(rows).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = calls.windowed_stats(spark.sql(VIEWS["call_log"][1], events=table))
    assert spark.table("windows").count() == want.count()
    assert spark.table("windows").agg(F.sum("calls")).first()[0] == table.count()


def test_within_degree():
    from lectern.functions.caps import within_degree

    ends = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("c", "d")]
    assert within_degree(ends, [1, 1, 1, 1, 1], 3) == [True] * 5
    assert within_degree(ends, [1, 1, 1, 1, 1], 2) == [True, True, False, True, False]
    assert within_degree(ends, [9, 1, 1, 1, 1], 2) == [False, True, True, True, False]
    assert within_degree([], [], 2) == []
    # the order of nodes decides who gives up first
    assert within_degree([("a", "b"), ("b", "c")], [2, 1], 1) == [False, True] and within_degree([("a", "b"), ("b", "c")], [1, 1], 1, ["b"]) == [True, False] and within_degree([("a", "b"), ("b", "c")], [2, 1], 1, ["b"]) == [False, True]


def test_choice_among_many_units_looks_at_few():
    rng = random.Random(2)
    kinds = ["definition", "mechanism", "procedure"]
    units = [{"ku_id": f"u{k:04d}", "ord": k, "type": rng.choice(kinds), "owner": "", "name": f"n{k}", "shown": "s", "prom": 0, "local": 120, "own": 0, "fit": 120 + rng.randrange(9), "holds": True} for k in range(1000)]
    g, looked = concept_graph.Graph(), 0
    for u in units:
        g.add("name", u)
    g.ready()
    plain = g.points

    def counted(u):
        nonlocal looked
        looked += 1
        return plain(u)

    for k in range(300):
        relation = rng.choice(["EXTENDS", "ENABLES", "PART_OF"])
        bonus = concept_graph.TYPE_BONUS.get(relation, {})
        want = sorted(units, key=lambda u: (-plain(u) - bonus.get(u["type"], 0), u["ku_id"]))[:3]  # noqa: B023
        g.points = counted
        got = g.found("name", relation, 3)
        g.points = plain
        assert [u["ku_id"] for u in got] == [u["ku_id"] for u in want]
        g.connect(got[rng.randrange(3)], units[rng.randrange(1000)], relation)
    assert looked < 300 * 40


def test_units_of_a_graph_take_little_memory():
    import tracemalloc

    def unit(k, own):
        return {"ku_id": f"u{k:06d}", "ord": k, "type": "definition", "owner": "o", "name": f"n{k % 9}", "shown": "s", "prom": k % 3, "local": 120, "own": own, "fit": 120 + k % 3, "holds": own == 0}

    tracemalloc.start()
    try:
        g = concept_graph.Graph()
        for k in range(5000):
            for own in range(3):
                g.add(f"name {own}", unit(k, own))
        g.ready()
        for k in range(0, 4998):
            for j in (1, 2):
                g.connect(unit(k, 0), unit(k + j, 0), "EXTENDS")
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    edges, best = len(g.kind), [u["ku_id"] for u in g.found("name 0", "", 2)]
    each = held // 5000
    assert edges > 9000 and best == ["u000002", "u000005"]
    assert each < 1500


def test_replies_are_parsed_once(spark):
    asked = spark.createDataFrame([("d", '{"question": "Which of these holds?", "options": {"a": "1", "b": "2", "c": "3", "d": "4"}, "answer": "b", "explanation": "it does"}')], "doc_id string, raw string")
    out = generation.parsed_questions(asked).where("ok")
    r = out.first()
    assert (r.question, r.A, r.D, r.answer, r.explanation) == ("Which of these holds?", "1", "4", "B", "it does")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    n = plan.count("from_json") + plan.count("jsontostructs")
    assert n == 1
