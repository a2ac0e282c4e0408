"""Reports, exports, budgets, resumed calls and saved graphs."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from lectern.operators import chunking, generation, graph, profile, questions, reports
from lectern.sources import exports, files

PAGE = "doc_id string, page_num int, title string, text string, has_image boolean, ocr_used boolean, parser string"


def test_robustness_of_files_without_rows(spark):
    pages = profile.with_page_columns(spark.createDataFrame([("a", 1, "t", "word " * 90, False, False, "p"), ("a", 2, "t", None, None, None, None)], PAGE))
    chunks = spark.createDataFrame([("a", "conceptual"), ("a", None), ("a", "stub")], "doc_id string, chunk_type string")
    checked = spark.createDataFrame([("a", None, None, "apply"), ("a", "schema", "Missing: x", None), ("a", "quality", "Duplicate question", "apply")], "doc_id string, layer string, reason string, bloom_level string")
    calls = spark.createDataFrame([("a", "success", "p", "org/m", 1.0), ("a", "success", "p", "m", 0.0), ("a", "skipped", None, None, None), (None, "success", None, None, 2.0)], "doc_id string, status string, provider string, model string, latency_seconds double")
    known = spark.createDataFrame([("a", 3), ("b", None)], "doc_id string, total_pages long")
    out = reports.robustness(known, pages, chunks, checked, calls)
    a, b = out.orderBy("doc_id").collect()
    assert (a.pages_extracted, a.parse_success_rate, a.total_chunks, a.conceptual_ratio) == (2, 0.667, 3, 0.333)
    assert (a.total_raw_mcqs, a.valid_mcqs, a.schema_pass_rate, a.content_pass_rate, a.skipped_calls, a.latency_per_call) == (3, 1, 0.667, 0.333, 1, 1.0)
    assert a.provider_call_counts == {"p/m": 1} and a.chunk_type_counts == {"conceptual": 1, "stub": 1, "unknown": 1}
    assert a.reject_reason_counts == {"Missing": 1, "Duplicate question": 1} and a.bloom_dist["apply"] == 1 and a.bloom_dist["create"] == 0
    assert (b.total_pages, b.parse_success_rate, b.conceptual_ratio, b.schema_pass_rate, b.content_pass_rate, b.provider_call_counts) == (0, 1.0, 0.0, 1.0, 0.0, {})
    lines = [r.line for r in reports.robustness_table(out).orderBy("ord").collect()]
    assert len(lines) == 4 and len({len(x) for x in lines}) == 1 and "67%" in lines[2]


def test_logs(spark, tmp_path):
    pages = spark.createDataFrame([("a", k, "T" * 60, "x" * k, False, False, "p") for k in (1, 2, 3, 4, 5)] + [("a", 6, None, None, None, None, None)], PAGE)
    lines = [r.line for r in reports.page_log(pages).orderBy("ord").collect()]
    assert lines[0] == "1".ljust(7) + ("T" * 40).ljust(43) + "1" and lines[5] == "6".ljust(50) + "0"
    chunks = chunking.numbered(chunking.build_chunks(chunking.groups_fixed(pages, 5)))
    log = reports.chunk_log(chunks)
    assert [r.line.split()[-1] for r in log.orderBy("ord").collect()] == ["23", "0", "12"]
    assert "[1..5](5p)" in log.orderBy("ord").first().line
    reports.write_lines(log, str(tmp_path / "log"), ["doc_id"])
    assert spark.read.text(str(tmp_path / "log")).count() == 3
    judged = spark.createDataFrame([("f", 3, 4.126)], "file string, n int, mean double")
    assert [r.line.split() for r in reports.judge_table(judged, "file").orderBy("ord").collect()][2] == ["f", "3.00", "4.13"]


def test_workbooks(spark):
    mcq = "doc_id string, ord int, question string, A string, B string, C string, D string, answer string"
    rows = spark.createDataFrame([("a", 2, "is 1 < 2 & 3?", " x", "b", "c", "é", "B"), ("a", 1, "first", "a", "b", "c", "d", "D")], mcq)
    made = exports.kahoot_workbooks(rows)
    (one,) = made.collect()
    assert one.n == 2 and bytes(made.first().content) == bytes(one.content)
    z = zipfile.ZipFile(io.BytesIO(one.content))
    assert z.testzip() is None and all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    got = [["".join(c.itertext()) for c in r.findall("m:c", ns)] for r in sheet.findall(".//m:row", ns)]
    assert got == [
        ["Question", "Answer 1", "Answer 2", "Answer 3", "Answer 4", "Time Limit (sec)", "Correct Answer"],
        ["first", "a", "b", "c", "d", "30", "4"],
        ["is 1 < 2 & 3?", " x", "b", "c", "é", "30", "2"],
    ]
    assert exports.kahoot_workbooks(rows.where("false")).count() == 0
    with pytest.raises(ValueError, match="holds"):
        exports.workbook(["x"], ((1,) for _ in range(exports.MAX_ROWS)), [9], "s")


def test_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 'q "2"\n', None), ("a", 1, "q1", "é")], "doc_id string, ord int, question string, A string")
    (one,) = exports.json_arrays(rows, ["question", "A"]).collect()
    assert json.loads(one.content) == [{"question": "q1", "A": "é"}, {"question": 'q "2"\n', "A": None}]
    exports.write_json(rows, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["ord"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]


def test_budget(spark):
    rows = spark.createDataFrame([(True, list(range(n))) for n in (0, 12, 24, 200)] + [(None, [1]), (True, None)], "is_whole_doc boolean, pages array<int>")
    got = [(r.n_questions, r.max_tokens) for r in generation.with_budget(rows, 2).collect()]
    assert got == [(2, 1700), (2, 1700), (4, 2900), (5, 3500), (1, 1536), (2, 1700)]
    assert generation.with_budget(rows.drop("is_whole_doc"), 2).where("n_questions <> 1").count() == 0


def test_calls_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    items = spark.createDataFrame([(f"k{i}", "d", f"c{i}", f"p{i}") for i in range(20)], "item_key string, doc_id string, chunk_id string, prompt string")

    def some(prompt, json_mode):
        if prompt.endswith("7"):
            raise RuntimeError("no")
        return prompt.upper()

    first = generation.called_in_parts(items, some, path, parts=4)
    assert first.count() == 18 and first.where("raw = 'P3'").count() == 1
    again = generation.called_in_parts(items, lambda p, j: "late", path, parts=4)
    assert sorted(r.item_key for r in again.where("raw = 'late'").collect()) == ["k17", "k7"] and again.count() == 20
    assert files.clear_log(spark, path) and not files.clear_log(spark, path)
    assert files.done_items(spark, path).count() == 0


def test_rehydrated(spark):
    saved = {
        "concepts": {"Nets": {"kus": [{"id": "u1", "concept": " cell ", "owner_concept": "Nets", "ui_node_id": "Nets"}]}},
        "ku_graph": {"u1": ["u2", "u3", "u3"]},
        "ku_edges": [{"source": "u1", "target": "u2", "relation": "ENABLES"}, {"source": "u2", "target": "u1", "relation": "EXTENDS"}],
        "edges": [{"source": "u8", "target": "u9", "relation": "ENABLES"}],
    }
    nodes = {"nodes": [{"id": "n", "kus": [{"ku_id": "v1", "concept": "x"}]}, {"id": "m"}], "kus": []}
    df = spark.createDataFrame([("a", json.dumps(saved)), ("b", json.dumps(nodes)), ("c", "no json"), ("d", None), ("e", "{}")], "doc_id string, graph string")
    units, members, links = graph.rehydrated(df)
    assert sorted((r.doc_id, r.ku_id) for r in units.collect()) == [("a", "u1"), ("b", "v1")]
    assert sorted((r.doc_id, r.concept, r.ku_id) for r in members.collect()) == [("a", "Nets", "u1"), ("a", "cell", "u1"), ("b", "x", "v1")]
    assert sorted((r.a, r.b, r.relation or "") for r in links.collect()) == [("u1", "u2", "EXTENDS"), ("u1", "u3", ""), ("u2", "u1", "EXTENDS")]


def test_sections(spark):
    texts = ["lost\n# One\nbody\n## ![x](y)\n![z](w)\nreal title\n###  three\nend", "#  \n## Two\nrest", "no heading", "<!-- Slide number: 1 -->\n# S\nb<!-- slide number: 2 -->\n![p](q)", "# ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, markdown string")
    got = {}
    for r in chunking.sections(df).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.body))
    assert got[0] == [("One", "body"), ("real title", "![z](w)\nreal title\n###  three\nend")]
    assert got[1] == [("## Two", "rest")]  # blanks after a mark may hold a line end
    assert got[2] == [("Document", "no heading")] and got[4] == [("Document", "# ")] and got[5] == [("Document", "")]
    assert got[3] == [("S", "b"), ("Slide 2", "![p](q)")]


def test_exports_need_clean_rows(spark):
    rows = questions.prepared(spark.createDataFrame([("a", 1, "q", "a", "b", "", "d", "x")], "doc_id string, ord int, question string, A string, B string, C string, D string, answer string"))
    with pytest.raises(Exception, match="cannot export"):
        exports.kahoot_workbooks(questions.strict(rows)).collect()
