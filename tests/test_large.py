"""Documents of more pages than the smallest tables have, against the SQL."""

import random

import duckdb
import pytest
from lectern.operators import segments
from lectern.plans import registry

from .test_entry import rows


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """One source of 1300 pages and one of 40, in two languages, with copies, near copies, empty texts and runs of them."""
    rng = random.Random(5)
    out = []
    for k in range(1340):
        kind = rng.random()
        if k and kind < 0.25:
            text = rng.choice(out)[1]
        elif k and kind < 0.4:
            text = rng.choice(out)[1] + " more"
        elif kind < 0.45:
            text = ""
        else:
            text = " ".join(f"{rng.choice('abc')}{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))) + "\nlast line"
        out.append((k, text, rng.choice(["en", "en", "en", "de"]), "src1" if k % 33 == 32 else "src0", len(text)))
    path = tmp_path_factory.mktemp("large")
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", ["checkpoint_summary", "work_list", "dedup_pages", "chunk_pipeline", "chunks_by_overlap", "chunks_auto", "chunks_by_title", "chunk_log", "grounded_evidence"])
def test_query(spark, large, name):
    path, con = large
    got = registry.QUERIES[name](spark, path).toPandas()
    assert rows(got) == rows(con.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", ["segment_breaks", "page_coverage", "segments", "segments_merged_and_split"])
def test_last_pages_count_blank_pages(spark, large, name):
    path, con = large
    assert rows(registry.QUERIES[name](spark, path).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def test_parts_past_a_byte(spark):
    text = "\n\n---\n\n".join(["x" * 90] * 400)
    s = spark.createDataFrame([("d", "seg_001", text, list(range(400)), 1)], "doc_id string, segment_id string, text string, source_pages array<int>, ord int")
    got = [r.segment_id for r in segments.split_long(s, 100).collect()]
    assert sorted(got) == [f"seg_001{chr(97 + k)}" for k in range(400)]


def test_concept_graph_gives_each_edge_once_without_comparing_edges(spark):
    import re

    from lectern.operators import knowledge

    rng = random.Random(7)
    units = [("d", f"u{k}", f"Name {k % 9}") for k in range(60)]
    told = [("d", f"u{rng.randrange(70)}", f"name-{rng.randrange(11)}") for _ in range(80)] + [("d", "u1", None)]
    of = {u: c.lower() for _, u, c in units}
    want = {p for _, a, t in told if t for b, c in of.items() if c == t.replace("-", " ") and a != b for p in ((a, b), (b, a))}
    out = knowledge.concept_graph(spark.createDataFrame(units, "doc_id string, ku_id string, concept string"), spark.createDataFrame(told, "doc_id string, ku_id string, target string"))
    got = [(r.a, r.b) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert not re.search(r"Aggregate.*\[doc_id#\d+, a#", out._jdf.queryExecution().toString())


def test_distractors_of_units_of_few_kinds_with_many_edges(spark):
    import re

    import pandas as pd
    from lectern.functions.vocab import HORIZONTAL, STRUCTURAL
    from lectern.operators import ranking
    from lectern.plans.units import EDGE, KU

    rng = random.Random(11)
    cols = ["doc_id", "ku_id", "type", "concept", "owner_concept", "parent_l2", "parent_l1", "content", "verbatim_evidence"]
    kinds = ["definition", "mechanism", "failure_mode", "trade_off", "procedure"]
    units = []
    for d in range(2):
        for k in range(150):
            name = rng.choice(["red ring", "red bolt", "blue ring", "blue ring plate", "old-plate"])
            owner = rng.choice([name.split()[0], "", "red"])
            units.append((f"d{d}", f"u{k:03d}", rng.choice(kinds), name, owner, "", rng.choice(["ring", "bolt", ""]), f"the {name} is here", " ".join(["word"] * rng.choice([3, 8, 30]))))
    pairs = {(d, *sorted(rng.sample(range(150), 2))) for d in range(2) for _ in range(230)} | {(0, 7, k) for k in range(8, 60)}
    edges = [(f"d{d}", f"u{a:03d}", f"u{b:03d}", rng.choice(HORIZONTAL + STRUCTURAL), k) for k, (d, a, b) in enumerate(sorted(pairs))]
    names = ["doc_id", "a", "b", "relation", "edge_seq"]
    out = ranking.distractors(spark.createDataFrame(units, cols), spark.createDataFrame(edges, names))
    con = duckdb.connect()
    con.register("ku", pd.DataFrame(units, columns=cols))
    con.register("ku_edge", pd.DataFrame(edges, columns=names))
    want = con.execute(registry.SQL["distractors"].replace(f"WITH {KU}, {EDGE}, ", "WITH ")).df()
    assert rows(out.toPandas()) == rows(want) and len(want) > 800
    # pairs of units are made for edges alone
    assert not re.search(r"Window.*\[doc_id#\d+, a_ku_id#\d+, b_ku_id", out._jdf.queryExecution().toString())


def test_windows_of_grounded_evidence_take_no_texts(spark, large):
    import re

    plan = registry.QUERIES["grounded_evidence"](spark, large[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(doc_id" in plan and not re.search(r"lead\(text", plan)


def test_prompts_do_not_shuffle_segments_times_relations(spark):
    """Against a plain version, with names in other cases, missing ones, equal relations and ties of rel_ord; and by the plan."""
    import re

    rng = random.Random(3)
    names = [f"Name {k}" for k in range(6)]
    told = [(d, rng.randrange(300), rng.choice([*names, "NAME 1", None]), rng.choice([*names, "name 2", None]), rng.choice("RS"), rng.choice([None, "", "e" * 90])) for d in "ab" for _ in range(400)]
    told += told[:20]
    segs = [(d, f"seg_{k:03d}", k, rng.choice(["Summary of it", "Lab 1", "Part"]), rng.choice([None, [], rng.sample([*names, "other", None], 4)]), rng.choice(["", "Name 3", "Top"])) for d in "abc" for k in range(60)]
    relations = spark.createDataFrame(told, "doc_id string, rel_ord int, from_concept string, to_concept string, relation string, evidence string")
    parts = spark.createDataFrame(segs, "doc_id string, segment_id string, ord int, label string, concepts array<string>, parent_concept_name string")
    out = segments.with_connections(segments.with_context(parts), relations)
    got = {(r.doc_id, r.segment_id): r for r in out.collect()}
    assert len(got) == len(segs)
    seen = {d: [] for d in "abc"}
    for d, i, _, label, concepts, parent in segs:
        own = {c.lower() for c in concepts or [] if c}
        want = {(o, r, f, t, (e or "")[:80]) for x, o, f, t, r, e in told if x == d and own & {(f or "").lower(), (t or "").lower()}}
        row = got[d, i]
        want = sorted(want, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "", r[4]))
        assert [tuple(c)[:5] for c in row.connections] == want
        assert [c.line for c in row.connections] == [None if f is None or t is None else f"\n- [{r}] {f} -> {t}" + (f": {e}" if e else "") for _, r, f, t, e in want]
        assert list(row.seen) == seen[d] and bool(row.l1_seen) == (parent != "" and parent in seen[d])
        if label != "Lab 1" and concepts is not None:
            seen[d] += [c for c in dict.fromkeys([*concepts, *([parent] if parent else [])]) if c not in seen[d]]
    # relations are not gathered by segment
    assert not re.search(r"Aggregate \[doc_id#\d+, segment_id#\d+\], .*collect_", out._jdf.queryExecution().optimizedPlan().toString())
