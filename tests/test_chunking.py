"""Chunking against plain versions on random documents."""

import random
import re

import pytest
from lectern.operators import chunking
from pyspark.sql import functions as F

PAGE = "doc_id string, page_num int, title string, text string, has_image boolean"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    out = {}
    for d in range(40):
        pages, n = [], 0
        for _ in range(rng.randrange(1, 16)):
            n += rng.randrange(1, 3)
            words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]
            text = " ".join(words)
            if pages and rng.random() < 0.3:
                text = rng.choice(pages)[2] + rng.choice(["", "", " extra"])
            if rng.random() < 0.15:
                text = "![figure](x)\n\n<!-- image intentionally omitted -->"
            pages.append((n, rng.choice(["1. Intro", "Intro", "Lab", "**Deep** nets"]), text, rng.random() < 0.3))
        out[f"d{d}"] = pages
    return out


@pytest.fixture(scope="module")
def pages(spark, docs):
    return spark.createDataFrame([(d, *p) for d, ps in docs.items() for p in ps], PAGE)


def similar(a, b):
    a, b = (set(x.lower().split()) for x in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def norm(t):
    return re.sub(r"^(\d+[.)]\s*|chapter\s+\d+\s*[:\-]?\s*)", "", re.sub(r"[*_`#~]", "", t).lower().strip()).strip()


def runs(ps, same, most=6):
    out = []
    for p in ps:
        if out and len(out[-1]) < most and same(out[-1], p):
            out[-1].append(p)
        else:
            out.append([p])
    return out


def grouped(df):
    out = {}
    for r in df.select("doc_id", "grp", "page_num").collect():
        out.setdefault(r.doc_id, {}).setdefault(r.grp, []).append(r.page_num)
    return {d: [sorted(v) for _, v in sorted(g.items())] for d, g in out.items()}


def test_dedup(pages, docs):
    want = set()
    for d, ps in docs.items():
        kept = []
        for p in ps:
            if not any(similar(p[2], s) > 0.95 for s in kept[-3:]):
                kept.append(p[2])
                want.add((d, p[0]))
    got = {(r.doc_id, r.page_num) for r in chunking.dedup_pages(pages).collect()}
    assert got == want and len(want) < sum(map(len, docs.values()))


def test_groups(pages, docs):
    want = {d: [[p[0] for p in g] for g in runs(ps, lambda g, p: norm(g[-1][1]) == norm(p[1]))] for d, ps in docs.items()}
    assert grouped(chunking.groups_by_title(pages)) == want
    want = {d: [[p[0] for p in g] for g in runs(ps, lambda g, p: similar(" ".join(x[2] for x in g[-2:]), p[2]) >= 0.12)] for d, ps in docs.items()}
    assert grouped(chunking.groups_by_overlap(pages)) == want
    want = {d: [[p[0] for p in ps[k : k + 3]] for k in range(0, len(ps), 3)] for d, ps in docs.items()}
    assert grouped(chunking.groups_fixed(pages, 3)) == want


def weak(c):
    own = [x for x in (s.strip() for s in c["text"].splitlines()) if x]
    return c["has_image"] and len(c["text"]) < 200 and (not own or sum(x.startswith("![") or "intentionally omitted" in x for x in own) / len(own) > 0.6)


def test_weak_images(pages, docs):
    got = {}
    for r in chunking.merge_weak_images(chunking.build_chunks(chunking.groups_fixed(pages, 1))).collect():
        got.setdefault(r.doc_id, []).append((r.grp, list(r.pages), r.text, r.has_image))
    moved = 0
    for d, ps in docs.items():
        chunks = [{"pages": [p[0]], "text": p[2], "has_image": p[3]} for p in ps]
        kept = []
        for i, c in enumerate(chunks):
            if len(chunks) > 1 and weak(c) and (kept or i + 1 < len(chunks)):
                moved += 1
                if kept:
                    kept[-1] = {"pages": kept[-1]["pages"] + c["pages"], "text": kept[-1]["text"] + "\n\n" + c["text"], "has_image": True}
                else:
                    n = chunks[i + 1]
                    chunks[i + 1] = {"pages": c["pages"] + n["pages"], "text": c["text"] + "\n\n" + n["text"], "has_image": True}
            else:
                kept.append(c)
        assert [x[1:] for x in sorted(got[d])] == [(c["pages"], c["text"], c["has_image"]) for c in kept]
    assert moved > 5


def test_strategies(pages):
    for s in ("auto", "title", "overlap", "fixed", "whole_doc"):
        out = chunking.chunk_pages(pages, s)
        assert out.count() >= pages.select("doc_id").distinct().count()
        first = out.where("doc_id = 'd0'").orderBy("grp").first()
        assert first.chunk_id == "chunk_001" and first.chunk_type in ("stub", "structural", "instructional", "conceptual")
    with pytest.raises(ValueError):
        chunking.chunk_pages(pages, "other")


def test_packed(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("x" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    got = {}
    for r in chunking.packed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", 80).collect():
        got.setdefault(r.k, []).append((r.part, r.part_text))
    for k, t in enumerate(texts):
        want, n = [[]], 0
        for p in t.split("\n\n"):
            if want[-1] and n + len(p) > 80:
                want.append([])
                n = 0
            want[-1].append(p)
            n += len(p)
        want = ["\n\n".join(x) for x in want] if len(t) > 80 else [t]
        assert [x for _, x in sorted(got[k])] == want


def test_sections(spark):
    files = [
        (0, "<!-- Slide number: 1 -->\n# First\nbody\n<!-- Slide number: 2 -->\n![x](y)\nplain start\nmore\n<!-- slide number: 3 -->\n"),
        (1, "lost\n# One\ntext a\n## ![i](u)\n![j](k)\nreal title\nb\n### not split\nc"),
        (2, "no heading at all"),
        (3, "\n\n".join(f"para {k} " + "y" * 900 for k in range(9))),
    ]
    got = {}
    for r in chunking.sections(spark.createDataFrame(files, "k int, markdown string")).collect():
        got.setdefault(r.k, []).append((r.section, r.title, r.body))
    got = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert got[0] == [("First", "body"), ("plain start", "![x](y)\nplain start\nmore"), ("Slide 3", "")]
    assert got[1] == [("One", "text a"), ("real title", "![j](k)\nreal title\nb\n### not split\nc")]
    assert got[2] == [("Document", "no heading at all")]
    assert len(got[3]) == 2 and got[3][0][0].startswith("para 0")


def test_types(spark):
    long = "z" * 200
    rows = [("Introduction", long, "structural"), ("Introduction", "z" * 3001, "conceptual"), ("Labels", long, "instructional"), ("Nets", long, "conceptual"), ("Nets", "z", "stub"), ("**Q&A**", long, "structural")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, topic string, text string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", chunking.chunk_type(F.col("topic"), F.col("text"))).collect())
