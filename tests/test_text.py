"""The text kernel against plain Python."""

import re

import pytest
from lectern.functions import text as X
from lectern.functions.vocab import SKIP_LABELS
from pyspark.sql import functions as F

TEXTS = [
    "", " ", "a", "Mục tiêu học tập của môn", "M c tiêu h c t p a b c d e f g h i j k", "a b c d e f g h i j k l m n o p",
    "# Title of page\nBody text", "#\n##   ![alt](x)\n- list\n* item\n| t |\nReal first line here", "  1. Introduction  ", "Chapter 12: Deep nets", "x" * 300,
    "one two　three\x1cfour\x85five", "**Bold** `code` ~x~ ![i](u) end", "line\r\nnext third\x0bfourth", "| a | b |\n|---|---|\n| 1 | 2 |",
    "a  b  c\nd  e  f", "$$x^2$$ and $ab$ y = 3", "Figure 1: plot\ntext", "Bảng 2 kết quả", "word)      Next column of a page with text here\n" * 3, "😀 é naïve café",
    "<!-- c\nd -->\n### Head\n\n\n\n![cap](u) t", "rnns and LSTMs classes is", "Long-short term  Memory", "A.B, c!d (e)_f",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")


def column(df, c):
    return [r.v for r in df.select("k", c.alias("v")).orderBy("k").collect()]


def test_words_lines_strip(df):
    assert column(df, X.words("t")) == [t.split() for t in TEXTS]
    assert column(df, X.strip("t")) == [t.strip() for t in TEXTS]
    assert [[x for x in v if x] for v in column(df, X.lines("t"))] == [[x for x in t.splitlines() if x] for t in TEXTS]
    assert column(df, X.collapse("t")) == [" ".join(t.split()) for t in TEXTS]


def test_titles(df):
    def title(t):
        own = [x.strip() for x in t.splitlines()]
        for x in own:
            if x.startswith("#") and not (h := x.lstrip("#").strip()).startswith("![") and 3 < len(h) < 200:
                return h
        return next((x[:200] for x in own if len(x) > 3 and not x.startswith(("-", "*", "|", "![", "#"))), None)

    def norm(t):
        t = re.sub(r"[*_`#~]", "", t).lower().strip()
        return re.sub(r"^(\d+[.)]\s*|chapter\s+\d+\s*[:\-]?\s*)", "", t).strip()

    assert column(df, X.title_of("t")) == [title(t) for t in TEXTS]
    assert column(df, X.normalize_title("t")) == [norm(t) for t in TEXTS]
    assert column(df, X.strip_markdown("t")) == [re.sub(r"[*_`#~]", "", re.sub(r"!\[.*?\]\(.*?\)", "", t)).strip() for t in TEXTS]


def test_quality_and_tokens(df):
    def quality(t):
        w = t.split()
        if len(t.strip()) < 50:
            return "low_text"
        if len(w) >= 15 and sum(len(x) == 1 and x.isalpha() for x in w) / len(w) > 0.25:
            return "garbled"
        return "noisy" if w and sum(map(len, w)) / len(w) < 2 else "good"

    assert column(df, X.page_quality("t")) == [quality(t) for t in TEXTS]
    concept = lambda t: re.sub(r"\s+", " ", t.lower().strip().replace("-", " "))
    assert column(df, X.normalize_concept("t")) == [concept(t) for t in TEXTS]
    tokens = lambda t: {x.rstrip("s") if len(x) > 3 else x for x in re.findall(r"\w+", t)}
    assert [set(v) for v in column(df, X.tokens("t"))] == [tokens(t) for t in TEXTS]


def test_layout_flags(df):
    got = df.select("k", *[c.alias(n) for n, c in X.layout_flags("t", F.lit(True)).items()]).orderBy("k").collect()
    by = {TEXTS[r.k][:12]: r for r in got}
    assert by["| a | b |\n|-"].has_table and by["a  b  c\nd  e"].has_table and not by["Mục tiêu học"].has_table
    assert by["$$x^2$$ and "].has_formula and by["Figure 1: pl"].has_caption and by["Bảng 2 kết q"].has_caption
    assert by["word)      N"].has_columns and by["Figure 1: pl"].layout_sensitive


def test_grounding(spark):
    source = "The cell state flows through gates, and each gate decides what to keep."
    cases = [
        ("the cell state flows", True), ("completely invented words here now", False), ("cell state [...] gate decides", True), ("cell state [...] unknown stuff entirely", False),
        ("", False), (None, False), ("[...]", True), ("the cell state flows downhill", True),
    ]
    df = spark.createDataFrame([(k, e, source) for k, (e, _) in enumerate(cases)], "k int, e string, s string")
    got = [r.v for r in df.select("k", X.grounded("e", X.word_tokens("s")).alias("v")).orderBy("k").collect()]
    assert got == [g for _, g in cases]


def test_labels_and_sanitize(spark):
    rows = [("Lab 3: nets", True), ("Labelling data", False), ("hands-on", True), ("Course info & more", True), ("A syllabus.", True), ("notational", False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    assert column(df, X.has_label("t", SKIP_LABELS)) == [v for _, v in rows]
    df = spark.createDataFrame([(0, "a\x00b\n  c\td  " + "e" * 50), (1, None)], "k int, t string")
    assert column(df, X.sanitize("t", 10)) == ["ab c d eee", ""]
    df = spark.createDataFrame([(0, "The Distractor and KU from the source"), (1, None)], "k int, t string")
    assert column(df, X.sanitize_explanation("t")) == ["The lựa chọn chưa đúng and khái niệm from bài học", ""]


def test_page_label(spark):
    df = spark.createDataFrame([(0, [3, 1, 2, 7]), (1, [4]), (2, []), (3, [5, 6]), (4, [2, 2])], "k int, p array<int>")
    assert column(df, X.page_label(F.col("p"))) == ["Pages 1-3, 7", "Page 4", "", "Pages 5-6", "Page 2"]


def test_order_of_ids(spark):
    from lectern.operators.graph import by_number

    ids = ["seg_1000", "seg_999", "seg_012b", "seg_012a", "seg_002", "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ids)], "k int, t string")
    want = ["x", "seg_002", "seg_012a", "seg_012b", "seg_999", "seg_1000"]
    assert [r.t for r in df.orderBy(X.by_number("t")).collect()] == want == sorted(ids, key=by_number)


def test_flags(spark):
    from lectern.operators import generation, profile

    df = spark.createDataFrame([(0, "ab", "x" * 299), (1, "12. 3", "x" * 300), (2, "Figure 2", "x" * 12_001), (3, None, "")], "k int, t string, c string")
    flags = {k: column(df, v) for k, v in {**profile.title_flags("t"), **profile.chunk_flags("c")}.items()}
    assert flags["title_short"] == [True, False, False, True] and flags["title_numeric"] == [False, True, False, False]
    assert flags["title_caption"] == [False, False, True, False]
    assert flags["chunk_short"] == [True, False, False, True] and flags["chunk_long"] == [False, False, True, False]
    assert column(df, X.merged_flag(F.col("k") > 1, F.lit(None).cast("boolean"))) == [False, False, True, True]
    import hashlib

    assert column(df, generation.checkpoint_key("c")) == [hashlib.sha256(c.encode()).hexdigest()[:12] for c in ("x" * 299, "x" * 300, "x" * 12_001, "")]
