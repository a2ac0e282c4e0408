"""Spelling variants and periodic runs against plain versions, toxicity on texts written for it and on held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import periodic_runs, registry, spelling_variants, toxicity

from .cases import SCHEMA, clashing, edge_rows, words


# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(count, times=2):
    form, out = {}, []
    for w, n in count.items():
        own = [x for x in count if near(w, x)]
        best = min(own, key=lambda x: (-count[x], x), default=None)
        form[w] = (best if best and count[best] >= times * n else None, len(own))
    for w, n in count.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][1], count[form[w][0]] if form[w][0] else None))
    return sorted(out)


def variants_of(spark, count, **more):
    got = spelling_variants.spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long"), **more)
    return sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_near_words(spark):
    rng = random.Random(3)
    alphabet = "abcé"  # few letters: large classes of anagrams
    count = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 8))): rng.randrange(3, 60) for _ in range(500)}
    count |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "x" * 300: 3, "x" * 299 + "y": 6, "x" * 301: 6, "x" * 65: 3, "x" * 64: 6, "x" * 63: 12, "ÀÀÀÀÀ": 3, "ààààà": 9, "theses": 5, "thesse": 50}
    got = variants_of(spark, count)
    assert got == plain_variants(count)
    assert variants_of(spark, count, times=5) == plain_variants(count, 5)
    assert variants_of(spark, {"alone": 4}) == [("alone", None, "alone", 4, 0, None)]
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_one_class_of_very_many_words(spark):
    """All orders of seven letters: one key, no near words, and no pairs on the way."""
    from itertools import permutations

    count = {"".join(p): 3 + k % 7 for k, p in enumerate(permutations("abcdefg"))}
    assert all(r[1:3] == (None, r[0]) and r[4] == 0 for r in variants_of(spark, count))


def plain_count(rows, least=3, plant=True):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if plant and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= least}


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_word_counts(spark, monkeypatch, chunk):
    assert ["".join(spelling_variants._parts("ab" * 30 + " x")), *spelling_variants._parts("")] == ["ab" * 30 + " x", ""]
    monkeypatch.setattr(spelling_variants, "CHUNK", chunk)
    text = " ".join(["Wörter ÀBCDE", "x" * 40, "kürzer5letters", "a×b÷cdef", ""] * 3)
    assert Counter(w for p in spelling_variants._parts(text) for w in re.findall("[A-Za-zÀ-ÿ]{5,}", p)) == Counter(re.findall("[A-Za-zÀ-ÿ]{5,}", text))
    rows = [(r[0], r[1]) for r in edge_rows()] + [(k, f"Theses words Wörter ÀBCDE wörter w{'o' * k}rds") for k in range(200)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.word: r.n for r in spelling_variants.word_counts(docs, alter=spelling_variants.altered).collect()}
    assert got == plain_count(rows)
    assert {r.word: r.n for r in spelling_variants.word_counts(docs).collect()} == plain_count(rows, plant=False)
    assert spelling_variants.word_counts(docs.limit(0)).count() == 0


def test_variants_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cols = "word, form, root, n, n_near, form_n"
    want = sorted(con.execute(f"SELECT {cols} FROM ({spelling_variants.SQL})").fetchall())
    got = sorted(map(tuple, registry.QUERIES["op11_spelling_variants"](spark, sf_dir).select(*cols.split(", ")).collect()))
    assert got == want and len(got) > 1000
    count = plain_count(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {(w, n) for w, _, _, n, _, _ in got} == set(count.items())


# periodic runs


def plain_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        while len(w) < rng.randrange(1, 300):
            if rng.random() < 0.5:
                piece = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
                w += (piece * rng.randrange(1, 12))[: rng.randrange(1, 150)]
            else:
                w += [rng.randrange(rng.choice([2, 5, 300])) for _ in range(rng.randrange(30))]
        yield w


@pytest.mark.parametrize("portion", [5, 1 << 20])
def test_runs_of_blocks(monkeypatch, portion):
    monkeypatch.setattr(periodic_runs, "PORTION", portion)
    texts = [*periodic_texts(1, 150 if portion > 5 else 30), [0] * 500, [0, 1] * 200 + [0], [], [3] * 23, [3] * 24]
    rng = random.Random(2)
    for lo in range(0, len(texts), 4):
        some = texts[lo : lo + rng.randrange(1, 5)]
        names, at = np.array([x for t in some for x in t], np.int64), np.cumsum([0] + [len(t) for t in some])
        for least, times in ((24, 3), (40, 5)):
            text, *columns = periodic_runs._of_block(names, at, least, times)
            got = [[tuple(map(int, r[1:])) for r in zip(text, *columns, strict=True) if r[0] == k] for k in range(len(some))]
            assert got == [plain_runs(t, least, times) for t in some]


def test_blocks_recur_only_at_odd_places():
    """A run that no block boundary meets, and blocks that recur in different texts alone."""
    once = list(range(40))
    names, at = np.array(once + once, np.int64), np.array([0, 40, 80])
    assert not periodic_runs._recurring(names, at).any()
    assert periodic_runs._recurring(np.array(once + once[3:11], np.int64), np.array([0, 48])).all()


def test_periodic_runs(spark):
    texts = [None, "", " \n ", "one", " \t" + "a b\x0bc\n" * 9 + "d", "a " * 100, "x" * 30_000, *(" ".join(map(str, w)) for w in periodic_texts(7, 40))]
    rows = [(k, t, None, "s", None) for k, t in enumerate(texts)] + [(None, texts[5], None, None, None), (6, texts[6], None, "s", None)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("runs", F.lit("mine")).withColumn("Collapsed", F.lit(5))
    got = periodic_runs.periodic_runs(docs)
    assert {"runs", "runs_", "Collapsed_", "collapsed"} <= set(got.columns) and len(got.columns) == len(docs.columns) + 3
    out = defaultdict(list)
    for r in got.select("text", "n_words", "runs", "collapsed", "runs_", "Collapsed_", "b").collect():
        out[r.text].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
        assert (r["runs_"], r["Collapsed_"]) == ("mine", 5)
    assert sum(map(len, out.values())) == len(rows)
    for text, found in out.items():
        w = words(text)
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert all(x == (len(w), runs, " ".join(v for k, v in enumerate(w) if k not in gone)) for x in found)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least=20)


def test_periodic_query(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = [(10**6 + k, f"w{k} " + "a b c " * (k % 40)) for k in range(120)] + [(10**7, None), (10**7 + 1, ""), (None, "a b " * 30)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    found = planted = 0
    for r in registry.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        w = words(text[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g, planted = h // 10, planted + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        if len(w) > 3000:
            continue
        runs = plain_runs(w)
        found += bool(runs)
        s, n, q = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        gone = {k for s_, n_, q_ in runs for k in range(s_ + q_, s_ + n_)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(r)[1:] == (len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(v for k, v in enumerate(w) if k not in gone)))
    assert found > 30 and planted > 10


# toxicity


def toxic_rows(seed=5, n=1200):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeou") for _ in range(rng.randrange(2, 5)))
    rows = []
    for k in range(n):
        toxic = k % 6 == 0
        w = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorkling", "Blagh", "vexu" + word()]))
        if not toxic and rng.random() < 0.06:
            w.insert(rng.randrange(len(w)), "harmless zorkling")
        rows.append((k, " ".join(w), toxic))
    return rows


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, _, t in rows] + [(None, 1), (7, None), (10**9, 1), (6, 1)], "doc_id long, toxic int")
    return toxicity.fitted(docs, labels)


def test_lexicon(lexicon):
    assert {"blagh", "vexu*"} <= set(lexicon.weights) and any(e.startswith("zork") for e in lexicon.weights)
    assert ("harmless", "zorkling") in lexicon.phrases
    score = lexicon.score
    low = score("bado cuga fedo")
    assert score("") == low or score("") < 0.2
    assert score("harmless zorkling bado cuga") < 0.2 < 0.8 < score("zorkling and blagh vexuba gado")
    for text in ("ZORKLING and BLAGH vexuba", "z0rkl1ng and 8lagh bl4gh vexu7o", "zоrkling and ｂｌａｇｈ vеxuba", "zörkling ànd blâgh vexuba"):
        assert score(text) > 0.8, text
    assert score("blaghx xblagh azorklinga") < 0.2  # no words of the lexicon
    assert score("zorkling blagh") > score("zorkling blagh " + "bado " * 2000)  # by length
    assert 0 <= score("blagh " * 100_000) <= 1 and score("bado " * 300_000 + "blagh vexuba zorkling") > score("bado " * 300_000)


def test_folds():
    assert toxicity.fold("Ｆｕｌｌ Сорe 1d10t b@d3 1234 x1 $cum to$$$ 4me É") == "full cope idiot bad3 1234 x1 scum to$$$ ame é"
    assert all(len(toxicity.fold(t)) == len(t.lower()) for _, t, *_ in edge_rows() if t)
    assert "".join(toxicity.chunks("ab cd\n" * 10)) == "ab cd\n" * 10


def test_long_texts_are_cut_between_words(lexicon, monkeypatch):
    text = "bado blagh vexuba cuga " * 50
    whole = lexicon.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert lexicon.features(text)[0] == whole[0] and len(list(toxicity.chunks(text))) > 10


def test_scores(spark, lexicon):
    rows = edge_rows()
    got = toxicity.scored(clashing(spark.createDataFrame(rows, SCHEMA)), lexicon).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert Counter((r.doc_id, r.score) for r in got) == Counter((i, lexicon.score(t or "")) for i, t, *_ in rows)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fitted(docs, labels).score("idiot") == 0
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
    only = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.fitted(docs, only).score("x") == 1


def test_held_out_accuracy(spark):
    """Over sf0.01: of the English rows that nothing was learned from, toxic ones are found and others left alone."""
    con, folder = duckdb.connect(), "/root/testdata/sf0.01"
    labels = dict(con.execute(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    lang = dict(con.execute(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    got = registry.QUERIES["op12_toxicity"](spark, folder).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == toxicity.held_out(r.doc_id) and r.predicted == int(r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels and lang[r.doc_id] == "en"]
    assert sum(p for t, p in held if t) >= 0.75 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 0.05 * len(held)
