"""The similarity join and decontamination against brute force."""

import random

import numpy as np
import pytest
from lectern.llm import decontamination, jaccard_join

from .cases import SCHEMA, clashing, edge_rows, some_text, words


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    links = [[j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in links[i]:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    out = []
    for i, r in enumerate(rows):
        family = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((r[0], (min(family) if family else None) if sets[i] else r[0], len(links[i])))
    return sorted(out, key=str)


def mutated(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10_000)}"
    return " ".join(w)


@pytest.mark.parametrize("limit", [512, 6])
def test_join(spark, limit):
    rng = random.Random(limit)
    rows = [r for r in edge_rows() if r[0] is not None]
    base = [some_text(rng, 120, 3000) for _ in range(25)]
    texts = base + [mutated(rng, rng.choice(base), rng.randrange(0, 6)) for _ in range(60)]
    common = some_text(rng, 30, 3000)
    texts += [common + " " + some_text(rng, 60, 3000) for _ in range(25)]  # much in common, but not enough
    hot = some_text(rng, 200, 3000)
    texts += [mutated(rng, hot, 3) for _ in range(40)] + [hot] * 30
    rows += [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = jaccard_join.similar_documents(df, limit=limit)
    assert sorted(((r.id, r.class_id, r.n_links) for r in got.collect()), key=str) == brute(rows)


def test_join_repeated_ids(spark):
    """Rows of one id with other texts are compared by their texts."""
    rng = random.Random(2)
    a, b, c = (some_text(rng, 80, 3000) for _ in range(3))
    rows = [(7, a, None, None, None), (7, b, None, None, None), (8, mutated(rng, b, 1), None, None, None), (9, c, None, None, None), (9, c, None, None, None), (None, mutated(rng, c, 1), None, None, None)]
    got = sorted((r.id or 0, r.class_id, r.n_links) for r in jaccard_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 9, 2), (7, 7, 0), (7, 7, 1), (8, 7, 1), (9, 9, 2), (9, 9, 2)]


def test_join_null_ids_and_empty(spark):
    t = "a b c d e f g h i j"
    rows = [(None, t, None, None, None), (5, t, None, None, None), (None, None, None, None, None), (None, "lone words that are here alone", None, None, None)]
    got = sorted(((r.id, min(r.class_id or 0, 1 << 62), r.n_links) for r in jaccard_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 5, 1), (5, 5, 1), (None, 0, 0), (None, 1 << 62, 0)], key=str)
    assert jaccard_join.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_recall():
    r = jaccard_join.least_recall
    assert r(0.8, 8, 0, 0.8) > 0.9995 and r(0.8, 8, 1, 0.8) > r(0.8, 8, 2, 0.8) > 0.99 and r(0.8, 16, 2, 0.8) >= 0.999
    assert r(0.8, 8, 2, 0.8) < r(0.82, 8, 2, 0.8) < r(0.9, 8, 2, 0.8)
    # a draw of the process itself
    rng = random.Random(4)
    hits, rate = 0, jaccard_join._share(0.8) / (1 << 20)
    for _ in range(4000):
        same = [rng.random() < 0.8 for _ in range(64)]
        own = 0
        for k in rng.sample(range(64), 4):
            through = same[k]
            for _ in range(2):
                looked = [c for c in range(64) if rng.random() < rate] or [rng.randrange(64)]
                through = through and any(same[c] for c in looked)
            own += through
        hits += own > 0 and sum(same) >= 38.4
    assert abs(hits / 4000 - r(0.8, 4, 2, 0.8)) < 0.02


def test_recall_that_signatures_cannot_reach(spark):
    with pytest.raises(ValueError):
        jaccard_join.similar_documents(spark.createDataFrame([], SCHEMA), recall=0.99999)


def test_links_of_crowded_buckets(spark):
    """Documents of one template, some of them near copies just above the threshold: splits lose none of them."""
    rng = random.Random(21)
    common = some_text(rng, 55, 3000)
    base = [common + " " + some_text(rng, 45, 3000) for _ in range(60)]
    texts = base + [mutated(rng, t, 2) for t in base]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, SCHEMA), limit=8).collect()
    assert sorted(((r.id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def align(item, doc):
    best = 0
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(doc, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def fold(text):
    return "".join(" " if c.isascii() and not c.isalnum() and 32 < ord(c) < 127 else c.lower() if c.isascii() else c for c in text or "")


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, some_text(rng, n, 5000).replace("\n", " ")) for k, n in enumerate([40, 25, 60, 12, 8, 33])] + [(90, "to be"), (91, None), (None, ""), (92, "Alpha, beta: gamma delta epsilon!")]
    rows = [r for r in edge_rows() if r[1] is None or len(words(r[1])) < 1000]
    for k, (_, t) in enumerate(items[:6]):
        w = t.split()
        for share in (0, 0.1, 0.25):
            copy = [x if rng.random() >= share else rng.choice(["", "other", x + " more"]) for x in w]
            text = some_text(rng, 80, 5000) + " " + " ".join(copy).upper() + ". " + some_text(rng, 80, 5000)
            rows.append((500 + 10 * k + int(share * 20), text, "en", "s", len(text)))
    rows.append((900, "x alpha beta gamma delta epsilon y", "en", "s", 1))
    rows.append((901, "x alpha beta gamma delta", "en", "s", 1))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for r in rows:
        for i, t in items:
            w = words(fold(t))
            if len(w) >= 3:
                s = align(w, words(fold(r[1])))
                if s >= decontamination.needed(len(w), decontamination.LEAST):
                    want[r[0], i] = round(s / (2 * len(w)), 6)
    got = {(r.id, r.item_id): (round(r.score, 6), r.begin_word, r.end_word) for r in decontamination.contaminated(clashing(docs), bench).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert len(want) >= 15
    for (i, k), (score, a, b) in got.items():
        if score == 1:
            text = next(r[1] for r in rows if r[0] == i)
            assert words(fold(text))[a:b] == words(fold(dict(items)[k]))
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if not any(k[0] == r[0] for k in want))


def test_decontamination_empty(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(spark.createDataFrame(edge_rows(), SCHEMA), items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    rng = random.Random(1)
    items = [(k, some_text(rng, 30, 5000)) for k in range(7)]
    docs = [(k, some_text(rng, 50, 5000) + " " + t, "en", "s", 0) for k, t in items]
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item_id) for r in got) == [(k, k) for k in range(7)]


def test_common_seeds_count_together(spark, monkeypatch):
    """Half of an item is in many documents, the other half's seeds are rare; the many are found all the same."""
    for name, value in (("RARE", 1), ("RARE_SHARE", 0), ("RARE_TIMES", 1)):
        monkeypatch.setattr(decontamination, name, value)
    rng = random.Random(3)
    item = some_text(rng, 40, 5000).split()
    docs = [(k, some_text(rng, 60, 5000) + " " + " ".join(item[:20]), "en", "s", 0) for k in range(30)]
    docs += [(100 + k, some_text(rng, 60, 5000) + " " + " ".join(item[20 + k : 23 + k]), "en", "s", 0) for k in range(16)]
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.id for r in got) == list(range(30))


def test_upper_case_beyond_ascii(spark):
    items = [
        (1, "Où était né l’élève égaré à Orléans, près du théâtre où l’été s’achève déjà après trois années?"),
        (2, "¿Cuál año señaló él, según la opinión del niño, más allá de aquí y después así?"),
        (3, "Große Bäume müssen täglich genügend Wärme für süße Früchte über Füße schöner Höfe hinaus führen"),
        (4, "Какая река течёт через город Ярославль и впадает в Каспийское море на юге страны"),
    ]
    rng = random.Random(6)
    docs = [(10 * k + j, some_text(rng, 60, 5000) + " " + change(t) + " " + some_text(rng, 60, 5000), "fr", "s", 0) for k, t in items for j, change in enumerate((str, str.upper, str.lower, str.title))]
    docs.append((99, some_text(rng, 60, 5000), "fr", "s", 0))
    docs, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.id, r.item_id): r.score for r in got} == {(10 * k + j, k): 1.0 for k, _ in items for j in range(4)}
    assert [r.doc_id for r in decontamination.clean_documents(docs, bench).collect()] == [99]


def test_scripts_without_spaces(spark):
    rng = random.Random(8)
    kanji = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    items = [(1, kanji(30) + "。"), (2, "ประเทศไทยมีเมืองหลวงชื่อว่ากรุงเทพมหานคร")]
    docs = [(10, kanji(200) + items[0][1] + kanji(100), "ja", "s", 0), (11, kanji(300), "ja", "s", 0), (12, "ก" * 20 + items[1][1], "th", "s", 0)]
    docs.append((13, kanji(50) + items[0][1][:10] + kanji(1) + items[0][1][11:20] + kanji(50), "ja", "s", 0))
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in got} == {(10, 1), (12, 2), (13, 1)} and {r.score for r in got if r.id != 13} == {1.0}


def _stems(n):
    rng = random.Random(5)
    stem = "which of the following statements is true about the"
    return [(k, f"{stem} {some_text(rng, 9, 5000)}".replace("\n", " ")) for k in range(n)]


def test_shared_stems(spark):
    """Items that begin alike are told apart, and a stem alone is no item; equal items are found together."""
    items = _stems(300) + [(1000, _stems(1)[0][1].upper())]
    rng = random.Random(6)
    docs = [(k, some_text(rng, 40, 5000) + " " + t + " " + some_text(rng, 40, 5000), "en", "s", 0) for k, t in items[:20]]
    docs += [(500 + k, "which of the following statements is true about the " + some_text(rng, 60, 5000).replace("w", "v"), "en", "s", 0) for k in range(200)]
    got = decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in got if r.score == 1} == {(k, k) for k in range(20)} | {(0, 1000)}
    assert not [r for r in got if r.id >= 500]


def test_work_does_not_grow_with_shared_stems():
    """Documents that have the stem of all items: as many passages for 2000 items as for 250."""
    from lectern.llm import kernel
    import pyarrow as pa

    rng = random.Random(7)
    texts = pa.array([some_text(rng, 30, 5000) + " which of the following statements is true about the " + some_text(rng, 30, 5000) for _ in range(400)])
    n = []
    for m in (250, 2000):
        items = _stems(m)
        seeds = decontamination.Seeds([i for i, _ in items], [t for _, t in items])
        _, _, block = next(kernel.blocks(texts))
        names, at = decontamination.folded(block).grams(3)
        n.append(len(decontamination._passages(seeds, np.ones(len(seeds.of), bool), names, at)[0]))
    assert n[1] <= n[0] + 400


def test_long_items(spark):
    """Items of thousands of words are aligned in a band."""
    rng = random.Random(10)
    item = some_text(rng, 4000, 5000).replace("\n", " ").split()
    docs = [
        (1, " ".join(item), "en", "s", 0),
        (2, some_text(rng, 500, 5000) + " " + " ".join(w for w in item if rng.random() > 0.01), "en", "s", 0),
        (3, some_text(rng, 5000, 5000), "en", "s", 0),
        (4, " ".join(item[:800]), "en", "s", 0),
    ]
    got = {r.id: r.score for r in decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1] == 1 and got[2] > 0.9


def test_band_equals_the_whole_alignment():
    rng = np.random.default_rng(3)
    for m in (3, 8, 20, 60):
        slack = decontamination.cell(m)[1]
        item = rng.integers(1, 40, m).astype(np.uint64)
        rows = rng.integers(1, 40, (12, m + 2 * slack)).astype(np.uint64)
        for k in range(12):
            copy = [w for w in item if rng.random() > 0.15][: m]
            rows[k, slack : slack + len(copy)] = copy
        best, end = decontamination.best_alignments(item, rows)
        assert [align(list(item), list(r)) for r in rows] == list(best)
        assert all(align(list(item), list(r[:e])) == b for r, e, b in zip(rows, end, best, strict=True))


def test_recall_by_edits(spark):
    """Copies of items of 20 to 60 words with a share of words replaced, dropped or doubled: the README's figures."""
    rng = random.Random(23)
    items = [(k, some_text(rng, rng.randrange(20, 60), 5000).replace("\n", " ")) for k in range(120)]
    rates, docs = (0.1, 0.2, 0.3, 0.4), []
    for i, t in items:
        for j, rate in enumerate(rates):
            copy = [x if rng.random() >= rate else rng.choice(["", f"z{rng.randrange(9999)}", x + " more"]) for x in t.split()]
            docs.append((10 * i + j, some_text(rng, 50, 5000) + " " + " ".join(copy) + " " + some_text(rng, 50, 5000), "en", "s", 0))
    got = {(r.id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = [sum((10 * i + j, i) in got for i, _ in items) / len(items) for j in range(4)]
    print("recall by edits", dict(zip(rates, recall, strict=True)))
    assert recall[0] == 1 and recall[1] >= 0.99 and recall[2] >= 0.95 and recall[3] >= 0.8
    assert all(d // 10 == i for d, i in got)


def test_edited_copies_of_short_items(spark):
    rng = random.Random(17)
    items = [(100 * m + k, some_text(rng, m, 5000).replace("\n", " ")) for m in (8, 10, 12, 15, 18, 20) for k in range(20)]
    docs = []
    for i, t in items:
        for j, n in enumerate((len(t.split()) // 4, len(t.split()) // 3)):
            w = t.split()
            for at in rng.sample(range(len(w)), n):
                w[at] = f"z{rng.randrange(10_000)}"
            docs.append((10 * i + j, "a b c d e f " + " ".join(w) + " g h i j k l", "en", "s", 0))
        w = t.split()
        docs.append((10 * i + 8, "a b c d e f " + " ".join(w[2 : 8 if len(w) > 12 else 6]) + " g h i j k l", "en", "s", 0))
    got = {r.id for r in decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for m in (8, 10, 12, 15, 18, 20):
        for j in range(2):
            assert sum(10 * (100 * m + k) + j in got for k in range(20)) >= 18, (m, j)
    assert not any(i % 10 == 8 for i in got)  # four words of a short item, six of a longer one, may be chance
