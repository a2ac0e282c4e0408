"""The pipeline's stages against plain versions, each on its own input."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from lectern.llm import decontamination

from .cases import SCHEMA, clashing, edge_rows, some_text, words
from .test_pairs import align, brute, fold, mutated
from .test_rows import keeps


def test_stages(spark, tmp_path):
    """Rows with nulls, repeated and missing ids, very long texts, and columns of every name that operators use."""
    rng = random.Random(12)
    items = [(k, some_text(rng, 30, 4000)) for k in range(4)]
    base = [some_text(rng, rng.randrange(60, 160), 4000) for _ in range(40)]
    texts = base + [mutated(rng, rng.choice(base), 2) for _ in range(20)] + base[:6] + [base[7] + " " + items[1][1], some_text(rng, 70, 4000) + " " + items[2][1]]
    rows = edge_rows() + [(100 + k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(100, some_text(rng, 90, 4000), "fr", None, None), (None, base[9], None, "s1", None), (None, mutated(rng, base[9], 1), None, "s1", None), (None, some_text(rng, 80, 4000), "en", "s2", 5)]
    spelt = str.maketrans("0123456789", "aeioutnslr")  # more letters than the w of all words
    rows += [(300, some_text(rng, 40_000, 3000).translate(spelt) + " " + items[3][1], "en", "s1", 0), (301, some_text(rng, 40_000, 30_000).translate(spelt), "en", "s2", 0)]
    wide = clashing(spark.createDataFrame(rows, SCHEMA))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, extra = docs.columns, docs.columns[5:]
    values = tuple(docs.first()[c] for c in extra)
    as_rows = lambda df: [tuple(r[c] for c in columns[:5]) for r in df.collect()]
    now = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = clashing(spark.createDataFrame(now, SCHEMA)).select(*columns)
        out = stage(spark, before, str(tmp_path))
        if k < 4:
            assert out.columns == columns, name
            assert {tuple(r[c] for c in extra) for r in out.collect()} == {values}, name
        got = as_rows(out)
        if k == 0:
            assert sorted(map(str, got)) == sorted(str(r) for r in now if keeps(r[1]))
        if k == 1:
            # by row numbers, as ids are not unique
            classes = brute([(n, *r[1:]) for n, r in enumerate(now)])
            groups = defaultdict(list)
            for n, c, _ in classes:
                groups[c].append(now[n])
            first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert sorted((str(r[0]) for r in got)) == sorted(str(r[0]) for r in first) and len(got) < len(now)
            texts_of = [{r[1] for r in g if r[0] == min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]} for g in groups.values()]
            assert all(any(r[1] in t for t in texts_of) for r in got)
        if k == 2:
            leaks = lambda t: any(align(w := words(fold(x)), words(fold(t))) >= decontamination.needed(len(w), decontamination.LEAST) for _, x in items)
            want = [r for r in now if r[0] not in (300, 301) and not leaks(r[1])] + [r for r in now if r[0] == 301]
            assert sorted(map(str, got)) == sorted(map(str, want))
            assert len(got) < len(now) and any(r[0] == 301 for r in got)
        if k == 3:
            sizes, taken = Counter(), Counter()
            for r in now:
                sizes[r[3]] += len(words(r[1]))
            for r in got:
                taken[r[3]] += len(words(r[1]))
                assert r[4] == len(r[1])
            assert 1.4 * sum(sizes.values()) < sum(taken.values()) <= 1.5 * sum(sizes.values())
            assert all(taken[s] <= 2 * sizes[s] for s in sizes)
        if k == 4:
            assert len(got) == len(now) and {r.shard for r in out.collect()} <= set(range(16))
            kept = [c + "_" if c + "_" in out.columns else c for c in extra]
            assert {tuple(r[c] for c in kept) for r in out.collect()} == {values}
        now = got
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in whole) == sorted((str(r[0]), r[1]) for r in now)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_without_unique_ids(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d = (some_text(rng, 120, 4000) for _ in range(4))
    near = lambda t: mutated(rng, t, 1)
    rows = [(None, t, "en", "s", len(t)) for t in (a, a, near(a), b, near(b), "", "")]
    rows += [(7, t, "en", "s", len(t)) for t in (b, c, d, d, "", "")] + [(3, t, "en", "s", len(t)) for t in (near(c),)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    ids = Counter((r.doc_id, r.text) for r in got)
    assert [sum(n for (i, t), n in ids.items() if i is None and t in {x[1] for x in rows[:3]}), len(got)] == [1, 7]
    assert ids[7, b] == ids[7, d] == ids[7, ""] == ids[3, rows[-1][1]] == 1 and ids[None, ""] == 2 and not ids[7, c]
