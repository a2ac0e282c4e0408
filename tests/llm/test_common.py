import random

import pytest

from lectern.llm import common
from lectern.llm.common import components, gapless, join_hot, n_words, ranked, scratch, written
from pyspark.sql import functions as F

from .cases import edge_rows, SCHEMA, words


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (1000, 1001), (1001, 1000)] + [(2000, 2000 + k) for k in range(300)] + [(3000 + k, 3001 + k) for k in range(60)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_n_words(spark):
    rows = edge_rows()
    got = spark.createDataFrame(rows, SCHEMA).select("text", n_words("text").alias("n")).collect()
    assert [r.n for r in got] == [len(words(r.text)) for r in got]


def test_gapless(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = gapless(df, ["g"], F.xxhash64("id"), "slot", 16).collect()
    for g in range(3):
        own = sorted(r.slot for r in got if r.g == g)
        assert own == list(range(len(own)))
    assert len(got) == 1000


def test_gapless_with_weights(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 5 + 1).alias("w"))
    got = gapless(df, ["g"], F.xxhash64("id"), "at", 16, weight="w").collect()
    for g in range(2):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r["at"]):
            assert r["at"] == at
            at += r.w


def test_ranked(spark):
    rng = random.Random(1)
    names = rng.sample([f"n{k}" for k in range(5000)], 700)
    got = ranked(spark.createDataFrame([(x,) for x in names], "x string"), ["x"], "place").collect()
    assert {r.x: r.place for r in got} == {x: k for k, x in enumerate(sorted(names))}


def test_join_hot(spark):
    """Hot and other keys, and rows whose key the table lacks."""
    rows = spark.createDataFrame([(k % 7 if k < 900 else k, k) for k in range(1000)], "key long, v long")
    table = rows.where("key < 950").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for how, n in (("inner", 950), ("left", 1000)):
        for total in (1000, 10**6):
            got = join_hot(rows, table, "key", "n", total, how).collect()
            assert len({r.v for r in got}) == len(got) == n
            assert all(r.n == (1 if r.key >= 900 else 129 if r.key < 4 else 128) for r in got if r.key < 950)


def test_keys_are_unique(spark, tmp_path):
    """Also where file and place are not: in joined, exploded, repeated and united rows. The same in each reading."""
    path = f"{tmp_path}/t"
    spark.range(40).select("id", F.concat(F.lit("a "), "id").alias("text")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    two = spark.createDataFrame([(1,), (2,)], "k int")
    frames = {
        "read": (df, 40), "filtered": (df.where("id % 2 = 0").select("text").withColumn("x", F.lit(1)), 20),
        "joined": (df.crossJoin(two), 80), "exploded": (df.select("*", F.explode(F.split("text", " ")).alias("w")), 80), "united": (df.union(df), 80),
        "sampled": (df.sample(True, 3.0, seed=5), None), "made": (two, 2), "grouped": (df.groupBy((F.col("id") % 4).alias("g")).count(), 4), "view": (df, 40),
    }
    df.createOrReplaceTempView("keys_view")
    frames["view"] = (spark.sql("SELECT text FROM keys_view WHERE id >= 0"), 40)
    for name, (frame, n) in frames.items():
        keyed = common.with_key(frame, "key")
        keys = sorted(r["key"] for r in keyed.collect())
        assert len(set(keys)) == len(keys) and len(keys) == (n or len(keys)) and keys == sorted(r["key"] for r in keyed.collect()), name


def test_scratch(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file://") + "/lectern"
    outside = written(spark.range(3), "outside")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert written(spark.range(3), "x").count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before and outside.count() == 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
