"""Comparisons of the word sets of a document's pages, spread over tasks: twins among the last kept pages, and overlaps.

Words are compared by 64-bit hashes. A document of any number of pages is cut where what went before no longer counts, or
into blocks with a few pages before each; only slim rows (page, flags, two numbers) of a whole document meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.sources.tables import staged

#: Pages of a block whose overlaps one group compares.
BLOCK = 256
_SETS = "doc_id", "page_num", "w"


def word_sets(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, w): the sorted hashes of each page's different words, written once."""
    w = F.array_sort(F.transform(X.word_set(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)))
    return staged(pages.select("doc_id", "page_num", w.alias("w")), "sets")


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num"), how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; keys come from the left."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return met.drop(*[f"_r_{k}" for k in keys])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of different values; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _rows(batch: pa.RecordBatch, column: str = "w") -> list[np.ndarray]:
    lists = batch.column(column)
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    at = at - at[0]
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _marks(least: float):
    """Emits for each page the hashes of the parts of its words; two pages more similar than `least` share one.

    Sets that similar differ in fewer than (1 - least) / least words for each word of the smaller, so if words are dealt
    into more parts than that, by hash, one part at least is equal. The number of parts goes by classes of size; a set
    whose twin may be of the next class is dealt for both.
    """
    most = (1 - least) / least
    bounds = np.unique(np.ceil(20 * 1.25 ** np.arange(80)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            size = np.diff(at)
            own = np.searchsorted(bounds, size, "right")
            above = np.searchsorted(bounds, np.floor(size / least + 1e-6).astype(np.int64), "right")
            pages, marks = [], []
            for level, who in ((own, size > 0), (own + 1, (size > 0) & (above > own))):
                rows = np.flatnonzero(who)
                if not len(rows):
                    continue
                parts = np.floor(bounds[level[rows]] * most + 1e-6).astype(np.int64) + 1
                first = np.concatenate(([0], np.cumsum(parts)))
                words = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
                of = np.repeat(np.arange(len(rows)), size[rows])
                part = (flat[words] % parts[of].astype(np.uint64)).astype(np.int64)
                sums = np.zeros(first[-1], np.uint64)
                np.add.at(sums, first[of] + part, flat[words])
                page = np.repeat(np.arange(len(rows)), parts)
                name = (level[rows][page].astype(np.uint64) << np.uint64(32)) + (np.arange(first[-1]) - first[page]).astype(np.uint64)
                marks.append((sums + name) * np.uint64(0x9E3779B97F4A7C15) ^ (name * np.uint64(0xC2B2AE3D27D4EB4F)))
                pages.append(rows[page])
            if pages:
                take = pa.array(np.concatenate(pages))
                columns = [batch.column("doc_id").take(take), batch.column("page_num").take(take), pa.array(np.concatenate(marks).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_num", "mark"])

    return run


def _dropped(least: float, keep_last: int):
    """Goes through the stretches of pages in order and gives the pages that are twins of one of the last kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, []
        for batch in batches:
            stretch = list(zip(batch.column("doc_id").to_pylist(), batch.column("stretch").to_pylist(), strict=True))
            out = []
            for k, (w, linked) in enumerate(zip(_rows(batch), batch.column("linked").to_pylist(), strict=True)):
                if stretch[k] != at:
                    at, last = stretch[k], []
                if linked and any(jaccard(w, s) > least for s in last):
                    out.append(k)
                else:
                    last = [*last, w.copy()][-keep_last:]
            if out:
                yield batch.select(["doc_id", "page_num"]).take(pa.array(out))

    return run


def twins(pages: DataFrame, least: float, keep_last: int = 3) -> DataFrame:
    """(doc_id, page_num) of pages more similar than `least` to one of the last `keep_last` kept pages of their document.

    A page that shares no mark with an earlier one is kept, whatever came before (free); one with the words of the page
    just before it is dropped and changes nothing. Behind keep_last free pages it is known which pages were kept last, so
    a document falls into stretches there; those with other pages are gone through, each with the pages before it.
    """
    sets = word_sets(pages)
    kinds = [T.StructField(f.name, f.dataType) for f in sets.schema if f.name != "w"]
    marks = sets.mapInArrow(_marks(least), T.StructType([*kinds, T.StructField("mark", T.LongType())]))
    again = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("page_num"))
    linked = marks.withColumn("n", again).where("n > 1").select("doc_id", "page_num").distinct().withColumn("linked", F.lit(True))
    order = Window.partitionBy("doc_id").orderBy("page_num")
    slim = sets.select("doc_id", "page_num", F.xxhash64("w").alias("h"), (F.size("w") > 0).alias("some"))
    slim = slim.select("doc_id", "page_num", F.coalesce(F.col("some") & (F.col("h") == F.lag("h").over(order)), F.lit(False)).alias("repeat"))
    slim = staged(joined(slim, linked, how="left").withColumn("linked", F.coalesce("linked", F.lit(False))), "flags")
    rows = slim.where("NOT repeat")
    free = [F.coalesce(F.lag((~F.col("linked")).cast("int"), k).over(order), F.lit(0)) for k in range(1, keep_last + 1)]
    rows = rows.withColumn("opens", sum(free[1:], free[0]) == keep_last)
    rows = rows.withColumn("stretch", F.sum(F.col("opens").cast("int")).over(order))
    whole = Window.partitionBy("doc_id", "stretch")
    before = F.array_compact(F.array(*[F.when(F.lead(F.col("opens") & F.col("linked"), k).over(order), F.lead("stretch", k).over(order)) for k in range(1, keep_last + 1)]))
    rows = rows.withColumn("_before", before).withColumn("_todo", F.max("linked").over(whole))
    own = F.when(F.col("_todo"), F.array(F.struct("stretch", "linked"))).otherwise(F.array().cast("array<struct<stretch:bigint,linked:boolean>>"))
    all_of = F.concat(own, F.transform("_before", lambda s: F.struct(s.alias("stretch"), F.lit(False).alias("linked"))))
    sent = joined(rows.select("doc_id", "page_num", F.inline(all_of)), sets)
    sent = sent.select(*_SETS, "stretch", "linked").repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "page_num")
    found = sent.mapInArrow(_dropped(least, keep_last), T.StructType(kinds))
    return slim.where("repeat").select("doc_id", "page_num").unionByName(found)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s1 and s2 of the pages of each block, of which the two before come first."""
    at, last = None, []
    for batch in batches:
        block = list(zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), strict=True))
        head = batch.column("head").to_pylist()
        one, two, out = [], [], []
        for k, w in enumerate(_rows(batch)):
            if block[k] != at:
                at, last = block[k], []
            if not head[k]:
                out.append(k)
                one.append(jaccard(last[-1], w) if last else 0.0)
                two.append(jaccard(np.union1d(last[-2], last[-1]), w) if len(last) > 1 else one[-1])
            last = [*last, w.copy()][-2:]
        if out:
            kept = batch.select(["doc_id", "page_num"]).take(pa.array(out))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(one, pa.float64()), pa.array(two, pa.float64())], names=["doc_id", "page_num", "s1", "s2"])


def overlaps(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, s1, s2): Jaccard of each page's words with those of the page before and of the two before."""
    sets = word_sets(pages)
    kinds = [T.StructField(f.name, f.dataType) for f in sets.schema if f.name != "w"]
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num")) - 1
    block = F.floor(F.col("n") / BLOCK)
    blocks = F.array(F.struct(block.alias("block"), F.lit(False).alias("head")), F.when(F.col("n") % BLOCK >= BLOCK - 2, F.struct((block + 1).alias("block"), F.lit(True).alias("head"))))
    slim = sets.select("doc_id", "page_num").withColumn("n", n).select("doc_id", "page_num", F.inline(F.array_compact(blocks)))
    rows = joined(slim, sets).select(*_SETS, "block", "head").repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "page_num")
    return rows.mapInArrow(_overlaps, T.StructType([*kinds, T.StructField("s1", T.DoubleType()), T.StructField("s2", T.DoubleType())]))


def overlap_groups(pages: DataFrame, max_pages: int, least: float) -> DataFrame:
    """(doc_id, page_num, grp): pages go on with a group of fewer than max_pages if they overlap its last two by `least`."""
    found = overlaps(pages)
    schema = T.StructType([*found.schema.fields[:2], T.StructField("grp", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, grp, first = None, 0, 0, True
        for batch in batches:
            out = []
            for doc, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "s1", "s2")), strict=True):
                if first or doc != at:
                    at, n, grp, first = doc, 0, 0, False
                if 0 < n < max_pages and (s1 if n == 1 else s2) >= least:
                    n += 1
                else:
                    n, grp = 1, grp + 1
                out.append(grp)
            kept = batch.select(["doc_id", "page_num"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=["doc_id", "page_num", "grp"])

    return staged(found.repartition("doc_id").sortWithinPartitions("doc_id", "page_num").mapInArrow(run, schema), "groups")
