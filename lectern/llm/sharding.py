"""Sharding: documents into shards of near equal bytes, groups of equal texts kept together.

Method: longest-processing-time scheduling. Groups of equal texts, sorted by size, largest first, go one by one to the
shard with the least load, through a heap. Groups of one size are interchangeable, so the schedule runs over sizes with
the number of groups that have them, and tells how many of them each shard gets; where many groups have one size, a level
search gives what the heap would. Sizes count to 16 significant bits: below 64 KB the schedule is the plain one exactly,
above, groups whose sizes differ by less than a 32,768th count as equal, each with their mean size.

Scale: the driver sees sizes, at most 32,768 for each doubling, never groups. Everything between is a table of two
numbers a group: texts are read for their hashes, and move once, when they are numbered in their shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless, hidden, join_hot, read, with_key, written

#: Significant bits of a group's size.
BITS = 16
#: Pieces in which the rows of a group are numbered.
PIECES = 4096
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def level_counts(loads: list[float], size: float, n: int) -> list[int]:
    """How many of n units of one size each shard gets if each goes to the least loaded one, ties by number.

    Units meet the n smallest of the loads that shards have one after another, load, load + size, ..., so a search for
    the level below which there are at most n of them replaces n steps.
    """
    below = lambda top: [max(0, -int(-(top - x) // size)) for x in loads]  # noqa: E731  loads in steps of size under the level
    low, high = min(loads), min(loads) + size * (n + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    out = below(low)
    heap = [(x + size * k, s) for s, (x, k) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(out)):  # at most one for each shard is left
        load, s = heap[0]
        out[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return out


def schedule(runs: list[tuple[float, int]], n_shards: int) -> list[list[int]]:
    """Runs (size of a unit, number of units), largest first: for each run how many units each shard gets."""
    loads = [0.0] * n_shards
    out = []
    for size, n in runs:
        if n > 4 * n_shards:
            counts = level_counts(loads, size, n)
        else:
            counts = [0] * n_shards
            heap = [(x, s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(n):
                load, s = heap[0]
                counts[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        loads = [x + size * k for x, k in zip(loads, counts, strict=True)]
        out.append(counts)
    return out


def _rounded(n: Column) -> Column:
    """n to BITS significant bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(n)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", n, drop), drop)


def shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    results: tuple[str, ...] = RESULTS,
) -> DataFrame:
    """Each row of docs with (size, text_crc32, law, shard, slot, grown_shard) beside its columns.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32 is that of the empty text for null. law is `bytes`:
    the sums of sizes differ by little more than one group, unless a single group is larger than a shard. Rows with
    equal texts share a shard (null texts are a group with each other, apart from empty ones); so may, with a chance of
    2**-64, different texts of one hash. slot: 0, 1, ... in each shard. grown_shard: null under this law. Null and
    repeated ids are allowed, as are whole repeated rows: each has a slot of its own. An empty table gives an empty
    result. Further columns stay; one named like a result gets an underscore.
    """
    rows, name, back = hidden(docs, results)
    text = F.col(name[text_col])
    rows = with_key(rows, "key").withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
            "crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
            "g": F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)),
            "piece": F.pmod(F.xxhash64("key"), F.lit(PIECES)).cast("int"),
        }
    )
    pieces = written(rows.groupBy("g", "piece").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("n")), "pieces")
    groups = pieces.groupBy("g").agg(F.sum("n").alias("n")).withColumn("run", _rounded(F.col("n")))
    groups = written(groups, "groups")
    runs = groups.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).toPandas().sort_values("run", ascending=False)
    counts = schedule([(n / m if n % m else n // m, m) for n, m in zip(runs["n"].tolist(), runs["m"].tolist(), strict=True)], n_shards)
    table = [(r, m, [sum(c[:s]) for s in range(n_shards)]) for r, m, c in zip(runs["run"].tolist(), runs["m"].tolist(), counts, strict=True)]
    begins = docs.sparkSession.createDataFrame(table, "run long, m long, begins array<long>")
    # the place of a group among those of its size tells its shard
    placed = join_hot(gapless(groups, ["run"], F.xxhash64("g"), "place"), begins, "run", "m", int(runs["m"].sum()))
    shard = (F.size(F.filter("begins", lambda x: x <= F.col("place"))) - 1).cast("int")
    of_group = written(placed.select("g", shard.alias("shard")), "shards")
    # each piece of a group has its place in the shard; only a piece is numbered by a window
    first = gapless(pieces.select("g", "piece", "rows").join(of_group, "g"), ["shard"], F.xxhash64("g", "piece"), "first", weight="rows")
    own = F.row_number().over(Window.partitionBy("g", "piece").orderBy("key")) - 1
    numbered = rows.withColumn("i", own).join(first.select("g", "piece", "shard", "first"), ["g", "piece"])
    numbered = numbered.withColumn("slot", (F.col("first") + F.col("i")).cast("long"))
    values = (F.col("size"), F.col("crc"), F.lit("bytes"), F.col("shard"), F.col("slot"), F.lit(None).cast("int"))
    return numbered.select(*back, *[v.alias(r) for v, r in zip(values, results, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    out = shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
