"""N-gram Jaccard join: which documents share at least `threshold` of their word shingles.

Method: a chosen-path join. Every distinct shingle set gets a signature of minwise values; a run starts from all sets
and splits them recursively on sampled values (each node of the recursion samples its own coordinates, and sets that
agree on one go on together), until a bucket is small enough to compare all its sets. The chance that a run finds a link
at the threshold follows from the number of splits it went through, and runs are repeated in batches until all of them
together reach the target recall. Buckets compare signatures with a margin below the threshold and hand on a forest of
candidate links; connected candidates then meet once more with their whole sets, where every pair is decided by its
exact Jaccard similarity and counted.

Scale: texts are read twice and never shuffled; signatures are shuffled only for sets that share a bucket, shingles
only for sets with a candidate. Equal sets are one row throughout, so copies cost nothing beyond one aggregation. A
bucket or class too large for one task is cut into blocks, and pairs of blocks are dealt to tasks; such a task returns
one row for each set, never the pairs. Comparing all different sets of one class is work in the square of their
number, which a count of links needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import kernel
from .common import components, read, written

COORDINATES = 64
#: Signatures count as candidates this far below the threshold: four standard errors of 64 coordinates.
MARGIN = 0.2
#: Sets in a block of a bucket or class, and shingles in a block of a class.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Buckets of up to so many sets are compared by one numpy call instead of one for each coordinate; the result is the same.
FEW = 8
#: Bits of the filter that a second reading of the texts holds, at most (8 MB).
FILTER_BITS = 1 << 26

_MULTIPLY = kernel.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _keys(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets of shingles laid end to end: two hashes that name each set together, and its size."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        one[some] = np.add.reduceat(names, at[:-1][some])
        two[some] = np.add.reduceat(kernel.mix(names ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][some])
    return kernel.mix(one + n.astype(np.uint64)).view(np.int64), two.view(np.int64), n


def _rows_of_bytes(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as binary values, one a row."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in kernel.blocks(batch.column(1)):
                names, at = kernel.shingles(block, k)
                k1, k2, n = _keys(names, at)
                some = np.flatnonzero(n)
                sig = np.zeros((block.n, COORDINATES), np.uint32)
                if len(some):
                    for j in range(COORDINATES):
                        sig[some, j] = np.minimum.reduceat((names * _MULTIPLY[j]) >> np.uint64(32), at[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(k1),
                        pa.array(k2),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(block.n + 1, dtype=np.int32) * COORDINATES), pa.array(sig.view(np.int32).ravel())
                        ),
                        _rows_of_bytes(sig.astype(np.uint8)),
                    ],
                    names=["id", "k1", "k2", "n", "sig", "low"],
                )

    return run


def _shingle_rows(k: int, bits: np.ndarray):
    """Of (text, h): the names and shingles of the sets of texts whose h is in the filter, each once for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) & mask
            hit = (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit))
            for _, _, block in kernel.blocks(batch.column(0)):
                names, at = kernel.shingles(block, k)
                k1, k2, n = _keys(names, at)
                _, first = np.unique(np.stack([k1, k2]), axis=1, return_index=True)
                first = np.sort(first[n[first] > 0])
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(at * 8), pa.py_buffer(names)])
                yield pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), sets.take(pa.array(first)).cast(pa.binary())], names=["k1", "k2", "shingles"])

    return run


def _candidates(least: float, threshold: float):
    """Buckets of signatures -> (a, b): a forest that joins the sets of a bucket that candidate links join.

    Of each coordinate the last byte is compared; others agree by chance in one of 256, which adds candidates and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in kernel.whole_groups(batches, ["path", "i", "j"]):
            node = table.column("node").to_numpy()
            n = table.column("n").to_numpy().astype(np.float64)
            low = table.column("low").combine_chunks()
            begin = np.frombuffer(low.buffers()[1], np.int32)[low.offset]
            sig = np.frombuffer(low.buffers()[2], np.uint8)[begin : begin + len(low) * COORDINATES].reshape(-1, COORDINATES)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                own, size = sig[lo:hi], n[lo:hi]
                if hi - lo <= FEW:
                    same = (own[:, None] == own[None]).sum(2)
                else:
                    same = np.zeros((hi - lo, hi - lo), np.uint8)
                    for j in range(COORDINATES):
                        same += own[:, j][:, None] == own[:, j][None, :]
                linked = (same >= least) & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9)
                y = kernel.labels(linked)
                x = np.flatnonzero(y != np.arange(hi - lo))
                a.append(node[lo:hi][x])
                b.append(node[lo:hi][y[x]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return run


def common_shingles(names: np.ndarray, at: np.ndarray, width: int = 4096) -> np.ndarray:
    """For sets laid end to end, the matrix of the sizes of their intersections."""
    m = len(at) - 1
    owner = np.repeat(np.arange(m), np.diff(at))
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], rank[column[keep]]
    total = np.zeros((m, m), np.float32)
    for c in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        dense = np.zeros((m, min(width, int(often.sum()) - c)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - c] = 1
        total += dense @ dense.T
    return total


def _exact(threshold: float):
    """Classes of candidates -> one row for each set that has a link here: how many documents it links to, and its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in kernel.whole_groups(batches, ["root", "i", "j"]):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
            sets = table.column("shingles").combine_chunks()
            offsets = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
            data = np.frombuffer(sets.buffers()[2], np.uint8) if sets.buffers()[2] is not None else np.zeros(0, np.uint8)
            whole = table.column("whole").to_numpy(zero_copy_only=False)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                at = (offsets[lo : hi + 1] - offsets[lo]) // 8
                size = np.diff(at).astype(np.float64)
                both = common_shingles(np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), np.uint64), at).astype(np.float64)
                linked = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold
                np.fill_diagonal(linked, False)
                if i[lo] != j[lo]:
                    linked &= block[lo:hi][:, None] != block[lo:hi][None, :]
                label = kernel.labels(linked)
                some = np.flatnonzero(linked.any(1))
                out[0].append(node[lo:hi][some])
                out[1].append((linked * copies[lo:hi][None, :]).sum(1)[some].astype(np.int64))
                # nodes are in order, so the smallest row is the smallest node
                out[2].append(node[lo:hi][label[some]])
                out[3].append(whole[lo:hi][some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "links", "label", "whole"])

    return run


def _block_pairs(rows: DataFrame, key: str, n_blocks: Column) -> DataFrame:
    """Give each row its block of its key's group, and repeat it for each pair (i, j) of blocks that it belongs to."""
    return (
        rows.withColumn("_n", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
        .withColumn("i", F.least("block", "_o"))
        .withColumn("j", F.greatest("block", "_o"))
        .withColumn("whole", F.col("_n") == 1)
        .drop("_n", "_o")
        .repartition(key, "i", "j")
        .sortWithinPartitions(key, "i", "j", "node")
    )


def _share(threshold: float) -> int:
    """With which chance, of 2**20, a split samples a coordinate: 1 / threshold coordinates on average."""
    return int((1 << 20) / (threshold * COORDINATES))


def least_recall(similarity: float, runs: int, splits: int, threshold: float) -> float:
    """The chance that a link of this similarity is found, after so many runs in which no set was split more often.

    The two signatures agree in s coordinates, binomially; fewer than the margin allows are never candidates. A run looks
    at one coordinate, and at each split at those sampled, or if none is at one more; the link gets through where a
    coordinate looked at is one of the s. It grows with the similarity, so no link above the threshold fares worse than
    one at it.
    """
    rate = _share(threshold) / (1 << 20)
    total = 0.0
    for s in range(int(np.ceil((threshold - MARGIN) * COORDINATES)), COORDINATES + 1):
        together = 1 - (1 - rate) ** s + (1 - rate) ** COORDINATES * s / COORDINATES
        chance = s / COORDINATES * min(1.0, together) ** splits
        total += comb(COORDINATES, s) * similarity**s * (1 - similarity) ** (COORDINATES - s) * (1 - (1 - chance) ** runs)
    return total


def runs_needed(recall: float, splits: int, threshold: float) -> int:
    """How many runs of so many splits find a link at the threshold with this chance; ValueError if no number of them does."""
    for runs in range(1, COORDINATES + 1):
        if least_recall(threshold, runs, splits, threshold) >= recall:
            return runs
    raise ValueError(f"a recall of {recall} is beyond signatures of {COORDINATES} coordinates")


def _run_batch(sets: DataFrame, runs: range, threshold: float, limit: int, depth: int, seed: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Candidate links (a, b) of some runs, how often sets were split, and which (node). sets: (node, n, sig, low)."""
    first = F.array(
        *[F.struct(F.xxhash64(F.lit(seed), F.lit(r), F.element_at("sig", 1 + (r * 37 + 11) % COORDINATES)).alias("path")) for r in runs]
    )
    level = written(sets.select("node", F.inline(first)), "paths")
    small: list[DataFrame] = []
    crowded = parted = None
    for d in range(depth + 1):
        sizes, many = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit), Observation()
        large = written(sizes.observe(many, F.count(F.lit(1)).alias("n")), "large")
        if not many.get["n"]:
            small.append(level)
            break
        small.append(level.join(large, "path", "left_anti"))
        crowded = written(level.join(large, "path"), "crowded")
        parted = crowded if parted is None else parted
        if d == depth:
            break
        # a node samples its coordinates by its own path, so that all sets in it agree on them
        sampled = F.filter(
            F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
            lambda c: F.pmod(F.xxhash64(F.lit(seed), F.col("path"), c), F.lit(1 << 20)) < _share(threshold),
        )
        spare = F.array(F.pmod(F.xxhash64(F.lit(seed), F.col("path"), F.lit(COORDINATES)), F.lit(COORDINATES)).cast("int"))
        child = F.when(F.size(sampled) > 0, sampled).otherwise(spare)
        paths = crowded.join(sets.select("node", "sig"), "node").select("node", "path", "sig", F.explode(child).alias("c")).select(
            "node", F.xxhash64("path", "c", F.element_at("sig", F.col("c") + 1)).alias("path")
        )
        level, crowded = written(paths, "paths"), None
    rows = small[0].select("path", "node")
    for more in small[1:]:
        rows = rows.unionByName(more.select("path", "node"))
    # at most `limit` nodes a path; most paths have but one
    grouped = rows.groupBy("path").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
    buckets = grouped.select("path", F.size("nodes").cast("long").alias("size"), F.explode("nodes").alias("node"))
    if crowded is not None:
        buckets = buckets.unionByName(crowded.select("path", "size", "node"))
    buckets = written(buckets, "buckets")
    blocked = _block_pairs(buckets.join(sets.select("node", "n", "low"), "node"), "path", F.ceil(F.col("size") / limit))
    least = (threshold - MARGIN) * COORDINATES
    links = blocked.select("path", "i", "j", "node", "n", "low").mapInArrow(_candidates(least, threshold), "a long, b long")
    return links, d, None if parted is None else parted.select("node").distinct()


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    limit: int = BLOCK_SETS,
    depth: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Near-duplicate classes: one row (id, class_id, n_links) for each input row.

    A link joins two rows whose sets of `words`-word shingles have a Jaccard similarity of `threshold` or more (words
    are runs without ASCII white space, compared as they are; a text of fewer words has one shingle of all of them).
    n_links counts the other rows linked to this one, copies included; class_id is the smallest id of the rows that
    links connect. recall: runs go on until a link at the threshold is found with this chance (least_recall); a recall that
    no number of runs can reach is a ValueError.

    Null and empty texts have no shingles: no links, a class of their own, named by their id. Ids may repeat, with equal or
    other texts, or be null, and are below 2**62: rows are compared by their texts alone. A class in which no row has an
    id is named by a number above 2**62. Further columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    runs_needed(recall, depth, threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_signatures(words), "id long, k1 long, k2 long, n int, sig array<int>, low binary")
    rows = written(signed, "signatures")
    groups = (
        rows.where("n > 0")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    )
    sets = written(groups.withColumn("node", F.monotonically_increasing_id()), "sets")
    signed = sets.select("node", "n", "sig", "low")

    found: DataFrame | None = None
    runs = splits = 0
    while runs < (wanted := runs_needed(recall, splits, threshold)):
        more, deep, parted = _run_batch(signed, range(runs, wanted), threshold, limit, depth, seed)
        found = written((more if found is None else found.unionByName(more)).distinct(), "found")
        if not runs and parted is not None:
            # links that met no split have had their runs; a split can only lose links between sets that it parted
            signed = written(signed.join(parted, "node", "left_semi"), "parted")
        runs, splits = wanted, max(splits, deep)
    known = written(components(found), "classes")

    candidates = known.select(F.col("id").alias("node"), "root")
    named = Observation()
    of_class = candidates.join(sets.select("node", "k1", "k2", "first_id", "copies", "n"), "node")
    of_class = written(of_class.observe(named, F.count(F.lit(1)).alias("n")), "members")
    n_candidates = named.get["n"]
    width = 64
    while width < min(FILTER_BITS, 16 * n_candidates):
        width *= 2
    slot = F.xxhash64("first_id").bitwiseAND(F.lit(width - 1))
    filled = of_class.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("v")
    ).toPandas()
    bits = np.zeros(width // 64, np.uint64)
    bits[filled["w"].to_numpy(np.int64)] = filled["v"].to_numpy(np.int64).view(np.uint64)
    shingled = texts.select("text", F.xxhash64("id").alias("h")).mapInArrow(_shingle_rows(words, bits), "k1 long, k2 long, shingles binary")
    # classes of more than one block; written, so that Spark can split what meets them
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / limit), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    large = written(of_class.groupBy("root").agg(n_blocks.alias("blocks")).where("blocks > 1"), "large")
    meet = of_class.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    meet = meet.join(shingled.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    paired = _block_pairs(meet, "root", F.col("blocks"))
    links = written(
        paired.select("root", "i", "j", "block", "whole", "node", "copies", "shingles").mapInArrow(_exact(threshold), "node long, links long, label long, whole boolean"), "links"
    )
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    # a class in one block has its components; those of the others are put together
    classes = components(links.where("not whole").select(F.col("node").alias("a"), F.col("label").alias("b"))).unionByName(
        links.where("whole").select(F.col("node").alias("id"), F.col("label").alias("root"))
    )
    # a class is named by its smallest id; one that has none, by a number above all ids
    unnamed = F.col("k1").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    linked = classes.withColumnRenamed("id", "node").join(sets.select("node", "first_id", unnamed.alias("unnamed")), "node")
    linked = written(linked, "linked")
    ids = written(linked.groupBy("root").agg(F.coalesce(F.min("first_id"), F.min("unnamed")).alias("class_id")), "names")
    of_node = linked.select("node", "root").join(ids, "root").select("node", "class_id")
    of_set = (
        sets.select("k1", "k2", "node", "copies", F.coalesce("first_id", unnamed).alias("own_id"))
        .join(counted, "node", "left")
        .join(of_node, "node", "left")
        .select("k1", "k2", "copies", F.coalesce("class_id", "own_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    with_sets = rows.where("n > 0").select("id", "k1", "k2").join(written(of_set, "named"), ["k1", "k2"])
    return with_sets.select("id", "class_id", "n_links").unionByName(
        rows.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
    FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), j AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM j JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE CAST(c AS DOUBLE) / (na.n + nb.n - c) >= 0.8
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (SELECT a, min(b) AS b FROM r GROUP BY a
), l AS (SELECT a, count(*) AS c FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(k.b, doc_id)) AS class_id, coalesce(l.c, 0) AS n_links
FROM documents LEFT JOIN k ON k.a = doc_id LEFT JOIN l ON l.a = doc_id
"""
