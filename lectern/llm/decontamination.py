"""Benchmark decontamination: which documents hold passages of test items, copied, edited or paraphrased.

Method: rare n-gram seeds join training passages to test items, then Smith-Waterman alignment scores each passage. Seeds
are the items' word trigrams. Those that many items share tell nothing about any of them, so documents meet an item by
its own seeds, which a few items have at most; their document frequencies are counted over the whole corpus. A rare own
seed makes a passage, a common one does where it and other seeds of the item, shared ones too, are three together. The
words around are aligned with the item's words in a band about the diagonal of the seeds, half the item's length wide on
either side, 64 words at most beyond the seeds' cell (match 2, mismatch and gap -1); the score is the share of the best
possible alignment of the whole item. On the test tables chance scores stay below 0.25 and copies reach 0.9. Tests hold
the recall by the rate of edits; the README has the figures.

Scale: texts are mapped over twice for each block of items and never shuffled; what is aggregated is a count for each
seed. Items are the stated query set, taken in blocks of bounded size, so a block's seeds have a fixed bound as a
broadcast; the number of passes grows with the number of blocks. A hit of a seed is repeated for the few items whose own
it is, so that stems of a benchmark cost no more than other words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.tables import spread

from . import kernel
from .common import read

GRAM = 3
#: Items in a block, and bytes of their texts, on average.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: A seed is an item's own if so many different items have it at most; an item without any takes those that fewest have.
SHARED = 8
#: A seed is rare up to so many documents, to this share of all, or to so many times its item's median.
RARE, RARE_SHARE, RARE_TIMES = 100, 1e-4, 8
#: A passage needs one rare seed, or so many common ones.
TOGETHER = 3

#: Alignment sees letters without case (of any script) and no ASCII punctuation; this is the ASCII part of it.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32

MATCH, MISS, GAP = 2, 1, 1
#: The share of the best possible alignment from which a document counts as contaminated.
LEAST = 0.35
#: Points that takes at least: half of the item's best, within these bounds. Four words in a row, 8 points, occur by
#: chance, and excerpts of six words, 12 points, are less than half of an item of 13 words.
FLOOR, FLOOR_MOST = 9, 13


#: Characters of scripts that put no spaces between words; each is a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def _unicode(text: bytes) -> bytes:
    if text.isascii():
        return text
    return _UNSPACED.sub(r" \1 ", text.decode("utf-8", "surrogateescape").casefold()).encode("utf-8", "surrogateescape")


def folded(block: kernel.Texts) -> kernel.Texts:
    """The same texts as alignment sees them. Letters beyond ASCII go by Unicode case folding, which may change their bytes."""
    if (block.data > 127).any():
        data = block.data.tobytes()
        texts = [_unicode(data[a:b]) for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
        block = kernel.Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    return block.mapped(FOLD)


def folded_words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, block in kernel.blocks(pa.array(texts, pa.string())):
        block = folded(block)
        first, names = block.words[2], block.word_names
        out += [names[first[k] : first[k + 1]] for k in range(block.n)]
    return out


def best_alignments(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many windows (rows of word names): the best scores, and where they end.

    In a band: the item's word i meets the words i, i + 1, ... of a window, as many as windows are longer than the item,
    and one more. Time and memory are the band's, not the window's.
    """
    b, band = len(windows), windows.shape[1] - len(item) + 1
    ramp = np.arange(band, dtype=np.int32) * GAP
    above = np.zeros((b, band), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    for i, word in enumerate(item):
        row = above + np.where(windows[:, i : i + band] == word, np.int32(MATCH), np.int32(-MISS))
        np.maximum(row[:, :-1], above[:, 1:] - GAP, out=row[:, :-1])  # a word of the item left out
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp  # words of the window left out
        top = row.argmax(1)
        score = row[np.arange(b), top]
        better = score > best
        best[better], end[better] = score[better], i + top[better] + 1
        above = row
    return best, end


def cell(m: int) -> tuple[int, int]:
    """For an item of m words: hits whose starts lie in one cell of so many words are one passage, and the slack about it."""
    step = max(min(m // 4, 64), 2)
    return step, min(m // 4, 64) + step + 4


class Seeds:
    """The seeds of a block of items. Items with equal words are one; `ids` has the ids of each.

    of, item, place: the own seeds, by name, and the item and the word in it where each is; names: their names, once.
    grams: the names of all seeds of an item, in order.
    """

    def __init__(self, ids: list[int | None], texts: list[str]):
        by: dict[bytes, tuple[np.ndarray, list]] = {}
        for i, words in zip(ids, folded_words(texts), strict=True):
            if len(words) >= GRAM:
                by.setdefault(words.tobytes(), (words, []))[1].append(i)
        self.ids, self.items = [x[1] for x in by.values()], [x[0] for x in by.values()]
        all_grams = [kernel.grams(w, np.array([0, len(w)]), GRAM)[0] for w in self.items]
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        names = join(all_grams, np.uint64)
        item = join([np.full(len(g), k) for k, g in enumerate(all_grams)], np.int64)
        place = join([np.arange(len(g)) for g in all_grams], np.int64)
        self.grams = [np.unique(g) for g in all_grams]
        once, n_items = np.unique(join(self.grams, np.uint64), return_counts=True)
        shared = n_items[np.searchsorted(once, names)] if len(names) else np.zeros(0, np.int64)
        least = np.full(len(self.items), SHARED)
        fewest = np.full(len(self.items), np.iinfo(np.int64).max)
        np.minimum.at(fewest, item, shared)
        least = np.maximum(least, fewest) if len(self.items) else least
        own = shared <= least[item] if len(names) else np.zeros(0, bool)
        self.has_shared = np.zeros(len(self.items), bool)
        self.has_shared[item[~own]] = True
        names, item, place = names[own], item[own], place[own]
        order = np.lexsort((place, item, names))
        self.of, self.item, self.place = names[order], item[order], place[order]
        self.names = np.unique(self.of)
        self.lengths = np.array([len(w) for w in self.items], np.int64)
        self.step = np.array([cell(m)[0] for m in self.lengths], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.names >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some windows are seeds, and the numbers of those seeds."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(names >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.names, names[maybe]), len(self.names) - 1)
        true = self.names[at] == names[maybe]
        return maybe[true], at[true]

    def rare(self, counts: np.ndarray, n_docs: int) -> np.ndarray:
        """Which own seeds are rare: not those that many documents have, beside the median of their item's seeds that any has."""
        rare = np.ones(len(self.of), bool)
        of = np.searchsorted(self.names, self.of)
        order = np.argsort(self.item, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1):
            df = counts[of[own]]
            seen = df[df > 0]
            if len(seen):
                rare[own] = df <= max(RARE, RARE_SHARE * n_docs, RARE_TIMES * np.median(seen))
        return rare


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in batches:
            total = np.zeros(len(seeds.names), np.int64)
            for _, _, block in kernel.blocks(batch.column(0)):
                names, at = folded(block).grams(GRAM)
                where, seed = seeds.hits(names)
                text = np.searchsorted(at, where, "right") - 1
                total += np.bincount(np.unique(text * len(seeds.names) + seed) % max(len(seeds.names), 1), minlength=len(seeds.names))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

    return run


def _passages(seeds: Seeds, rare: np.ndarray, names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where documents and items may meet: (text, item, first word of the cell, whether that is sure).

    Hits of one cell are one passage. Not sure are those whose few common seeds count only with shared ones about them.
    """
    where, seed = seeds.hits(names)
    if not len(where):
        return (np.zeros(0, np.int64),) * 4
    text = np.searchsorted(at, where, "right") - 1
    word = where - at[text]
    begin = np.searchsorted(seeds.of, seeds.names[seed], "left")
    count = np.searchsorted(seeds.of, seeds.names[seed], "right") - begin
    k = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    text, word, item = np.repeat(text, count), np.repeat(word, count), seeds.item[k]
    # the item's first word would be here; hits whose starts lie close belong to one passage
    place = np.floor_divide(word - seeds.place[k], seeds.step[item])
    order = np.lexsort((place, item, text))
    text, item, place, rare = text[order], item[order], place[order], rare[k][order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1])
    group = np.cumsum(new) - 1
    sure = (np.bincount(group, rare) > 0) | (np.bincount(group) >= TOGETHER)
    text, item, start = text[new], item[new], (place * seeds.step[item])[new]
    meets = sure | seeds.has_shared[item]
    return text[meets], item[meets], start[meets], sure[meets]


def needed(m: int, least: float) -> float:
    """Points from which an item of m words counts as found."""
    return min(MATCH * m, max(min(max(FLOOR, MATCH * m // 2), FLOOR_MOST), least * MATCH * m))


def _found(seeds: Seeds, rare: np.ndarray, block: kernel.Texts, least: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item) to the score and the bounds of the best passage, where the score is `least` or more."""
    block = folded(block)
    grams, at_gram = block.grams(GRAM)
    text, item, start, sure = _passages(seeds, rare, grams, at_gram)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(text):
        return found
    first, names = block.words[2], block.word_names
    order = np.argsort(item, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        k = item[own[0]]
        words = seeds.items[k]
        m = len(words)
        slack = cell(m)[1]
        width = m + 2 * slack
        for part in np.array_split(own, max(1, len(own) * width // (1 << 20))):
            view = _around(names, first, text[part], start[part] - slack, width)
            few = np.flatnonzero(~sure[part])
            if len(few):
                near = _around(grams, at_gram, text[part][few], start[part][few] - slack, width)
                drop = few[np.isin(near, seeds.grams[k]).sum(1) < TOGETHER]
                part, view = np.delete(part, drop), np.delete(view, drop, 0)
                if not len(part):
                    continue
            score, end = best_alignments(words, view)
            good = np.flatnonzero(score >= needed(m, least))
            if not len(good):
                continue
            # what lies up to the end, backwards, tells where the alignment begins
            turned = np.where(np.arange(width) < end[good][:, None], view[good], np.uint64(0))[:, ::-1]
            _, back = best_alignments(words[::-1], turned)
            for row, w in enumerate(good):
                base = int(start[part[w]]) - slack
                got = (float(score[w]) / (MATCH * m), base + width - int(back[row]), base + int(end[w]))
                key = (int(text[part[w]]), int(k))
                if key not in found or got[0] > found[key][0]:
                    found[key] = got
    return found


def _around(names: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """For each text the names from its word `begin` on, 0 outside the text."""
    at = begin[:, None] + np.arange(width)
    inside = (at >= 0) & (at < np.diff(first)[text][:, None])
    if not len(names):
        return np.zeros(at.shape, np.uint64)
    return np.where(inside, names[np.clip(at + first[text][:, None], 0, len(names) - 1)], np.uint64(0))


def _aligned(shared, marks, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in batches:
            for lo, _, block in kernel.blocks(batch.column(1)):
                found = _found(seeds, marks.value, block, least)
                if found:
                    keys = [(x, i) for x in sorted(found) for i in seeds.ids[x[1]]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([lo + t for (t, _), _ in keys])),
                            pa.array([i for _, i in keys], pa.int64()),
                            *(pa.array([found[x][n] for x, _ in keys], kind) for n, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))),
                        ],
                        names=["id", "item_id", "score", "begin_word", "end_word"],
                    )

    return run


def _without(shared, marks, least: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in batches:
            for lo, hi, block in kernel.blocks(batch.column(k)):
                keep = np.ones(hi - lo, bool)
                keep[[t for t, _ in _found(seeds, marks.value, block, least)]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return run


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("begin_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]
)


def _seed_blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[tuple]:
    """For each block of items its seeds, and which of them are rare, as broadcasts that live as long as what is made of them."""
    spark = docs.sparkSession
    texts = docs.select(text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_docs = texts.count()
    n_blocks = max(-(-n_items // ITEMS), -(-n_bytes // ITEM_BYTES))
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()  # about ITEMS rows
        block.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        seeds = Seeds([r.item_id for r in block], [r.text for r in block])
        if not len(seeds.names):
            continue
        shared = spark.sparkContext.broadcast(seeds)
        counted = texts.mapInArrow(_frequencies(shared), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(seeds.names), np.int64)
        counts[counted["seed"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        yield shared, spark.sparkContext.broadcast(seeds.rare(counts, n_docs))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST
) -> DataFrame:
    """Rows (id, item_id, score, begin_word, end_word): documents that hold an item with a score of `least` or more.

    score: the alignment's share of the best possible, 1 for a copy; of several passages the best. An item of five
    words or less has to be there whole, one of up to twelve needs half of the best possible score (nine points at
    least), one of up to 18 needs 13 points. begin_word and end_word bound the passage, in words of the text as folded (Unicode case and ASCII punctuation aside). Null and empty texts
    hold nothing; items of fewer than three words cannot be told from chance and match nothing. Words are runs without
    white space, but for scripts that put no spaces between words, of which each character is a word. Repeated rows are
    found as often as they occur, items with equal words each; ids may be null. Further columns are ignored; an empty
    table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out: DataFrame | None = None
    for shared, marks in _seed_blocks(docs, benchmark, text_col, item_col, item_text_col):
        found = rows.mapInArrow(_aligned(shared, marks, least), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item (see contaminated), with their own columns, whatever their names.

    Null and empty texts stay; repeated rows share one fate; ids are not looked at. Without items all rows stay.
    """
    out = docs
    for shared, marks in _seed_blocks(docs, benchmark, text_col, item_col, item_text_col):
        out = out.mapInArrow(_without(shared, marks, least, docs.columns.index(text_col)), docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").withColumn("score", F.round("score", 6))
