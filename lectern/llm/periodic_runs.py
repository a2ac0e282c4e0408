"""Periodic run detection: stretches of words that repeat with a period, whole and maximal.

Method: Karp-Miller-Rosenberg naming. Words get exact numbers, and blocks of 2, 4, 8, ... words are named by numbering the
pairs of names of their halves, as long as a name occurs twice. A longest common extension is read off by descending
through these levels. For a period q the places 0, q, 2q, ... form a grid; a run of three periods holds a grid place whose
q words equal the q words behind them, so equal blocks on the grid are candidates, and the first of each streak of
candidates is extended to both sides. No hashes, no suffix sorting: a stretch is a run because its words are equal.

Scale: a map over rows; nothing is shuffled or collected. Texts are taken in blocks of bytes and all texts of a block go
through numpy together, parted by words that occur once. Only texts in which a block of words recurs are named beyond
that block. Grid places are met in portions, so that memory is a few arrays of a block's words for each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.tables import spread

from .common import WORD, hidden, n_words, read
from .kernel import by_bytes

#: Bytes of text handled at once, a longer text alone; grid places met at once.
BLOCK_BYTES, PORTION = 1 << 20, 1 << 20
RESULTS = ("n_words", "runs", "collapsed")
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _paired(names: np.ndarray, half: int) -> tuple[np.ndarray, int]:
    """Names of the blocks made of two blocks `half` apart, and how many different ones there are."""
    pairs = names[:-half].astype(np.int64) * (int(names.max()) + 1) + names[half:]
    different, named = np.unique(pairs, return_inverse=True)
    return named.astype(np.int32), len(different)


def levels(names: np.ndarray, known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Names of blocks of 1, 2, 4, ... words at each place, up to the last length of which some block occurs twice."""
    out = list(known or [names])
    while 2 << (len(out) - 1) <= len(names):
        named, different = _paired(out[-1], 1 << (len(out) - 1))
        if different == len(named):
            break
        out.append(named)
    return out


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        a, b = i + total, j + total
        inside = b < len(names)
        same = np.zeros(len(i), bool)
        same[inside] = names[a[inside]] == names[b[inside]]
        total += same.astype(np.int64) << k
    return total


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        a, b = i - total - (1 << k), j - total - (1 << k)
        inside = (a >= 0) & (b < len(names))
        same = np.zeros(len(i), bool)
        same[inside] = names[a[inside]] == names[b[inside]]
        total += same.astype(np.int64) << k
    return total


def _portions(first: int, last: int, n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the periods from first to last, in portions: the period and the grid place of each pair of blocks that fits."""
    periods = np.arange(first, last + 1)
    count = np.maximum((n - periods - np.maximum(periods, width)) // periods + 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(periods):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PORTION, "right")) - 1)
        q = np.repeat(periods[lo:hi], count[lo:hi])
        yield q, (np.arange(len(q)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])) * q
        lo = hi


def runs(levels: list[np.ndarray], longest: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal stretches of at least `least` words and `times` periods, by start and period.

    longest: the number of words of the longest text, which bounds the period. times is 3 or more, least 8 * times or more.
    """
    n, found = len(levels[0]), []
    for k in range(3, len(levels)):
        width, names = 1 << k, levels[k]
        # blocks of 8 words serve all periods below 16, since a run has 24 words at least
        first, last = (1 if k == 3 else width), min(2 * width - 1, longest // times)
        for q, i in _portions(first, last, n, width) if first <= last else ():
            hit = names[i] == names[i + q]
            q, i = q[hit], i[hit]
            more = np.maximum(q - width, 0)
            hit = names[i + more] == names[i + q + more]
            q, i = q[hit], i[hit]
            if not len(q):
                continue
            # the places of a streak lie in one stretch
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + q[1:])
            q, i = q[new], i[new]
            back = _behind(levels, i, i + q)
            length = back + q + _ahead(levels, i, i + q)
            keep = length >= np.maximum(least, times * q)
            found.append(np.stack([i - back, length, q])[:, keep])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = np.concatenate(found, 1)
    # a stretch with a multiple of its smallest period is the same stretch
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _recurring(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the texts that begin at `at` have a block of 8 words twice."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(names)
    if n < 9:
        return np.zeros(len(at) - 1, bool)
    # the first pairs carry the text's number, so that blocks of different texts have different names
    _, first = np.unique(names, return_inverse=True)
    pairs = owner[:-1].astype(np.int64) * (int(first.max()) + 2) + first[:-1]
    _, named = np.unique(pairs, return_inverse=True)
    named = named.astype(np.int64) * (int(first.max()) + 2) + first[1:]
    _, named = np.unique(named, return_inverse=True)
    for half in (2, 4):
        named, _ = _paired(named.astype(np.int32), half)
    whole = owner[: len(named)] == owner[7 : 7 + len(named)]
    named, of = named[whole], owner[: len(whole)][whole]
    count = np.bincount(named)
    out = np.zeros(len(at) - 1, bool)
    out[of[count[named] > 1]] = True
    return out


def _of_block(names: np.ndarray, at: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of a block of texts; the words of text t are names[at[t] : at[t + 1]]."""
    some = np.flatnonzero((np.diff(at) >= least) & _recurring(names, at))
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    size = np.diff(at)[some]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    row = np.empty(begin[-1], np.int64)
    row[begin[1:] - 1] = int(names.max()) + 1 + np.arange(len(some))  # behind each text a word that occurs once
    inside = np.ones(len(row), bool)
    inside[begin[1:] - 1] = False
    row[inside] = names[np.repeat(at[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    _, row = np.unique(row, return_inverse=True)
    start, length, period = runs(levels(row.astype(np.int32)), int(size.max()), least, times)
    text = np.searchsorted(begin, start, "right") - 1
    return some[text], start - begin[text], length, period


def _read(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, the number of each word in turn, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # an empty word stands at either end of some texts
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(full)])[ends]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Each row of docs with (n_words, runs, collapsed) beside its columns.

    runs: an array of structs (start, length, period), by start and period: all maximal stretches of words whose smallest
    period is `period` and that have at least `least` words and `times` periods; words are counted from 0 and are runs
    without ASCII white space. collapsed: the words that no run holds behind its first period, joined by one space. A null
    or empty text has no words, no runs, and collapses to the empty string. Ids are not looked at, so they may be null or
    repeat; repeated rows have equal results; further columns stay, and one named like a result gets an underscore; an
    empty table gives an empty result. times must be 3 or more and least 8 * times or more.
    """
    if times < 3 or least < 8 * times:
        raise ValueError("times must be 3 or more and least 8 * times or more")
    rows, name, back = hidden(docs, RESULTS)
    columns, k = rows.columns, rows.columns.index(name[text_col])
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in by_bytes(batch.column(k), BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                words, names, at = _read(part.column(k))
                text, start, length, period = _of_block(names, at, least, times)
                edge = np.zeros(len(names) + 1, np.int64)
                np.add.at(edge, at[text] + start + period, 1)
                np.add.at(edge, at[text] + start + length, -1)
                stays = np.cumsum(edge)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stays)])[at]
                kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(names[stays])))
                own = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(struct)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(at)), own, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                    names=[*columns, *RESULTS],
                )

    schema = T.StructType([*rows.schema, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema).select(*back, *RESULTS)


def strongest(runs: Column) -> Column:
    """Of an array of runs by start and period: that of the greatest length / period, compared exactly; the first of equal ones."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> Column:
    """The text, or of each tenth document by the crc32 of its doc_id one whose words recur from some word on. A null id: the text."""
    h, n, words = F.crc32(F.col("doc_id").cast("string")), n_words("text"), F.regexp_extract_all("text", F.lit(WORD), 0)
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    tail = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int")))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs.select("doc_id", planted(docs).alias("text")))
    best = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
