"""Quality rules: which documents to keep.

Method: a short-circuit cascade. On a bounded sample each rule's cost (seconds a byte) and selectivity (the share it
rejects) are estimated, and the rules are run in the order of rejection per cost; a rule, and the features that it alone
needs, see only the documents that all rules before it have passed. The order bears on speed alone: a document is kept
if no rule rejects it.

Scale: a map over rows. Features come from blocks of bytes by numpy; nothing is shuffled, and only the sample, 32 MB
at most, reaches the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import spread

from . import kernel
from .common import read

#: The sample on which the order of the rules is estimated: so many rows at most, of texts of so many bytes at most, from
#: so many files spread over the table.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_FILES = 500, 1 << 16, 10

#: Each byte's letter, a to z in either case; 26 for the rest.
_LETTER = np.full(256, 26)
for _k in range(26):
    _LETTER[[ord("a") + _k, ord("A") + _k]] = _k

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Features:
    """Features of a block of texts, each computed when first asked for."""

    def __init__(self, block: kernel.Texts):
        self.block = block

    def take(self, rows: np.ndarray) -> Features:
        return self if len(rows) == self.block.n else Features(self.block.take(rows))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.block.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self.block.data
        return self.block.sums(~kernel._SPACE[data] & ((data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.block.sums(_SYMBOL[self.block.data])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.block.lines[2], minlength=self.block.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        begin, end, text = self.block.lines
        names = self.block.names(begin, end)
        order = np.lexsort((names, text))
        names, text = names[order], text[order]
        again = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
        return np.bincount(text[1:][again], minlength=self.block.n)

    def repeated(self, k: int) -> np.ndarray:
        """How many words lie in windows of k words that the text has twice or more."""
        names, at = self.block.grams(k)
        first = self.block.words[2]
        count = np.diff(at)
        text = np.repeat(np.arange(self.block.n, dtype=np.uint64), count)
        key = kernel.mix(names ^ kernel.mix(text + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        # +1 where a repeated window begins, -1 behind its end
        edge = np.zeros(first[-1] + 1, np.int64)
        start = hit - np.repeat(at[:-1], count)[hit] + np.repeat(first[:-1], count)[hit]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + k, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
        return total[first[1:]] - total[first[:-1]]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        return self.repeated(3)

    @cached_property
    def n_passage_words(self) -> np.ndarray:
        """Words in repeated windows of ten, where they can be over PASSAGE_PERCENT: such windows are repeated by threes too."""
        out = np.zeros(self.block.n, np.int64)
        some = np.flatnonzero(100 * self.n_repeat_words > PASSAGE_PERCENT * self.n_words)
        if len(some):
            out[some] = Features(self.block.take(some)).repeated(10)
        return out

    @cached_property
    def top_pair(self) -> np.ndarray:
        """How often the most frequent pair of neighbouring words occurs."""
        names, at = self.block.grams(2)
        text = np.repeat(np.arange(self.block.n), np.diff(at))
        order = np.lexsort((names, text))
        names, text = names[order], text[order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        out = np.zeros(self.block.n, np.int64)
        np.maximum.at(out, text[begin], np.diff(np.append(begin, len(names))))
        return out

    @cached_property
    def letters(self) -> np.ndarray:
        """Per text how often it has each letter a to z, in either case."""
        owner = np.repeat(np.arange(self.block.n), np.diff(self.block.at))
        return np.bincount(owner * 27 + _LETTER[self.block.data], minlength=27 * self.block.n).reshape(-1, 27)[:, :26]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], np.ndarray]


def _symbols(f: Features) -> np.ndarray:
    # word separators of tables and menus, mark-up, junk; prose has next to none
    return 10 * f.n_symbols > 3 * f.n_words


def _word_length(f: Features) -> np.ndarray:
    # no bound from above: languages differ, and some write without spaces
    return f.word_chars < 2 * f.n_words


def _lines(f: Features) -> np.ndarray:
    return (f.n_lines >= 5) & (2 * f.n_dup_lines > f.n_lines)


#: A document goes from this share of words in repeated passages of ten words on.
PASSAGE_PERCENT = 40


def _passages(f: Features) -> np.ndarray:
    return 100 * f.n_passage_words > PASSAGE_PERCENT * f.n_words


def _pairs(f: Features) -> np.ndarray:
    # both words of the pair count: a fifth of the text
    return 10 * f.top_pair > f.n_words


def _letters(f: Features) -> np.ndarray:
    # languages have about four bits a letter, dumps of hexadecimal digits and runs of one letter far less
    n = f.letters.sum(1)
    share = f.letters / np.maximum(n, 1)[:, None]
    bits = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return (n >= 200) & (bits < 2.6)


#: The base rules that the contract fixes, and those of the method beside them.
BASE = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
METHOD = (
    Rule("symbols", _symbols), Rule("short_words", _word_length), Rule("repeated_lines", _lines),
    Rule("repeated_passages", _passages), Rule("frequent_pair", _pairs), Rule("few_letters", _letters),
)


def cascade(features: Features, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it is kept, and the number of the first rule in order that rejected it (-1: none)."""
    n = features.block.n
    by = np.full(n, -1, np.int32)
    rows = np.arange(n)  # of the texts that features has
    for k, rule in enumerate(rules):
        alive = by[rows] < 0
        if not alive.any():
            break
        # survivors move to a block of their own once that spares a fifth of the work
        if alive.mean() < 0.8:
            features, rows = features.take(np.flatnonzero(alive)), rows[alive]
            alive = alive[alive]
        by[rows[alive & rule.rejects(features)]] = k
    return by < 0, by


def _sample(docs: DataFrame, text_col: str, rows: int) -> list[str]:
    """At most `rows` texts: the first of some files spread over the table, or of a table that is no Parquet files, its first.

    Files are read as they are; what docs leaves out of them may be in the sample, which bears on the order of rules alone.
    """
    some = lambda df, n: [r.t for r in df.select(F.col(text_col).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).take(n)]
    files = sorted(docs.inputFiles())
    chosen = sorted({files[k * len(files) // SAMPLE_FILES] for k in range(SAMPLE_FILES)}) if files else []
    if len(chosen) < 2:
        return some(docs, rows)
    try:
        return [t for f in chosen for t in some(docs.sparkSession.read.parquet(f), rows // len(chosen))]
    except AnalysisException:
        return some(docs, rows)


def estimated_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by falling rejection per cost, estimated on a sample of at most `rows` rows; ties, and empty tables, by name."""
    seconds, rejected = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for _, _, block in kernel.blocks(pa.array(_sample(docs, text_col, rows), pa.string())):
        for rule in rules:
            fresh = Features(kernel.Texts(block.data, block.at))
            began = time.perf_counter()
            rejected[rule] += int(rule.rejects(fresh).sum())
            seconds[rule] += time.perf_counter() - began
    return tuple(sorted(rules, key=lambda r: (-rejected[r] / max(seconds[r], 1e-9), r.name)))


def measured(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, the features that the base rules and callers ask for, and kept.

    These features are computed for every document; what the other rules need, for those that pass the rules before.
    Null texts count as empty: no words, no lines. Ids may be null or repeat; further columns are ignored; an empty table
    gives an empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in kernel.blocks(batch.column(1)):
                f = Features(block)
                values = [pa.array(getattr(f, n).astype(np.int64)) for n in names]
                kept, _ = cascade(f, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *values, pa.array(kept)], names=["id", *names, "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names) + ", kept boolean")


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + METHOD) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns, whatever their names.

    Null and empty texts have too few words. Whole repeated rows share one fate; ids are not looked at. An empty table
    gives an empty result.
    """
    order = estimated_order(docs, rules, text_col)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in kernel.blocks(batch.column(k)):
                kept, _ = cascade(Features(block), order)
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = measured(docs, estimated_order(docs, BASE + METHOD))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), "kept",
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE again) GROUP BY doc_id
), g10 AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 9], ' ')) > 1 AS again
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM w)
), r10 AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 10)) AS p FROM g10 WHERE again) GROUP BY doc_id
), t AS (
  SELECT doc_id, max(n) AS n FROM (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY doc_id, w[i], w[i + 1]) GROUP BY doc_id
), a AS (
  SELECT doc_id, list_transform(range(97, 123), lambda c: length(text) - length(replace(replace(text, chr(CAST(c AS INT)), ''), chr(CAST(c - 32 AS INT)), ''))) AS ns
  FROM documents
), e AS (
  SELECT doc_id, list_sum(ns) AS n, -list_sum(list_transform(ns, lambda x: CASE WHEN x > 0 THEN x / list_sum(ns) * log2(x / list_sum(ns)) ELSE 0 END)) AS bits FROM a
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(r10.n, 0) AS n_passage, coalesce(t.n, 0) AS top_pair, coalesce(e.n, 0) >= 200 AND e.bits < 2.6 AS few_letters
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN r10 USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines)
    OR 100 * n_passage > 40 * n_words OR 10 * top_pair > n_words OR few_letters) AS kept
FROM b
"""
