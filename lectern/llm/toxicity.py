"""Toxicity: how likely a document is to be labelled toxic.

Method: a weighted lexicon matched by Aho-Corasick. Texts are folded first: lower case, homoglyphs (full-width, Cyrillic and
Greek look-alikes) to Latin letters, digits and signs that stand for letters inside a word to those letters. An entry is a
word or the stem of words; an automaton finds all of them in one pass, and a match counts if it begins where a word does
and, for a word, ends where one ends. A match inside an exception phrase (the entry and the word before or behind it)
does not count. The weights of a document's matches are summed and normalised by its length, and a logistic curve over
sum and density gives the score.

The lexicon, its weights (log odds), the exception phrases (neighbours with which an entry stands in clean documents) and
the curve are learned from labelled rows that are not held out: at most SAMPLE of them, chosen by a hash of their ids.
Entries learned may be words with Latin diacritics; those of plain letters also match words that only differ by such.

Scale: fitting reads the labelled sample and aggregates counts of words and stems before they are shuffled; a few hundred
entries reach the driver. Scoring is a map over all rows with the automaton in its closure; memory is a text.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import spread

from . import kernel
from .common import read, written

#: Labelled rows that are fitted on, at most; entries of the lexicon and exception phrases, at most.
SAMPLE, ENTRIES, PHRASES = 20_000, 400, 2000
#: Lengths of stems; documents of the sample that an entry or phrase needs, how much likelier it must be in those of its
#: kind, and how many standard deviations more than by chance it must have there.
STEM, LEAST, LIFT, SIGMAS = range(3, 10), 5, 3.0, 5.0
#: Of sample rows that agree in the smallest of their shingles' names, under one of so many orders, one is learned from.
ORDERS = 3
#: Entries of so many plain letters also match words with diacritics; a character more than this in a chunk is never matched
#: across a cut.
PLAIN, CHUNK = 5, 1 << 20

# Letters of other scripts and the Latin ones that they look like.
_LOOK_ALIKE = dict(zip("аеорсухкмнтвіјѕԁԛԝһցαερονκιτυχγ", "aeopcyxkmhtbijsdqwhgaepovkituxy", strict=True))
# Digits and signs, and the letters that they stand for inside a word.
_STANDS_FOR = dict(zip("013457@$!", "oieastasi", strict=True))
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![\w@$!])[013457@$!](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


class _Table(dict):
    """Where str.translate looks each character up: one character for one, from what Unicode calls compatible."""

    def __init__(self, plain: bool):
        super().__init__({ord(c): x for c, x in _LOOK_ALIKE.items()})
        self.plain = plain

    def __missing__(self, c: int) -> str:
        char = chr(c)
        out = unicodedata.normalize("NFKD" if self.plain else "NFKC", char)
        # marks go with their letter where plain letters are wanted; no fold changes the number of characters
        out = _LOOK_ALIKE.get(out[:1], out[:1]) if self.plain or len(out) == 1 else char
        self[c] = out if len(out) == 1 else char
        return self[c]


_FOLD, _PLAIN = _Table(False), _Table(True)


def fold(text: str) -> str:
    """The text with each character in its plain form: as many characters as the lower-cased text."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _SIGN.sub(lambda m: "".join(_STANDS_FOR[c] for c in m.group()), text)


@dataclass
class Lexicon:
    """Entries with their weights (a stem ends with '*'), exception phrases, and the curve over what they sum to."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton | None:
        by_text: dict[str, list[tuple[str, bool, float]]] = {}
        for entry, weight in self.weights.items():
            by_text.setdefault(entry.rstrip("*"), []).append((entry, entry.endswith("*"), weight))
        found = ahocorasick.Automaton()
        for text, own in by_text.items():
            found.add_word(text, (len(text), own))
        if not by_text:
            return None
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def matches(self, folded: str, plain: str | None = None) -> Iterator[tuple[str, float, int, int]]:
        """(entry, weight, start, end of the match) in a folded text. plain: only what it changes is matched, in words of plain letters."""
        automaton, text = self._automaton, folded if plain is None else plain
        if automaton is None:
            return
        n = len(text)
        for last, (size, own) in automaton.iter(text):
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalpha():
                continue
            inside = end < n and text[end].isalpha()
            if plain is not None and (size < PLAIN or inside or folded[start:end] == text[start:end]):
                continue
            for entry, stem, weight in own:
                if inside == stem:
                    yield entry, weight, start, end

    def counted(self, text: str) -> Iterator[tuple[str, float, str, str]]:
        """(entry, weight, word before, word behind) of the matches of a text; of several at one place the weightiest."""
        folded = fold(text)
        plain = None if folded.isascii() else folded.translate(_PLAIN)
        best: dict[int, tuple[float, str]] = {}
        for found in (self.matches(folded), self.matches(folded, plain) if plain is not None else ()):
            for entry, weight, start, _ in found:
                if weight > best.get(start, (-math.inf, ""))[0]:
                    best[start] = (weight, entry)
        for start, (weight, entry) in best.items():
            yield entry, weight, *neighbours(folded, start)

    def features(self, text: str) -> tuple[float, float]:
        """The logarithms of the summed weights of the matches that count, and of that sum for each hundred words."""
        total, words = 0.0, 0
        for part in chunks(text):
            words += part.count(" ") + part.count("\n") + 1
            for entry, weight, before, behind in self.counted(part):
                if (before, entry) not in self.phrases and (entry, behind) not in self.phrases:
                    total += weight
        return math.log1p(total), math.log1p(100 * total / max(words, 1))

    def score(self, text: str) -> float:
        total, density = self.features(text)
        if not self.weights:
            return self.prior
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * total + c * density))))


def chunks(text: str) -> Iterator[str]:
    """A long text in parts that end between words."""
    at = 0
    while len(text) - at > CHUNK:
        end = max(text.rfind(" ", at, at + CHUNK), text.rfind("\n", at, at + CHUNK)) + 1
        if not end:  # no white space in a whole part
            end = at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def neighbours(folded: str, start: int, reach: int = 40) -> tuple[str, str]:
    """The words before and behind the word at a place; empty where a sentence or the text ends, or none is within reach."""
    before = re.search(r"([^\W\d_]+)[^\w.!?\n]*\Z", folded[max(0, start - reach) : start])
    behind = re.match(r"[^\W_]+[^\w.!?\n]*([^\W\d_]+)", folded[start : start + 2 * reach])
    return before[1] if before else "", behind[1] if behind else ""


def stems(text: str) -> set[str]:
    """The words of a text and the stems that longer words begin with, the latter with a '*'."""
    words = set(_WORD.findall(fold(text)))
    return {w for w in words if 3 <= len(w) <= 40} | {f"{w[:k]}*" for w in words for k in STEM if k < len(w)}


def _counts(rows: DataFrame, of: object, names: tuple[str, ...]) -> DataFrame:
    """How many toxic and clean rows (text, toxic) have each of what of(text) gives, a tuple of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], names=[*names, "clean", "toxic"])

        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic)].update(of(text.as_py() or ""))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield table(seen)
                    seen = (Counter(), Counter())
        yield table(seen)

    schema = ", ".join(f"{n} string" for n in names) + ", clean long, toxic long"
    return rows.mapInArrow(run, schema).groupBy(*names).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _chosen(found: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """From (entry, clean documents, toxic documents), the entries of the lexicon with their weights.

    Of forms in equally many documents the whole word is taken, or else the longest stem. A stem stands for its longer forms
    unless one of them is much likelier in toxic documents.
    """
    odds = {e: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for e, c, t in found}
    size = {e: (t, -c) for e, c, t in found}
    families: dict[tuple, str] = {}
    for e in sorted(odds):
        k = (e[: STEM[0]], size[e])
        families[k] = max(families.get(k, ""), e, key=lambda x: (x != "" and not x.endswith("*"), len(x)))
    names = set(families.values()) | {e for e in odds if not e.endswith("*")}
    kept: dict[str, float] = {}
    for e in sorted(names, key=lambda e: (-size[e][0] * odds[e], e)):
        bare = e.rstrip("*")
        shorter = [f"{bare[:k]}*" for k in STEM if k < len(bare)]
        if all(odds[e] > kept[s] + 1 for s in shorter if s in kept):
            kept[e] = odds[e]
        if len(kept) == ENTRIES:
            break
    return kept


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """A logistic curve by Newton steps; the slopes are held at or above 0."""
    active, beta = list(range(x.shape[1])), None
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, active]])
        beta = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
            w = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (y - p) - ridge * beta)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k, b in zip(active, beta[1:], strict=True) if b < 0]
        if not bad:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *[k + 1 for k in active]]] = beta
            return tuple(map(float, out))
        active.remove(bad[0])


def apart(rows: DataFrame) -> DataFrame:
    """Of rows (id, text, toxic) without their near copies: of those that share a smallest shingle the one with the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in kernel.blocks(batch.column(1)):
                names, at = kernel.shingles(block, 5)
                signed = [kernel.mix(names ^ kernel.mix(np.array([k + 1], np.uint64))) for k in range(ORDERS)]
                least = [[int(x[a:b].min()) if a < b else 0 for a, b in zip(at[:-1], at[1:], strict=True)] for x in signed]
                own = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in least]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *own], names=["id", "text", "toxic", *marks])

    marks = [f"m{k}" for k in range(ORDERS)]
    rows = rows.select(F.col("id").cast("long").alias("id"), "text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.mapInArrow(run, "id long, text string, toxic int, " + ", ".join(f"{m} long" for m in marks))
    for m in marks:
        rows = rows.groupBy(m).agg(F.min(F.struct("id", "text", "toxic", *[x for x in marks if x != m])).alias("r")).select(m, "r.*")
    return rows.select("id", "text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, phrases: tuple[tuple[str, str], ...] = ()) -> Lexicon:
    """A lexicon learned from the rows of docs that labels (doc_id, toxic) mark and that are not held out.

    At most `sample` labelled ids are used, those with the smallest hashes; an id labelled twice is toxic if one label says
    so; null ids and labels are left out. phrases: further exceptions, pairs of an entry and a neighbour in the order of the
    text, an entry written as the lexicon has it. Without labels of both kinds the lexicon is empty and every score is the
    share of toxic labels, 0 without any.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")))
    rows = written(apart(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")).select("text", "toxic"), "labelled")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    prior = toxic / max(clean + toxic, 1)
    if not clean or not toxic:
        return Lexicon(prior=prior)
    def often(mine: str, other: str, n_mine: int, n_other: int) -> F.Column:
        """Whether what rows of one kind have often is no chance."""
        n = F.col(mine) + F.col(other)
        expected = n * n_mine / (n_mine + n_other)
        likelier = F.col(mine) * (n_other + 1) >= LIFT * (n_mine + 1) * F.col(other)
        return (F.col(mine) >= LEAST) & likelier & (F.col(mine) - expected >= SIGMAS * F.sqrt(expected))

    found = _counts(rows, lambda text: ((s,) for s in stems(text)), ("entry",)).where(often("toxic", "clean", toxic, clean))
    # more than are kept, since most are forms of others
    top = found.orderBy(F.desc(F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))), "entry").limit(8 * ENTRIES).collect()
    lexicon = Lexicon(_chosen([(r.entry, r.clean, r.toxic) for r in top], clean, toxic), prior=prior)

    def contexts(text: str) -> set[tuple[str, str]]:
        pairs = {p for part in chunks(text) for e, _, before, behind in lexicon.counted(part) for p in ((before, e), (e, behind))}
        return {p for p in pairs if p[0] and p[1]}

    around = _counts(rows, contexts, ("first", "second")).where((F.col("clean") >= LEAST) & (F.col("clean") * (toxic + 1) >= LIFT * (clean + 1) * F.col("toxic")))
    learned = around.orderBy(F.desc("clean"), "first", "second").limit(PHRASES).collect()
    lexicon = Lexicon(lexicon.weights, frozenset({(r.first, r.second) for r in learned} | set(phrases)), prior=prior)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [lexicon.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in both], pa.float64()) for k in (0, 1)] + [batch.column(1)], names=["total", "density", "toxic"])

    points = rows.mapInArrow(features, "total double, density double, toxic int").toPandas().sort_values(["total", "density", "toxic"]).to_numpy()
    return Lexicon(lexicon.weights, lexicon.phrases, _fitted(points[:, :2], points[:, 2]), prior)


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score) for each row of docs; score between 0 and 1, higher for texts likelier to be toxic.

    Null and empty texts have no match and get the score of such a text. Ids may be null or repeat; equal texts have equal
    scores; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: int | None) -> bool:
    """Whether labels of this id are never learned from; a null id counts as the empty string."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lexicon = fitted(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return scored(docs, lexicon).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
