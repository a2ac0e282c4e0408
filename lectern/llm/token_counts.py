"""Token counts: how many tokens a tokenizer gives for each whole text.

Method: batch encoding in Arrow functions that return lengths only. Batches are cut by bytes, not rows, and texts are
split at safe boundaries, across which neither the tokenizer's normaliser nor its merges reach, so that counts of the
pieces add up to the count of the text. First come the tokenizer's added tokens (special strings), which it looks for in
the text as it is: each is one token, and what lies between them is split further. For tokenizers that drop white space these are ASCII white space, and in long
pieces without any the places before an ASCII digit or after a letter or digit before a mark of ASCII or CJK
punctuation; for those that put a space before the word, single spaces between other characters. What lies between is
one unit of the tokenizer itself, which no cut divides without changing the count. Pieces that recur are encoded once;
their counts are remembered in a table of bounded size.

Scale: a map over rows; nothing is shuffled. Memory is a batch, the table and the tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import spread

from .common import read
from .kernel import by_bytes

#: Bytes of text in a batch; entries of the table of counts; characters of the longest piece it holds.
BATCH_BYTES, TABLE, PIECE = 4 << 20, 1_000_000, 48
#: Ways to cut: `dropped`, for tokenizers that drop white space and split letters, digits one by one, and other marks;
#: `before`, for those that keep a space with the word behind it; `none`.
CUTS = ("dropped", "before", "none")
#: Cuts of a piece without white space. What begins with an ASCII character, or with one of these marks, composes with
#: nothing before it. A digit is always a unit of its own; after a letter or digit a mark begins one, the apostrophe aside.
_INSIDE = re.compile(r"(?=[0-9])|(?<=[A-Za-z0-9\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[!-&(-/:-@\[-`{-~\u3001\u3002\u300c-\u300f\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f])")
_BEFORE = re.compile(r"(?<=[A-Za-z0-9.,;:!?)])(?= [A-Za-z0-9(])")


@dataclass(frozen=True)
class Counter:
    """A tokenizer: from texts to token counts; a table of counts; its added tokens.

    odd: it looks for added tokens in the normalised text, or some take white space or whole words; then no text is cut.
    """

    encode: Callable[[list[str]], list[int]]
    table: dict[str, int]
    strings: tuple[str, ...] = ()
    added: re.Pattern | None = None
    odd: bool = False


@lru_cache(maxsize=4)
def _counter(path: str) -> Counter:
    """For the executor's Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Counter(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], {})
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokens = list(tokenizer.get_added_tokens_decoder().values())
    strings = tuple(t.content for t in tokens)
    # at each place the longest that fits
    added = re.compile("|".join(re.escape(x) for x in sorted(strings, key=lambda x: (-len(x), x)))) if strings else None
    odd = any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens)
    return Counter(lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], {}, strings, added, odd)


def _long(piece: str, encode: Callable[[list[str]], list[int]]) -> int:
    """The count of a long piece without white space, by parts."""
    parts = [p for p in _INSIDE.split(piece) if p]
    return sum(sum(encode(part)) for part in _packs(parts))


def _packs(parts: list[str]) -> Iterator[list[str]]:
    """Lists of parts of a batch's bytes at most, or of one part."""
    pack, total = [], 0
    for p in parts:
        if pack and (total + len(p) > BATCH_BYTES or len(pack) >= 50_000):
            yield pack
            pack, total = [], 0
        pack.append(p)
        total += len(p)
    if pack:
        yield pack


def _count(texts: pa.Array, path: str, cut: str) -> np.ndarray:
    """Token counts of some texts."""
    own = _counter(path)
    if cut == "none" or own.odd:
        return np.array(own.encode(texts.to_pylist()), np.int64)
    if any(pc.any(pc.match_substring(texts, x)).as_py() for x in own.strings):
        parts = [own.added.split(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)])
        each = np.concatenate([[0], np.cumsum(_between(pa.array([p for x in parts for p in x], pa.large_string()), own, cut))])
        return each[ends[1:]] - each[ends[:-1]] + np.diff(ends) - 1
    return _between(texts, own, cut)


def _between(texts: pa.Array, own: Counter, cut: str) -> np.ndarray:
    """Token counts of some texts without added tokens."""
    encode, table = own.encode, own.table
    if cut == "before":
        parts = [[p for p in _BEFORE.split(t) if p] for t in texts.to_pylist()]
        flat = pa.array([p for own in parts for p in own], pa.large_string())
        ends = np.cumsum([0, *map(len, parts)])
    else:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = lists.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    new = [w for w in words if w not in table]
    if len(table) + len(new) > TABLE:
        table.clear()
        new = words
    long = {w for w in new if len(w) > PIECE}
    counts = {w: _long(w, encode) if cut == "dropped" else encode([w])[0] for w in long}
    for part in _packs([w for w in new if w not in long]):
        table.update(zip(part, encode(part), strict=True))
    if len(table) > TABLE:  # more different pieces in one batch than the table holds
        counts.update((w, table[w]) for w in words if w not in long)
        table.clear()
    of_word = np.array([counts[w] if w in counts else table[w] for w in words], np.int64)
    each = of_word[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(each)])
    return total[ends[1:]] - total[ends[:-1]]


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cut: str = "dropped", limit: int = 2048
) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) for each input row.

    path: a tokenizers .json or sentencepiece .model file, present on every machine. Counts are the library's own,
    without begin, end or other added tokens, truncation or padding; special strings inside texts count as the library
    handles them by default. cut: where texts may be split, one of CUTS; it must fit the tokenizer. Null counts as the
    empty text. Ids may be null; rows may repeat; further columns are ignored; an empty table gives an empty result.
    """
    if cut not in CUTS:
        raise ValueError(f"cut must be one of {CUTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in by_bytes(texts, BATCH_BYTES):
                part = texts.slice(lo, hi - lo)
                counts = pa.array(_count(part, path, cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), counts, pc.greater(counts, limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spread(read(spark, sf_dir, "documents")), tokenizer_path()).withColumnRenamed("id", "doc_id")
