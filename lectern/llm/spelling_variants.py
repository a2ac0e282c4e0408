"""Spelling variant grouping: words of a corpus that differ by one letter, and the frequent form each belongs to.

Method: anagram hashing. A word's key is the sum of a power of each of its letters, so that words with the same letters
share it and adding, removing or exchanging a letter changes it by that letter's power or by a difference of two. Two words
can be near only if their keys less one letter's power agree, or if one word's key is the other's less a power. Such keys
are joined as integers, one row for each class of anagrams and letter; classes without a partner end there. What is left
meets by key, and the order of letters is verified: words that agree in all places but one, or of which one is the other
without a place, are near. They are grouped by that rest and never paired, so many anagrams of one class cost nothing more.

Scale: texts are read once, words are counted inside each task before they are shuffled. Of the vocabulary, integer keys
are shuffled first, and words only for those of their places that have a partner. A group of words that agree in all
places but one has at most as many members as the alphabet has letters times a word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.sources.tables import spread

from .common import read, written

#: Keys are sums of this power of the letters' code points, modulo a prime, so that no word is too long for them.
POWER, MODULUS = 5, (1 << 61) - 1
#: Different words that a task counts before it hands them on; characters of text handled at once.
COUNTED, CHUNK = 400_000, 1 << 20
#: Rests of longer words are held as hashes of both parts (two rests share them with a chance of 2**-128).
LONG = 64

_RUN = re.compile("[A-Za-zÀ-ÿ]{5,}")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end between runs."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _OTHER.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def altered(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The misspellings that the query plants: of one (document, word) in 97 a letter goes. A null id counts as empty."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word, seed)
        if h % 97:
            return word
        text = word.decode()
        k = h % len(text)
        return (text[:k] + text[k + 1 :]).encode()

    return change


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, alter: Callable[[int | None], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """Rows (word, n): the words of five letters or more, A-Z in lower case, that occur `least` times or more in all texts.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF. alter(id) may change the words of a row, each form alike. Null and
    empty texts have no words; ids may be null or repeat, rows may repeat and count each time; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                change = alter(i) if alter else None
                for part in _parts(text.as_py() or ""):
                    own: Counter[bytes] = Counter()
                    for word, n in Counter(_RUN.findall(part)).items():
                        own[word.encode().lower()] += n  # of bytes, lower() changes A-Z alone
                    if change:
                        for word, n in own.items():
                            word = change(word)
                            if len(word) >= 5:
                                seen[word] += n
                    else:
                        seen.update(own)
                    if len(seen) > COUNTED:
                        yield table()
                        seen.clear()
        yield table()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= 5)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letter(c: Column) -> Column:
    return (F.pow(F.ascii(c).cast("double"), F.lit(POWER)).cast("long")) % MODULUS


def _letters(word: Column) -> Column:
    # split() with an empty pattern would leave an empty string behind the last letter
    return F.regexp_extract_all(word, F.lit("."), 0)


def _key(word: Column) -> Column:
    """The anagram key: c ** 5 is below 2**53 for these letters, so its double is exact."""
    return F.aggregate(_letters(word), F.lit(0).cast("long"), lambda total, c: (total + _letter(c)) % MODULUS)


def _less(key: Column, c: Column) -> Column:
    return F.pmod(key - _letter(c), F.lit(MODULUS))


def near_words(words: DataFrame) -> DataFrame:
    """Of words (word, n), each word once: (word, n_near, form, form_n) for those with a near word; ties by the smaller word.

    n_near: how many words differ from it by exactly one letter added, removed or replaced; form: the most frequent of
    these, form_n how often it occurs.
    """
    keyed = words.select("word", "n", _key(F.col("word")).alias("key"))
    # one row for a class of anagrams and each of its different letters, and one for the class itself
    classes = keyed.groupBy("key").agg(F.min("word").alias("word"))
    letters = classes.select("key", F.explode(F.array_distinct(_letters(F.col("word")))).alias("c"))
    less = written(letters.select("key", "c", _less(F.col("key"), F.col("c")).alias("less")), "less")
    meets = less.select("less").unionByName(classes.select(F.col("key").alias("less"))).groupBy("less").agg(F.count(F.lit(1)).alias("m"))
    meets = written(meets.where(F.col("m") > 1).select("less"), "meets")
    partners = less.join(meets, "less").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("letters"))
    own = classes.join(meets, F.col("key") == F.col("less"), "left_semi").select("key", F.lit(True).alias("itself"))
    wanted = written(partners.join(own, "key", "full"), "partners")
    some = keyed.join(wanted, "key").select("word", "n", "key", F.coalesce("letters", F.lit("")).alias("letters"), F.coalesce("itself", F.lit(False)).alias("itself"))

    word, at = F.col("word"), F.col("at")
    places = some.select("*", F.posexplode(_letters(word)).alias("at", "c")).where(F.contains("letters", F.col("c")))
    left, right = F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word))
    rest = F.when(F.char_length(word) > LONG, F.concat(F.md5(left), F.md5(right))).otherwise(F.concat(left, right))
    whole = F.concat(left, right)
    place = places.select(_less(F.col("key"), F.col("c")).alias("key"), "at", rest.alias("rest"), "word", "n", "c", whole.alias("whole"))
    # a place to exchange; and without the place, once for each streak of one letter
    exchanged = place.select("key", "at", "rest", F.lit(True).alias("longer"), "word", "n")
    short = lambda text: F.when(F.char_length(text) >= LONG, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)
    removed = place.where((at == 0) | (F.substring(word, at, F.lit(1)) != F.col("c"))).select("key", F.lit(-1).alias("at"), short(F.col("whole")).alias("rest"), F.lit(True).alias("longer"), "word", "n")
    itself = some.where("itself").select("key", F.lit(-1).alias("at"), short(word).alias("rest"), F.lit(False).alias("longer"), "word", "n")
    met = exchanged.unionByName(removed).unionByName(itself)
    member = F.struct((-F.col("n")).alias("m"), F.col("word").alias("word"))
    groups = met.groupBy("key", "at", "rest").agg(
        F.array_sort(F.collect_list(F.when(F.col("longer"), member))).alias("many"), F.max(F.when(~F.col("longer"), member)).alias("one"),
    )
    exchange = groups.where((F.col("at") >= 0) & (F.size("many") > 1)).select("many", F.posexplode("many").alias("k", "own"))
    other = F.when(F.col("k") == 0, F.get("many", F.lit(1))).otherwise(F.get("many", F.lit(0)))
    shorter = groups.where((F.col("at") < 0) & F.col("one").isNotNull() & (F.size("many") > 0))
    found = (
        exchange.select("own.word", (F.size("many") - 1).alias("near"), other.alias("best"))
        .unionByName(shorter.select("one.word", F.size("many").alias("near"), F.get("many", F.lit(0)).alias("best")))
        .unionByName(shorter.select(F.explode("many").alias("own"), "one").select("own.word", F.lit(1).alias("near"), F.col("one").alias("best")))
    )
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", F.col("n_near").cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """Of links (word, form) without circles: (word, root) with the last form that each word leads to, by doubling steps.

    Words whose end is known leave the rounds, so that what many words lead to is met by few rows.
    """
    now = written(forms.select("word", F.col("form").alias("to")), "steps")
    done = None
    for _ in range(rounds):
        seen = Observation()
        ends = now.select("word", "to").join(now.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        step = written(ends.select("word", "to", "next").observe(seen, F.count(F.when(F.col("next").isNotNull(), 1)).alias("open")), "steps")
        if not seen.get["open"]:
            break
        now = step.select("word", F.coalesce("next", "to").alias("to"))
    else:
        raise RuntimeError(f"roots: no end after {rounds} rounds")
    return step.select("word", F.col("to").alias("root"))


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Each row (word, n) with form, root, n_near and form_n.

    Words are told apart and are not null; n is not null. A word's form is the most frequent of its near words, the smaller
    of equally frequent ones, if it is at least `times` times (2 or more) as frequent; else null, and form_n with it. root: where forms lead
    from the word, itself if it has none. An empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = written(words.select("word", "n"), "words")
    met = words.join(near_words(words), "word", "left")
    holds = F.col("form_n") >= times * F.col("n")
    found = written(
        met.select("word", "n", F.when(holds, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("form_n")).alias("form_n")),
        "forms",
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants(word_counts(docs, alter=altered))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k:
      CAST(16 * (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs), crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), holes AS (
  SELECT word, n, word[1:i] || chr(1) || word[i + 2:] AS hole, word[1:i] || word[i + 2:] AS short FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.short
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.short
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.root AND e.form IS NULL
"""
