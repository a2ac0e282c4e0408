"""Documents with everything that may go wrong, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def some_text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


def edge_rows(seed: int = 0) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, unusual characters, ties."""
    rng = random.Random(seed)
    plain = [some_text(rng, rng.randrange(60, 200)) for _ in range(12)]
    texts = [
        None, "", "   \n\t ", "one", "one two three", "é ü 漢字 😀  x\r\ny", "a\x00b c", "x" * 50_000, some_text(rng, 30_000), "same line\n" * 40,
        *plain, plain[0], plain[0], plain[1].replace("w1 ", "w2 "), "#*$ | <> " * 30,
    ]
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "é", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, plain[2], None, None, None), (None, None, None, None, None)]
    return rows


#: Names that the operators use inside or for results.
NAMES = """
id size path n h node root _b shard host rule line kept a b item_id score links sig sha key k1 k2 sk b h none turn weight cut_b cut_h cut_size cut_words whole rest target
source_size taken words g piece crc run place begins first rows i slot law text_crc32 grown_shard n_lines n_removed clean_text gone site gapless_b gapless_n gapless_i gapless_o
ranked_p ranked_i ranked_o c0 c1 c2 c99 _metadata _h _sk _size _rest _whole _at _g _o _s1 _i _bin _id _gone _kept _key _n block copies m total label class_id n_links
""".split()


def clashing(df):
    """The same rows with further columns whose names operators might use inside, each with a value of its own."""
    from pyspark.sql import functions as F

    names = [c for c in dict.fromkeys(NAMES) if c not in df.columns]
    return df.select("*", *[F.lit(-k if k % 2 else f"extra {k}").alias(c) for k, c in enumerate(names)])
