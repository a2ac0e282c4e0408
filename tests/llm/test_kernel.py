import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import kernel, quality_rules

from .cases import edge_rows, some_text, words


def texts():
    rng = random.Random(4)
    return [r[1] for r in edge_rows()] + [some_text(rng, rng.randrange(0, 40), 5) for _ in range(50)]


@pytest.mark.parametrize("most", [1, 50, 1 << 21])
def test_words_and_shingles(most):
    own = texts()
    seen = 0
    for lo, hi, block in kernel.blocks(pa.array(own), most):
        begin, end, first = block.words
        names, at = kernel.shingles(block, 5)
        for k in range(hi - lo):
            got = [bytes(block.data[b:e]).decode() for b, e in zip(begin[first[k] : first[k + 1]], end[first[k] : first[k + 1]], strict=True)]
            w = words(own[lo + k])
            assert got == w
            want = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            assert at[k + 1] - at[k] == len(want)
        seen += hi - lo
    assert seen == len(own)


def test_equal_sets_have_equal_names():
    a, b = "a b c d e f", "x a b c d e f"
    (_, _, block), = kernel.blocks(pa.array([a, b, a + " g"]))
    names, at = kernel.shingles(block, 5)
    sets = [set(names[at[k] : at[k + 1]].tolist()) for k in range(3)]
    assert sets[0] < sets[1] and sets[0] < sets[2] and len(sets[1] & sets[2]) == 2


def features(text):
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("most", [1, 300, 1 << 21])
def test_features(most):
    own = texts()
    for lo, hi, block in kernel.blocks(pa.array(own, pa.string()), most):
        f = quality_rules.Features(block)
        got = np.stack([f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words], 1)
        assert [tuple(x) for x in got.tolist()] == [features(t) for t in own[lo:hi]]


def test_take_and_whole_groups():
    (_, _, block), = kernel.blocks(pa.array(["a b", "", "c", "d e f"]))
    part = block.take(np.array([0, 3]))
    assert bytes(part.data) == b"a bd e f" and np.diff(part.words[2]).tolist() == [2, 3]
    batches = [pa.RecordBatch.from_pydict({"k": x, "v": x}) for x in ([1, 1, 2], [2, 2], [2, 3], [4])]
    groups = [t.column("v").to_pylist()[lo:hi] for t, at in kernel.whole_groups(iter(batches), ["k"]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    assert groups == [[1, 1], [2, 2, 2, 2], [3], [4]]
    assert list(kernel.whole_groups(iter([]), ["k"])) == []


def test_labels():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert kernel.labels(linked).tolist() == [0, 1, 1, 0, 4, 0]
