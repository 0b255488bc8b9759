import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import AWKWARD
from vigil.llm import common


def test_word_hashes_equal_splitting():
    r = random.Random(1)
    letters = ["a", "B", "é", "日", " ", " ", "\n", "\t", "\x0b", "\x00", "😀"]
    texts = [*AWKWARD, *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(400)), "x" * 300_000, " " * 300_000, "y z " * 100_000, "tail"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["cut", *texts]).slice(1)):
        hashes, sizes = common.word_hashes(column)
        words = [(t or "").encode().lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in words]
        known = {}
        for word, h in zip((w for x in words for w in x), hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)
    assert len(common.word_hashes(pa.array([], pa.string()))[1]) == 0
    assert [len(x) for x in common.each_text(*common.word_hashes(pa.array(["a b", None, "c"])))] == [2, 0, 1]


def test_hashes_differ_by_order_and_repeats():
    h = lambda t: common.word_hashes(pa.array([t]))[0].tolist()
    assert h("ab ba aab abb a aa aaa") != h("ba ab aab abb a aa aaa") and len(set(h("ab ba aab abb a aa aaa"))) == 7
    assert h("ÀB") == h("Àb") and h("À") != h("à")
    grams = common.gram_hashes(np.array(h("a b a b"), np.uint64), 2)
    assert grams[0] == grams[2] != grams[1]
