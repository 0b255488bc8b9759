import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents, store
from vigil.llm import lm_bloom, queries


def expected(rows):
    c = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), "END"]
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    one = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return n, [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), sum(map(one, words(t)))) for i, t in rows]


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [" ".join(words[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randint(0, 60))) for _ in range(n)]


def check(found, rows):
    n, want = expected(rows)
    key = lambda x: (str(x[0]), x[1], round(x[3], 6))
    got = sorted(((x.doc_id, x.n_tokens, x.n_known, x.base_score) for x in found), key=key)
    assert len(got) == len(want) and all(x.train_tokens == n for x in found)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 * max(1, abs(b[3]))


def test_base_score_equals_counting(spark, tmp_path):
    rows = list(enumerate(AWKWARD + corpus(1, 150), 1)) + [(None, "w1 w2"), (3, "w1"), (3, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = queries.op1_lm_bloom(spark, store(df.repartition(3), tmp_path)).collect()
    check(found, rows)
    # with few words sent, the rest are joined
    check(lm_bloom.score(df, most_heavy=20).collect(), rows)


def test_probabilities_and_gain(spark, tmp_path):
    texts = ["the cat sat on the mat and the dog ran off"] * 30 + corpus(2, 100)
    r = {x.doc_id: x for x in queries.op1_lm_bloom(spark, store(documents(spark, texts), tmp_path)).collect()}
    assert all(x.score < 0 for x in r.values())
    held = [x for i, x in r.items() if x.held_out and i <= 30]
    assert held and all(x.score > x.base_score for x in held)


def tokens(*texts):
    return lm_bloom.Tokens.of(pa.array(texts, pa.string()))


def test_tokens_and_keys_of_each_text_are_its_own():
    texts = ["a B c", None, "", "c  b\na", "é\u3000A"]
    t = tokens(*texts)
    assert t.sizes.tolist() == [4, 1, 1, 4, 2] and t.place.tolist() == [0, 1, 2, 3, 0, 0, 0, 1, 2, 3, 0, 1]
    for k in (1, 2, 3):
        alone = np.concatenate([lm_bloom.grams(tokens(x), k) for x in texts])
        assert (lm_bloom.grams(t, k) == alone).all()
    flat = t.flat.tolist()
    assert flat[:4] == [flat[8], flat[7], flat[6], int(lm_bloom.END)]
    assert lm_bloom.grams(t, 2)[0] == lm_bloom.keys([np.array([lm_bloom.BEGIN]), t.flat[:1]])[0]


def test_filter_holds_levels_and_sums_to_one(spark):
    docs = documents(spark, [t for t in corpus(3, 200) if t])
    texts = docs.select("text")
    t = tokens(*(x.text for x in texts.collect()))
    table, bits = lm_bloom.gathered(texts, slice_bytes=64)
    size = lm_bloom.Size.of(table)
    assert size.n == len(t.flat) and size.v == len(np.unique(t.flat))
    f = lm_bloom.build(table, bits, 1, size.least(lm_bloom.MOST_BYTES)[1])
    every = np.concatenate([lm_bloom.grams(t, 1), lm_bloom.grams(t, 2), np.repeat(lm_bloom.begin(1), len(t.sizes))])
    exact = Counter(every.tolist())
    assert exact == {x.key % 2**64: x.c for x in lm_bloom.exact(table).collect()}
    assert size.pairs[0] == lm_bloom.level(np.array(list(exact.values()))).sum()
    keys = np.array(list(exact), np.uint64)
    levels, true = f.levels(keys), lm_bloom.level(np.array([exact[k] for k in keys.tolist()]))
    assert (levels >= true).all() and (levels == true).mean() > 0.9
    m = lm_bloom.Model(f, size.n, size.v)
    words = sorted({w for x in texts.collect() for w in x.text.split()})
    history = words[0]
    total = sum(10 ** m.log10(tokens(f"{history} {w}"))[1] for w in words) + 10 ** m.log10(tokens(history))[1]
    assert 0.3 < total < 1.1
    assert (lm_bloom.low(lm_bloom.level(np.arange(1, 99))) <= np.arange(1, 99)).all() and (lm_bloom.high(lm_bloom.level(np.arange(1, 99))) >= np.arange(1, 99)).all()


def test_bound_raises_the_least_count(spark):
    pairs = [10**9 >> j for j in range(20)]
    least, words = lm_bloom.Size(10**9, 10**6, pairs).least(1 << 20)
    assert least > 1 and words * 8 <= 1 << 20
    docs = documents(spark, corpus(4, 60))
    check(lm_bloom.score(docs, most_bytes=4096).collect(), [(x.doc_id, x.text) for x in docs.collect()])


@pytest.mark.parametrize("most_bytes", [2048, 1 << 27])
def test_scores_equal_brute_force_with_and_without_the_count_table(spark, most_bytes):
    rows = list(enumerate(["", *corpus(5, 400)], 1))
    learned = tokens(*(t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1))
    n, v = len(learned.flat), len(np.unique(learned.flat))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table, bits = lm_bloom.gathered(docs.where(~lm_bloom.held_out("doc_id")).select("text"))
    least, words = lm_bloom.Size.of(table).least(most_bytes)
    kept = lm_bloom.build(table, bits, least, words)
    assert (least > 1) == (most_bytes == 2048)
    c = Counter(k for o in (1, 2) for k in lm_bloom.grams(learned, o).tolist())
    c[int(lm_bloom.begin(1)[0])] = len(learned.sizes)
    assert least == 1 or sum(0 < x < least for x in c.values()) > len(c) / 2

    def of(keys):
        counts = np.array([c[k] for k in keys.tolist()])
        return np.where(counts >= least, kept.levels(keys), lm_bloom.level(counts))

    def exact(text):
        t = tokens(text)
        one, two = of(lm_bloom.grams(t, 1)), of(lm_bloom.grams(t, 2))
        history = np.r_[of(lm_bloom.begin(1)), one[:-1]]
        p = (lm_bloom.low(one) + 0.5) / (n + 0.5 * (v + 1))
        whole = lm_bloom.low(two)
        return float(np.log10((whole + lm_bloom.MU * p) / (np.maximum(lm_bloom.high(history), whole) + lm_bloom.MU)).sum())

    found = lm_bloom.score(docs, most_bytes=most_bytes).collect()
    check(found, rows)
    want = {i: exact(t) for i, t in rows}
    near = [abs(x.score - want[x.doc_id]) < 1e-9 * max(1, abs(x.score)) for x in found]
    assert np.mean(near) > 0.9, np.mean(near)  # the rest are false hits of the filter
    assert all(abs(x.score - want[x.doc_id]) < 0.05 * abs(x.score) + 1 for x in found)


def test_packed_counts_are_summed_in_any_order():
    r = np.random.default_rng(1)
    parts = [np.unique(r.integers(0, 2**63, 50) % 80, return_counts=True) for _ in range(9)]
    whole = Counter()
    for h, c in parts:
        whole.update(dict(zip(h.tolist(), c.tolist())))
    h, c = lm_bloom._summed([(h.astype(np.uint64), c) for h, c in parts])
    assert dict(zip(h.tolist(), c.tolist())) == whole


def test_long_texts_and_words(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000)) + " " + "z" * 600_000 + " end"
    rows = [(1, long), (2, "w1 w2"), (3, "z" * 600_000), (7, long)]
    check(lm_bloom.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_empty(spark):
    assert lm_bloom.score(documents(spark, [])).count() == 0
