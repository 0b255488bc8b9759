import hashlib
import random
import re

import numpy as np

from tests.llm.helpers import AWKWARD, documents, store
from vigil.llm import queries, winnowing


def words_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for i, t in items:
        own = words_of(t)
        size = min(10, len(own))
        windows = {tuple(own[s : s + size]) for s in range(len(own) - size + 1)} if size else set()
        for s in range(len(words) - size + 1):
            if size and tuple(words[s : s + size]) in windows:
                hit.update(range(s, s + size))
                found.add(str(i))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Gam,ma", "délta", "e5", "zêta-eta", "x"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(14)] + [(20, None), (3, text(12)), (21, "x " * 40)]
    docs = AWKWARD + ["x " * 100, items[5][1]]
    for _ in range(60):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            own = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(own) - 1))
            parts += [" ".join(own[a : a + r.randint(5, 30)]), text(r.randint(0, 9))]
        docs.append(" ".join(parts))
    return docs, items


def test_no_shared_span_is_missed():
    r = np.random.default_rng(1)
    for _ in range(200):
        shared = r.integers(0, 2**63, 10).astype(np.uint64)
        a = np.concatenate([r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64), shared, r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64)])
        b = np.concatenate([r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64), shared, r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64)])
        assert np.intersect1d(winnowing.fingerprints(a)[1], winnowing.fingerprints(b)[1]).size


def test_both_ways_equal_brute_force(spark, tmp_path):
    docs, items = corpus(2)
    docs += docs[-3:]
    sf = store(documents(spark, docs), tmp_path)
    bench = spark.createDataFrame(items, "item_id long, text string")
    store(bench, tmp_path, "benchmark")
    expected = sorted((i + 1, *plain(t, items)) for i, t in enumerate(docs))
    row = lambda r: (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    assert sorted(map(row, queries.op10_winnowing(spark, sf).collect())) == expected
    joined = winnowing.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), bench, bound=0).select("doc_id", "leak.*")
    assert sorted(map(row, joined.collect())) == expected


def test_empty_tables(spark):
    docs, none = documents(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    for bound in (winnowing.BOUND, -1):
        out = winnowing.decontaminate(docs.withColumnRenamed("lang", "items"), none, bound=bound)
        assert [(r.doc_id, r.leak.n_hit) for r in out.orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
        assert winnowing.decontaminate(documents(spark, []), none, bound=bound).count() == 0
