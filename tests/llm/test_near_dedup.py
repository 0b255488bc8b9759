import random

import numpy as np
import pyarrow as pa

from tests.llm.helpers import AWKWARD, documents, store
from vigil.llm import near_dedup, queries
from vigil.llm.components import components
from vigil.llm.minhash import shingles, signatures


def edited(words, r, rate):
    return " ".join(w if r.random() > rate else f"x{r.randrange(10**9)}" for w in words)


def brute(rows, k, percent):
    """rows of (id, text) to {id: component}: all pairs, then reachability."""
    sets = {}
    for i, t in rows:
        w = tuple((t or "").encode().lower().split())
        size = min(k, len(w))
        sets.setdefault(i, set()).add(frozenset(w[j : j + size] for j in range(len(w) - size + 1)) if size else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_signature_estimates_similarity_with_less_variance():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, own = r.integers(0, 2**63, 60).astype(np.uint64), r.integers(0, 2**63, 40).astype(np.uint64)
        a, b = np.unique(np.r_[common, own[:20]]), np.unique(np.r_[common, own[20:]])
        x = signatures([a, b], 130)
        errors.append((x[0] == x[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.6 * 0.4 / 130


def test_signature_of_one_set_alone_and_in_company():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 3, 7, 60, 500, 4000)] + [np.zeros(0, np.uint64)]
    together = signatures(sets, 130)
    for s, row in zip(sets, together):
        assert (signatures([s], 130)[0] == row).all()
    assert (together[0] < np.uint64(130 << 32)).all() and len(set((together[0] >> np.uint64(32)).tolist())) == 130


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(160, 159), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_brute_force(spark, tmp_path):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 3)
    texts = list(AWKWARD)
    for _ in range(6):
        base = [word() + str(r.randrange(50)) for _ in range(r.randint(20, 90))]
        texts += [" ".join(base)] * 2 + [edited(base, r, rate) for rate in (0.01, 0.02, 0.03, 0.04, 0.05, 0.08) for _ in range(4)]
    base = [f"w{i}" for i in range(200)]
    texts += [edited(base, r, 0.02) for _ in range(40)]  # copies of a text that isn't there
    r.shuffle(texts)
    rows = list(enumerate(texts, 1)) + [(3, "another text of the third"), (5, texts[4]), (900, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = brute(rows, 3, 85)
    found = queries.op8_near_dedup(spark, store(df.repartition(3), tmp_path)).collect()
    assert len(found) == len(rows)
    assert {x.doc_id: x.component_id for x in found} == expected
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)
    assert sorted((x.doc_id, x.n_shingles) for x in found) == sorted((i, len(own)) for (i, _), own in zip(rows, shingles(pa.array([t for _, t in rows]), 3)))


def test_keep_one(spark):
    same = "one two three four five six seven eight"
    df = documents(spark, [None, same, same.upper(), "other words that are here alone", ""]).withColumnRenamed("lang", "component_id")
    df = df.unionByName(df.where("doc_id = 2")).unionByName(df.where("doc_id = 1").withColumn("doc_id", df.n_chars.cast("long") * 0).selectExpr("cast(null as long) doc_id", "text", "component_id", "source", "n_chars"))
    out = near_dedup.keep_one(df)
    assert sorted(map(str, (x.doc_id for x in out.collect()))) == ["1", "2", "4", "5", "None"] and out.columns == df.columns
    assert near_dedup.keep_one(documents(spark, [])).count() == 0


def test_bands_keep_the_chance_of_a_miss():
    for percent in (60, 80, 85, 95, 100):
        n = near_dedup.bands(percent)
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** n <= 1 / 2_000_000
    assert near_dedup.bands(85) == 26 and near_dedup.bands(80) == 37
