import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents, store
from vigil.llm import queries, quality_fm


def test_pairs_identity():
    r = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, r.normal(size=quality_fm.SIZE).astype(np.float32), r.normal(size=(quality_fm.SIZE, quality_fm.FACTORS)).astype(np.float32))
    for text in ("the cat sat on the mat", "", "A!! B!! | c"):
        index, x = quality_fm.features(text)
        raw = m.bias + sum(m.weights[i] * a for i, a in zip(index, x))
        raw += sum(x[a] * x[b] * (m.factors[index[a]] @ m.factors[index[b]]) for a in range(len(x)) for b in range(a))
        assert abs(1 / (1 + np.exp(-raw)) - m.scores([text])[0]) < 1e-4


def test_gradient_lowers_the_loss():
    rows = [(*quality_fm.features(t), y) for t, y in [("good plain words here", 1.0), ("BAD!! JUNK!! |", 0.0)] * 8]
    loss = lambda m: sum(np.log1p(np.exp(-(2 * y - 1) * m.raw(i, x, np.array([0]))[0][0])) for i, x, y in rows)
    m = quality_fm.Machine()
    before = loss(m)
    for s in range(3):
        m = quality_fm.one_pass(m, rows, s)
    assert loss(m) < before / 2


def brute_force(rows, keys, rounds, parts):
    """The same training with sums over all pairs of features: rows are (features, label), keys the hashes of their ids."""
    start = quality_fm.Machine()
    b, w, v = 0.0, start.weights.copy(), start.factors.copy()
    for r in range(rounds):
        found = []
        for part in range(parts):
            own = [rows[i] for i in sorted(range(len(rows)), key=lambda i: keys[i]) if keys[i] % parts == part]
            if not own:
                continue
            pb, pw, pv = b, w.astype(float), v.astype(float)
            gb, gw, gv = 1.0, np.full(len(w), 0.01), np.full(v.shape, 0.01)
            order = np.random.default_rng(1000 * r + part).permutation(len(own))
            for at in range(0, len(order), quality_fm.BATCH):
                batch, db, dw, dv = [own[i] for i in order[at : at + quality_fm.BATCH]], 0.0, {}, {}
                for f, y in batch:
                    raw = pb + sum(pw[i] * x for i, x in f) + sum(x * z * (pv[i] @ pv[j]) for n, (i, x) in enumerate(f) for j, z in f[:n])
                    error = (1 / (1 + np.exp(-raw)) - y) / len(batch)
                    db += error
                    for n, (i, x) in enumerate(f):
                        others = sum(z * pv[j] for m, (j, z) in enumerate(f) if m != n)
                        dw[i], dv[i] = dw.get(i, 0.0) + error * x, dv.get(i, 0.0) + error * x * others
                gb += db * db
                pb -= quality_fm.RATE * db / np.sqrt(gb)
                for i in dw:
                    sw, sv = dw[i] + quality_fm.DECAY * pw[i], dv[i] + quality_fm.DECAY * pv[i]
                    gw[i] += sw * sw
                    gv[i] += sv * sv
                    pw[i] -= quality_fm.RATE * sw / np.sqrt(gw[i])
                    pv[i] -= quality_fm.RATE * sv / np.sqrt(gv[i])
            found.append((len(own), pb, pw, pv))
        n = sum(x[0] for x in found)
        b, w, v = (sum(x[0] / n * x[k] for x in found) for k in (1, 2, 3))
    return b, w, v


def test_training_equals_brute_force_over_pairs(spark):
    """Parts, rounds, averages and scores, with repeated rows, an empty text and a text with one word many times."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma!", "Delta", "#x"]) + str(r.randrange(4)) for _ in range(r.randint(1, 7))) for _ in range(70)]
    texts = ["", None, "word " * 500, texts[0], texts[0], *texts]
    labelled = [(i, t, int(t is not None and "!" not in t)) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(labelled, "key long, text string, label int")
    keys = [x.h for x in rows.select("key", F.xxhash64("key").alias("h")).orderBy("key").collect()]
    machine = quality_fm.train(rows, rounds=3, parts=3)
    listed = [[(int(i), float(x)) for i, x in zip(*quality_fm.features(t))] for t in texts]
    b, w, v = brute_force([(f, y) for f, (_, _, y) in zip(listed, labelled)], keys, 3, 3)
    assert abs(machine.bias - b) < 1e-4 and np.abs(machine.weights - w).max() < 1e-4 and np.abs(machine.factors - v).max() < 1e-4
    raw = [b + sum(w[i] * x for i, x in f) + sum(x * z * (v[i] @ v[j]) for n, (i, x) in enumerate(f) for j, z in f[:n]) for f in listed]
    scored = {x.key: x.score for x in quality_fm.score(rows, machine).collect()}
    assert all(abs(scored[k] - 1 / (1 + np.exp(-y))) < 1e-4 for k, y in enumerate(raw)) and len(set(scored.values())) > 30


def test_query_learns_and_holds_out(spark, tmp_path):
    r = random.Random(2)
    texts = list(AWKWARD)
    for i in range(300):
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(30)) for _ in range(r.randint(20, 60))]
        texts.append(" ".join(w.upper() + "!!" for w in words) if i % 3 == 0 else " ".join(words) + ".")
    docs = documents(spark, texts).withColumn("score", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    sf = store(docs, tmp_path)
    labels = [(i, int(not t.endswith("!!")), 0) for i, t in enumerate(texts, 1) if i > len(AWKWARD)] + [(2, None, 0), (9999, 1, 0)]
    store(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    rows = queries.op5_quality_fm(spark, sf).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    truth = {i: q for i, q, _ in labels}
    held = [x for x in rows if x.held_out and truth.get(x.doc_id) is not None]
    assert len(held) > 50 and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    # labels of held-out rows are never used
    store(spark.createDataFrame([(i, 1 - q if q is not None and zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    again = {(x.doc_id, x.score) for x in queries.op5_quality_fm(spark, sf).collect()}
    assert {(a, round(b, 6)) for a, b in again} == {(x.doc_id, round(x.score, 6)) for x in rows}


def test_no_labels_and_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    store(none, tmp_path, "labels")
    assert [r.score for r in queries.op5_quality_fm(spark, store(documents(spark, ["a"]), tmp_path)).collect()] == [0.5]
    assert queries.op5_quality_fm(spark, store(documents(spark, []), tmp_path)).count() == 0
