import math

import numpy as np
import pytest

from tests.llm.helpers import store
from vigil.llm import queries, whitening
from vigil.llm.common import table


def brute(vectors, k=4, scale=256):
    """Distinct quantised vectors, their covariance's eigenvectors, and exact deviations."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = {i: tuple(math.floor(scale * c) for c in v) + (0,) * (d - len(v)) for i, v in good}
    distinct = np.array(sorted(set(x.values())), float)
    n, sums = len(distinct), [sum(int(r[j]) for r in set(x.values())) for j in range(d)]
    far = distinct - distinct.mean(0)
    e, q = np.linalg.eigh(far.T @ far / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    e, q = e[e > 1e-12 * e[0]], q[:, : int((e > 1e-12 * e[0]).sum())]
    out = {}
    for i, row in x.items():
        white = (np.array(row, float) - distinct.mean(0)) @ q / np.sqrt(e)
        for c in range(len(e)):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(row, sums)), white[c], e[c] / np.trace(far.T @ far / n))
    return out


def compared(rows, expected, places=8, signs=True):
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == set(expected) and len(got) == len(rows)
    for c in {c for _, c in expected}:
        keys = [k for k in expected if k[1] == c]
        a, b = np.array([got[k].whitened for k in keys]), np.array([expected[k][2] for k in keys])
        assert not signs or min(np.abs(a - b).max(), np.abs(a + b).max()) < 10.0**-places
        assert all((got[k].n, got[k].deviation) == expected[k][:2] and abs(got[k].explained - expected[k][3]) < 1e-9 for k in keys)
    assert all(0 <= r.identity_error < 1e-8 for r in rows) and len({r.identity_error for r in rows}) <= 1


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")


def test_query_equals_brute_force(spark, sf):
    given = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    compared(queries.op12_whitening(spark, sf).collect(), brute(given))


@pytest.mark.parametrize("full", [whitening.FULL, 4])
def test_structured_vectors(spark, full):
    random = np.random.default_rng(3)
    x = random.standard_normal((400, 30)) * np.geomspace(8, 0.05, 30) @ np.linalg.qr(random.standard_normal((30, 30)))[0] + 50
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors += [(1000 + i, v) for i, (_, v) in enumerate(vectors[:40] * 3)]
    vectors += [(2000, None), (2001, [None] * 30), (2002, [float("nan")] + [0.0] * 29), (2003, [float("inf")] * 30), (2004, [1.0, -0.0]), (2005, []), (2006, [1e300] * 30)]
    found = whitening.components(frame(spark, vectors, "double"), full=full).collect()
    compared(found, brute([v for v in vectors if v[0] != 2006]))


@pytest.mark.parametrize("full", [whitening.FULL, 2])
def test_equal_deviations_are_all_found(spark, full):
    # plus and minus each axis: three axes of length 4, the others of length 1
    axes = [[(4.0 if i < 3 else 1.0) * s * (i == j) for j in range(12)] for i in range(12) for s in (1, -1)]
    vectors = list(enumerate(axes))
    found = whitening.components(frame(spark, vectors), full=full).collect()
    compared(found, brute(vectors), signs=False)
    white = {c: [r.whitened for r in sorted(found) if r.component == c] for c in (1, 2, 3, 4)}
    gram = np.array([[np.dot(white[a], white[b]) / len(axes) for a in white] for b in white])
    assert np.abs(gram - np.eye(4)).max() < 1e-9
    assert [round(float(v), 9) for v in sorted({r.component: r.explained for r in found}.values(), reverse=True)] == pytest.approx([16 / 57] * 3 + [1 / 57])


def test_few_vectors_and_low_rank(spark):
    line = [(i, [1.0 * i, 2.0 * i, 0.5]) for i in range(9)]
    compared(whitening.components(frame(spark, line)).collect(), brute(line))
    assert whitening.components(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    assert whitening.components(frame(spark, [(1, []), (2, None)])).count() == 0
    two = [(1, [0.5, 1.0]), (2, [0.25, 1.0]), (2, [0.25, 1.0])]
    assert whitening.components(frame(spark, two)).count() == 3


def test_large_numbers_stay_exact(spark):
    vectors = [(i, [float(2**40 * (i % 5)), float(i)]) for i in range(50)]
    rows = whitening.components(frame(spark, vectors, "double")).collect()
    expected = brute(vectors)
    assert all(r.deviation == (v if (v := expected[r.vec_id, r.component][1]) < 1 << 63 else None) for r in rows) and {r.n for r in rows} == {50}


def test_empty_and_clashing_names(spark, tmp_path):
    df = frame(spark, [(i, [0.1 * i, 0.2 * (i % 3)]) for i in range(9)]).selectExpr("*", "'own' AS white", "'own' AS x", "'own' AS whitened", "'own' AS at", "'own' AS data")
    model, d = whitening.fit(df)
    rows = whitening.apply(df, model, d, to="found").collect()
    assert all(r.white == r.x == r.whitened == r.at == "own" for r in rows) and len(rows) == 9
    assert queries.op12_whitening(spark, store(df.limit(0), tmp_path, "embeddings")).count() == 0
