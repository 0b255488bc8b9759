"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 12).

Vectors are quantised to whole numbers, floor(scale * entry). The components are fitted on each distinct vector once
and applied to all rows. With X the centred distinct vectors as rows, each step is one pass: the rows give
w = X v - beta u (u of the step before), and Spark adds up w'w, X'w and the products of w with all earlier u, by which
w and X'w are made orthogonal to them; the new v is made orthogonal to all earlier ones, twice. So every step costs one scan
and sends a few hundred numbers. Left vectors are never stored: each is X times a known combination of the v. The small
bidiagonal matrix's singular vectors give the components, its singular values their deviations. One more pass checks
the result and measures whitened's covariance.

The distinct vectors are written once, as blocks of packed integers, and each pass reads them. For up to ``full``
dimensions all steps are taken, which finds equal deviations too. Beyond, the steps end when the components have
converged to double precision; another run from a random vector orthogonal to them confirms that nothing larger, or equal,
is left, and takes it in if there is.

Results for special input: a null vector, or one with a null, NaN or infinite entry, or one whose quantised entries don't
fit a double exactly (2^53), is dropped; shorter vectors count as ended with zeros; repeated rows are counted once in the fit
and each has its results. Components whose variance is below 1e-12 of the largest aren't given: constant vectors and
empty tables have none, so no rows. A deviation too large for a long is null. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column, unused, written

#: Dimensions up to which all steps are taken.
FULL = 128
_BLOCK = 1 << 22
_TINY = 1e-12
_LOW = 1 << 26
_SEED = 20_240_101


@dataclass(frozen=True)
class Whitening:
    """Components as columns (dimensions x k), their variances, and the moments of the fit list."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float
    residual: float


def usable(vector: Column, scale: float) -> Column:
    """Whether all entries are there, finite and small enough."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < float(1 << 53))), F.lit(False))


def quantised(vector: Column, scale: float, dimensions: int) -> Column:
    """Whole numbers, with zeros up to the number of dimensions."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(vector)))


def _matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), d)


def _blocks(vectors: DataFrame, d: int) -> DataFrame:
    """The vectors as packed matrices of the smallest integers that hold them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), d)
            step = max(1, _BLOCK // (8 * d))
            parts = [x[i : i + step] for i in range(0, len(x), step)]
            kinds = [next(t for t in ("<i1", "<i2", "<i4", "<i8") if p.min() >= np.iinfo(t).min and p.max() <= np.iinfo(t).max) for p in parts]
            if parts:
                yield pa.record_batch([pa.array(kinds), pa.array([p.astype(k).tobytes() for p, k in zip(parts, kinds)], pa.binary())], ["kind", "data"])

    return written(vectors.mapInArrow(pack, "kind string, data binary"), "vector-blocks")


def _sums(blocks: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum of ``f`` over all blocks. Each task adds up its own and gives one row; Spark adds up the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64 if kind == "double" else np.int64)
        for b in batches:
            for t, data in zip(b.column(0).to_pylist(), b.column(1)):
                total += f(np.frombuffer(data.as_buffer(), t).reshape(-1, d))
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["v"])

    rows = blocks.select("kind", "data").mapInArrow(work, f"v array<{kind}>")
    found = rows.selectExpr(*(f"sum(v[{i}]) AS s{i}" for i in range(size))).first()
    return np.array([x or 0 for x in found], np.float64 if kind == "double" else object)


def _moments(x: np.ndarray) -> np.ndarray:
    """Rows, and sums of the entries in two halves, so that they stay exact."""
    x = x.astype(np.int64)
    return np.r_[len(x), (x // _LOW).sum(0), (x % _LOW).sum(0)]


class _Bidiagonal:
    """The state of a run: right vectors, how left vectors come from them, and the small matrix."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray, scale: float, locked: np.ndarray, seed: int):
        self.blocks, self.mean, self.d, self.scale, self.locked = blocks, mean, len(mean), scale, locked
        self.random = np.random.default_rng(seed)
        self.v = np.zeros((self.d, 0))
        self.t = np.zeros((0, 0))  # columns: left vectors as combinations of X v
        self.alpha, self.beta, self.left = [], [], []  # left: column of t of each step, or none
        self.xtu = np.zeros((self.d, 0))
        self.next = self._fresh()

    def _orthogonal(self, r: np.ndarray) -> np.ndarray:
        for basis in (self.locked, self.v, self.locked, self.v):
            r = r - basis @ (basis.T @ r)
        return r

    def _fresh(self) -> np.ndarray | None:
        """A random direction orthogonal to all, if one is left."""
        if self.v.shape[1] + self.locked.shape[1] >= self.d:
            return None
        r = self._orthogonal(self.random.standard_normal(self.d))
        r = self._orthogonal(r / np.linalg.norm(r))
        return r / np.linalg.norm(r)

    def step(self) -> bool:
        """One pass; false when the space is used up."""
        if self.next is None:
            return False
        j, beta = len(self.alpha), self.beta[-1] if self.beta else 0.0
        v, mean, n_left = np.column_stack([self.v, self.next]), self.mean, self.t.shape[1]
        t = np.vstack([self.t, np.zeros((1, n_left))])
        before = self.left[-1] if j and beta else None
        d = self.d

        def products(x: np.ndarray) -> np.ndarray:
            x = x - mean
            xv = x @ v
            u, w = xv @ t, xv[:, -1]
            if before is not None:
                w = w - beta * u[:, before]
            return np.r_[x.T @ w, w @ w, u.T @ w, np.zeros(d - n_left)]

        found = _sums(self.blocks, d, products, 2 * d + 1)
        z, c = found[:d] - self.xtu @ found[d + 1 : d + 1 + n_left], found[d + 1 : d + 1 + n_left]
        alpha = float(np.sqrt(max(0.0, found[d] - c @ c)))
        self.v, self.t = v, t
        if alpha > _TINY * self.scale:
            unit = np.zeros(j + 1)
            unit[j] = 1.0
            if before is not None:
                unit -= beta * t[:, before]
            self.t = np.column_stack([t, (unit - t @ c) / alpha])
            self.left.append(n_left)
            z = z / alpha
            self.xtu = np.column_stack([self.xtu, z])
        else:
            alpha, z = 0.0, np.zeros(d)
            self.left.append(None)
        r = self._orthogonal(z - alpha * self.next)
        beta = float(np.linalg.norm(r))
        self.alpha.append(alpha)
        if beta > _TINY * self.scale and self.left[-1] is not None and self.v.shape[1] + self.locked.shape[1] < d:
            self.beta.append(beta)
            self.next = r / beta
        else:  # an invariant space: go on in what is left
            self.beta.append(0.0)
            self.next = self._fresh()
        return self.next is not None

    def singular(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors, and how far each may be off, from the small matrix."""
        small = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        p, s, q = np.linalg.svd(small)
        return s, self.v @ q.T, self.beta[-1] * np.abs(p[-1])


def _leading(blocks: DataFrame, mean: np.ndarray, scale: float, k: int, full: int) -> np.ndarray:
    """The first ``k`` right singular vectors, in any order and perhaps with others."""
    d = len(mean)
    run = _Bidiagonal(blocks, mean, scale, np.zeros((d, 0)), _SEED)

    def converged(run: _Bidiagonal, wanted: int, within: float) -> bool:
        s, _, off = run.singular()
        if len(s) <= wanted:
            return False
        apart = np.abs(np.diff(s))
        near = np.minimum(np.r_[np.inf, apart[: wanted - 1]], apart[:wanted])
        return bool(np.all(off[:wanted] <= np.maximum(within * near, 1e-16 * s[0])))

    while run.step():
        if d > full and converged(run, k, 1e-14):
            break
    s, found, _ = run.singular()
    found, values = found[:, :k], s[:k]
    for seed in range(1, d):
        if run.next is None or found.shape[1] == d:
            break
        other = _Bidiagonal(blocks, mean, scale, found, _SEED + seed)
        while other.step() and not converged(other, 1, 1e-10):
            pass
        s, more, _ = other.singular()
        if s[0] <= np.sort(values)[-k] * (1 + 1e-9):
            break
        found, values = np.column_stack([found, more[:, :1]]), np.r_[values, s[0]]
    return np.linalg.qr(found)[0]


def fit(df: DataFrame, *, vector: str = "embedding", scale: float = 256.0, k: int = 4, full: int = FULL) -> tuple[Whitening, int]:
    """The first ``k`` components of the distinct quantised vectors, and the number of dimensions."""
    good = df.where(usable(F.col(vector), scale))
    d = int(good.agg(F.max(F.size(vector))).first()[0] or 0)
    none = Whitening(0, (0,) * d, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0)
    if not d:
        return none, d
    distinct = written(good.select(quantised(F.col(vector), scale, d).alias("x")).distinct(), "distinct-vectors")
    blocks = _blocks(distinct, d)
    whole = _sums(blocks, d, _moments, 2 * d + 1, "long")
    n, sums = int(whole[0]), tuple(int(a) * _LOW + int(b) for a, b in zip(whole[1 : d + 1], whole[d + 1 :]))
    mean = np.array([s / n for s in sums])
    total = float(_sums(blocks, d, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0])
    if not total:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0.0), d
    q = _leading(blocks, mean, float(np.sqrt(total)), k, full)
    # X'Xq once more: the small matrix of the found space settles the components, and shows how good they are
    m = q.shape[1]

    def check(x: np.ndarray) -> np.ndarray:
        x = x - mean
        y = x @ q
        return np.r_[(x.T @ y).ravel(), (y.T @ y).ravel(), y.sum(0)]

    found = _sums(blocks, d, check, d * m + m * m + m)
    xtxq, gram, drift = found[: d * m].reshape(d, m), found[d * m : d * m + m * m].reshape(m, m), found[d * m + m * m :]
    e, turn = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-e)[:k]
    best = best[e[best] > _TINY * e.max()]
    e, turn = e[best], turn[:, best]
    components = q @ turn
    signs = np.sign(components[np.abs(components).argmax(0), range(len(e))])
    residual = float(np.abs(xtxq @ turn - components * e).max() / e[0])
    cov = (turn.T @ (gram / n - np.outer(drift / n, drift / n)) @ turn) / np.sqrt(np.outer(e / n, e / n))
    return Whitening(n, sums, components * signs, e / n, total / n, float(np.abs(cov - np.eye(len(e))).max()), residual), d


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sum of (n x - S)^2 of each row, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 62:
        far = n * x - np.array(sums, np.int64)
        return pa.array((far * far).sum(1))
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def apply(df: DataFrame, model: Whitening, dimensions: int, *, vector: str = "embedding", scale: float = 256.0, to: str = "whitened") -> DataFrame:
    """The usable rows with a struct column: the deviation, and the whitened vector, whose entry i belongs to component i + 1.

    Longer vectors than the fitted ones aren't expected; they are dropped like unusable ones.
    """
    mean = np.array([s / max(1, model.n) for s in model.sums])
    turn = model.components / np.sqrt(model.variances) if len(model.variances) else np.zeros((dimensions, 0))

    def work(lists: pa.ListArray) -> pa.Array:
        x = _matrix(lists, dimensions)
        y = (x - mean) @ turn
        white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
        return pa.StructArray.from_arrays([_deviations(x, model.n, model.sums), white], ["deviation", "whitened"])

    good = df.where(usable(F.col(vector), scale) & (F.size(vector) <= dimensions))
    x = quantised(F.col(vector), scale, dimensions)
    return good.withColumn(to, arrow_column(work, "deviation long, whitened array<double>", step=4096, plain=True)(x))


def components(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, k: int = 4, full: int = FULL) -> DataFrame:
    """A row for each usable vector and component."""
    model, d = fit(df, vector=vector, scale=scale, k=k, full=full)
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    if not len(model.variances):
        model, d = Whitening(model.n, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0), 0
    to = unused(rows, "white")
    found = apply(rows, model, d, vector="vector", scale=scale, to=to)
    found = found.select("vec_id", F.col(to)["deviation"].alias("deviation"), F.posexplode(F.col(to)["whitened"]).alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e / model.total)) for e in model.variances)) if len(model.variances) else F.array(F.lit(0.0))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
