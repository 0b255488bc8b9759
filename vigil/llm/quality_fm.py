"""Quality classifier: a factorisation machine (operator 5).

A document's features are its hashed words (logarithm of their frequency, scaled to unit length) and
bins of statistics of its structure and length. The machine adds a weight for each feature and, for each
pair of features, the product of their low-rank vectors. The sum over pairs needs no pairs: it is half
of (square of the sum less the sum of squares) for each factor, so scoring is linear in the features.

Training is spread over the cluster: in each round every partition of the labelled rows makes one pass
of AdaGrad from the current model, and the partitions' models are averaged by their rows. At most
``most_rows`` labelled rows are used, chosen by the hash of their id. Labels, lang, source and the id
are no features.

Results for special input: a null or empty text has bins alone as features and so one fixed score;
without any labelled row all scores are 0.5 (predicted 1). Rows are scored one by one, so repeated rows get
equal scores; of several labels of an id the highest counts, and each row of a labelled id is learned from.
Features are taken of whole texts of any length. The columns that are added (score, held_out, predicted, or
the name given as ``to``) replace those of the same name; all other columns stay.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import SPACES, arrow_column, written

BUCKETS, FACTORS = 1 << 14, 8
ROUNDS, PARTS, BATCH, RATE, DECAY = 8, 4, 32, 0.15, 2e-5
#: Labelled rows that training uses at most.
MOST_ROWS = 30_000
#: Statistic: edges of its bins.
EDGES = {
    "words": (1, 5, 15, 50, 100, 200, 400, 800, 2000, 5000),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9),
    "symbols": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "bars": (0.001, 0.01, 0.03, 0.08, 0.2, 0.4),
    "upper": (0.002, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6),
    "marks": (0.002, 0.01, 0.05, 0.2, 0.5, 0.9),
    "digits": (0.001, 0.005, 0.02, 0.05, 0.2),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97),
    "line_words": (1, 2, 4, 8, 16, 32, 64, 128),
    "same_lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "stops": (0.01, 0.04, 0.08, 0.15, 0.25, 0.4),
    "runs": (0.01, 0.03, 0.1, 0.3, 0.6),
    "top_word": (0.03, 0.05, 0.08, 0.12, 0.2, 0.4),
}
_FIRST = {name: BUCKETS + sum(len(e) + 1 for e in list(EDGES.values())[:i]) for i, name in enumerate(EDGES)}
SIZE = BUCKETS + sum(len(e) + 1 for e in EDGES.values())
_SPACE_TABLE = {ord(c): " " for c in SPACES}


class _Buckets(dict):
    """Bucket by word, some 10 MB at most: it starts anew when it is full, and long words aren't kept."""

    def __missing__(self, word: str) -> int:
        b = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = b
        return b


_buckets = _Buckets()


def statistics(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """Shares and means that describe how a text is built."""
    n, chars = max(1, len(words)), max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text.isascii() else sum(c.isupper() for c in text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "symbols": sum(map(text.count, "#*$%&<>{}~^")) / chars,
        "bars": text.count("|") / n,
        "upper": upper / chars,
        "marks": (text.count("!") + text.count("?")) / n,
        "digits": sum(map(text.count, "0123456789")) / chars,
        "distinct": len(counts) / n,
        "line_words": n / max(1, len(lines)),
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "stops": sum(w[-1] in ".!?" for w in words) / n,
        "runs": sum(map(str.__eq__, words, words[1:])) / n,
        "top_word": max(counts.values(), default=0) / n,
    }


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    index = np.fromiter(map(_buckets.__getitem__, counts), np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    bins = [_FIRST[k] + int(np.searchsorted(EDGES[k], v, side="right")) for k, v in statistics(text, words, counts).items()]
    share = np.full(len(bins), 1 / np.sqrt(len(bins)), np.float32)
    return np.r_[index, np.array(bins, np.int32)], np.r_[value, share].astype(np.float32)


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(SIZE, np.float32) if weights is None else weights
        self.factors = np.random.default_rng(7).normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32) if factors is None else factors

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(float(x["bias"]), x["weights"], x["factors"])

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of rows that begin at ``start``, and the sums of each factor; no row is empty."""
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat(vx * vx, start, axis=0)
        linear = np.add.reduceat(self.weights[index] * value, start)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1), total

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        found = [features(t) for t in texts]
        size = np.array([len(i) for i, _ in found])
        raw, _ = self.raw(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), np.r_[0, np.cumsum(size)[:-1]])
        return 1 / (1 + np.exp(-raw.astype(np.float64)))


def one_pass(model: Machine, rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int) -> Machine:
    """AdaGrad over the rows once, in an order that the seed fixes."""
    bias, w, v = model.bias, model.weights.astype(np.float64), model.factors.astype(np.float64)
    g_b, g_w, g_v = 1.0, np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2)
    order = np.random.default_rng(seed).permutation(len(rows))
    for at in range(0, len(order), BATCH):
        batch = [rows[i] for i in order[at : at + BATCH]]
        size = np.array([len(i) for i, _, _ in batch])
        index, x = np.concatenate([i for i, _, _ in batch]), np.concatenate([a for _, a, _ in batch]).astype(np.float64)
        y = np.array([t for _, _, t in batch])
        current = Machine(bias, w, v)
        raw, total = current.raw(index, x, np.r_[0, np.cumsum(size)[:-1]])
        error = (1 / (1 + np.exp(-raw)) - y) / len(batch)
        each = np.repeat(error, size)
        used, place = np.unique(index, return_inverse=True)
        d_w = np.bincount(place, each * x, len(used)) + DECAY * w[used]
        slope = (each * x)[:, None] * (np.repeat(total, size, axis=0) - v[index] * x[:, None])
        d_v = np.stack([np.bincount(place, slope[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
        d_b = error.sum()
        g_b += d_b * d_b
        g_w[used] += d_w * d_w
        g_v[used] += d_v * d_v
        bias -= RATE * d_b / np.sqrt(g_b)
        w[used] -= RATE * d_w / np.sqrt(g_w[used])
        v[used] -= RATE * d_v / np.sqrt(g_v[used])
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


_FEATURES = "struct<index:array<int>,value:array<float>>"


def _features_column(text: str) -> Column:
    def work(texts: list) -> pa.Array:
        found = [features(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["index", "value"])

    return arrow_column(work, _FEATURES, after=_buckets.clear)(F.col(text))


def train(labelled: DataFrame, *, text: str = "text", label: str = "label", key: str = "key", most_rows: int = MOST_ROWS, rounds: int = ROUNDS, parts: int = PARTS) -> Machine | None:
    """A machine from rows (key, text, label 0 or 1); None without rows."""
    rows = labelled.where(F.col(label).isNotNull())
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    made = rows.select(F.xxhash64(key).alias("h"), F.col(label).cast("double").alias("y"), _features_column(text).alias("f"))
    # rows go to parts by their hash, so that the number of models a round returns is ``parts`` on any cluster
    table = written(made.select("h", "y", "f.*", F.pmod("h", F.lit(parts)).cast("int").alias("part")).repartition(parts, "part"), "features")
    model = Machine()
    for r in range(rounds):
        sent = model.packed()

        def work(batches: Iterator[pa.RecordBatch], r: int = r, sent: bytes = sent) -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            for b in batches:
                for y, i, v, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
                    own.setdefault(p, []).append((i.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False), y))
            for p, rows in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([one_pass(Machine.unpacked(sent), rows, 1000 * r + p).packed()], pa.binary())], names=["n", "model"])

        spread = table.select("y", "index", "value", "part", "h").repartition(parts, "part").sortWithinPartitions("part", "h").drop("h")
        found = spread.mapInArrow(work, "n long, model binary").collect()
        if not found:
            return None
        share = np.array([x.n for x in found], np.float64) / sum(x.n for x in found)
        models = [Machine.unpacked(bytes(x.model)) for x in found]
        model = Machine(
            float(sum(s * m.bias for s, m in zip(share, models))),
            sum(s * m.weights for s, m in zip(share, models)).astype(np.float32),
            sum(s * m.factors for s, m in zip(share, models)).astype(np.float32),
        )
    return model


def score(docs: DataFrame, model: Machine | None, *, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the probability of label 1."""
    if model is None:
        return docs.withColumn(to, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model.packed())
    cache: dict[str, Machine] = {}

    def work(texts: list) -> pa.Array:
        if "m" not in cache:
            cache["m"] = Machine.unpacked(sent.value)
        return pa.array(cache["m"].scores(texts), pa.float64())

    return docs.withColumn(to, arrow_column(work, "double", after=_buckets.clear)(F.col(text)))


def remainder(key: str, by: int) -> Column:
    """The crc32 of the id as text modulo ``by``; of a null id it is null."""
    return F.crc32(F.col(key).cast("string")) % by


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Machine | None:
    """The machine learned from labelled documents that aren't held out. Of several labels of an id the highest counts."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label")).where(remainder("key", 3) != 1)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known, "key")
    return train(rows)


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Adds held_out, score and predicted."""
    out = score(docs, learn(docs, labels, key=key, text=text, label=label), text=text)
    return out.withColumn("held_out", F.coalesce(remainder(key, 3) == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
