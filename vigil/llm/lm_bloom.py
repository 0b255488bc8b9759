"""Language-model scoring with a log-frequency Bloom filter (operator 1).

Counts of n-grams are quantised: a count has as many levels as there are thresholds 1, 2, 3, 4, 6, 9, ...
(growing by half) that it reaches. A Bloom filter holds the pairs (n-gram, level) for all its levels, so
asking for level 1, 2, ... until one is missing gives the quantised count. The filter is blocked: the bits
of a pair are in one 64-bit word, so asking for a pair reads memory once. It goes to all tasks.

Its size follows from the number of pairs, which is counted first, and is bounded by ``most_bytes``. When
all pairs don't fit, it holds the n-grams seen L times or more, L the least power of two that fits. Those
below L stay in a table of exact counts: what the filter doesn't know of a text is joined with it. So every
n-gram counts at any size, and no key joins more than L - 1 times as training text.

Counting is by slices of the keys' range: a task counts some millions of n-grams, and hands on one row for
each slice with its keys and counts packed. A slice is summed in one task; there are as many slices as the
corpus needs for each to be small.

Probabilities are smoothed from order to order, from the unigrams up:
``p(w | h) = (low(h w) + MU * p(w | shorter h)) / (high(h) + MU)``, where low and high are the least and
the greatest count that a level stands for. As low(h w) sums to high(h) at most, they never sum to more
than 1, but for the filter's false hits.

The base score uses exact counts. Words with high counts, at most ``most_heavy`` of them by the choice of
the threshold, go to all tasks; tokens of rarer words are joined with their counts as tables.

A text's tokens are its words (A-Z in lower case) and one end. Results for special input: a null or empty
text has the end alone; a null id is never held out nor learned from; with no training text N and V are 0.
Rows are scored one by one, so repeated rows and ids each give a row (and each is learned from). Texts of
any length are cut into windows at white space, never shortened. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import GOLD, arrow_column, each_text, mix, text_batches, word_hashes, written

ORDER, PROBES, BITS_PER_PAIR, MU = 2, 5, 10, 20.0
#: Bytes of the filter, and number of words whose counts go to all tasks, at most.
MOST_BYTES, MOST_HEAVY = 128 << 20, 1 << 20
#: n-grams that a task counts before it hands them on; bytes of text for which there is a slice; least number of slices.
_HELD, _SLICE_BYTES, _LEAST_SLICES = 1 << 21, 32 << 20, 1024
#: Parts of the filter; each has its own part of the keys' range.
_MOST_REGIONS = 1 << 14
#: Hashes that stand for no word but by accident.
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_S32, _S33 = np.uint64(32), np.uint64(33)
_POWERS = 41


def _thresholds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * 1.5)))
    return np.array(out, np.int64)


THRESHOLDS = _thresholds()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, side="right")


def low(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, THRESHOLDS[np.maximum(levels, 1) - 1], 0)


def high(levels: np.ndarray) -> np.ndarray:
    return THRESHOLDS[levels] - 1


@dataclass
class Tokens:
    """The tokens of some texts: hashes one after the other, each one's place in its text, the texts' sizes."""

    flat: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        words, n = word_hashes(column)
        flat, sizes = np.insert(words, np.cumsum(n), END), n + 1
        return cls(flat, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes)

    def back(self, i: int) -> np.ndarray:
        """For each token the one ``i`` before it; begin marks stand before a text."""
        return np.where(self.place >= i, np.roll(self.flat, i), BEGIN) if i else self.flat

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the tokens' values for each text; no text is without a token."""
        return np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes) if len(self.sizes) else np.zeros(0)


def keys(parts: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams given their first tokens, second tokens and so on."""
    with np.errstate(over="ignore"):
        h = parts[0].copy()
        for x in parts[1:]:
            h = (h ^ (h >> _S33)) * GOLD + x
        return mix(h) + np.uint64(len(parts))


def grams(t: Tokens, n: int) -> np.ndarray:
    """Keys of the n-grams that end in each token."""
    return keys([t.back(i) for i in range(n - 1, -1, -1)])


def begin(n: int) -> np.ndarray:
    """Key of ``n`` begin marks, the history of a first token."""
    return keys([np.array([BEGIN])] * n)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


_PARTIAL = "slice int, kind int, h binary, c binary"
#: ``top``: highest count; ``pairs``: pairs of the n-grams that are seen 1, 2, 4, 8, ... times or more.
GATHERED = f"{_PARTIAL}, n bigint, total bigint, top bigint, pairs array<bigint>"


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between cuts as binaries, without a copy."""
    at = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _counter(order: int, bits: int):
    """Counts a task's tokens (kind 0) and longer n-grams (kind 1), some millions at a time, by the first bits of their keys."""

    def packed(kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        part = ((keys([h]) if kind == 0 else h) >> np.uint64(64 - bits)).astype(np.int32)
        if kind == 0:
            way = np.argsort(part, kind="stable")
            h, c, part = h[way], c[way], part[way]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        first = part[cuts[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), kind, np.int32)), _binaries(h, cuts), _binaries(c.astype(np.uint32), cuts)], names=["slice", "kind", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        n = 0
        for column in text_batches(batches):
            t = Tokens.of(column)
            held[0].append(t.flat)
            held[1].extend([grams(t, k) for k in range(2, order + 1)] + [np.repeat(begin(k), len(t.sizes)) for k in range(1, order)])
            n += len(t.flat) * order
            if n >= _HELD:
                yield from (packed(k, x) for k, x in enumerate(held) if x)
                held, n = ([], []), 0
        if held[0]:
            yield from (packed(k, x) for k, x in enumerate(held) if x)

    return run


def unpacked(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts; counts take 4 or 8 bytes each."""
    h = np.frombuffer(h, np.uint64)
    return h, np.frombuffer(c, np.uint32 if len(c) == 4 * len(h) else np.uint64).astype(np.int64)


def _summed(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, place = np.unique(np.concatenate([h for h, _ in rows]), return_inverse=True)
    c = np.zeros(len(h), np.int64)
    np.add.at(c, place, np.concatenate([c for _, c in rows]))
    return h, c


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of one slice and kind, which come one after the other."""

    def done(slice_: int, kind: int, rows: list) -> pa.RecordBatch:
        h, c = _summed(rows)
        own = np.bincount(np.log2(c + 0.5).astype(np.int64), level(c), _POWERS).astype(np.int64)
        pairs = np.cumsum(own[::-1])[::-1][:_POWERS]
        small = int(c.max()) < 1 << 32
        row = {"slice": slice_, "kind": kind, "h": h.tobytes(), "c": c.astype(np.uint32 if small else np.uint64).tobytes(), "n": len(h), "total": int(c.sum()), "top": int(c.max()), "pairs": pairs.tolist()}
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    now, rows, n = None, [], 0
    for b in batches:
        for slice_, kind, h, c in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (slice_, kind) != now:
                if rows:
                    yield done(*now, rows)
                now, rows, n = (slice_, kind), [], 0
            rows.append(unpacked(h, c))
            n += len(rows[-1][0])
            if n > 2 * _HELD:
                rows = [_summed(rows)]
                n = len(rows[0][0]) // 2  # so that the next sum comes after as many new ones at least
    if rows:
        yield done(*now, rows)


_SCHEMA = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("top", pa.int64()), ("pairs", pa.list_(pa.int64()))])


def gathered(texts: DataFrame, order: int = ORDER, *, slice_bytes: int = _SLICE_BYTES, least_slices: int = _LEAST_SLICES) -> tuple[DataFrame, int]:
    """Exact counts of all tokens and n-grams of one text column, a row for each slice and kind, and bits of a slice."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    bits = min(24, (max(least_slices, -(-size // slice_bytes)) - 1).bit_length())
    partial = texts.mapInArrow(_counter(order, bits), _PARTIAL)
    return written(partial.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_merged, GATHERED), "grams"), bits


@dataclass
class Size:
    """Tokens, different tokens, and pairs of the n-grams that are seen 1, 2, 4, 8, ... times or more."""

    n: int
    v: int
    pairs: list[int]

    @classmethod
    def of(cls, table: DataFrame) -> Size:
        plain = F.col("kind") == 0
        sums = [F.coalesce(F.sum(F.get("pairs", j)), F.lit(0)).alias(f"p{j}") for j in range(_POWERS)]
        r = table.agg(F.coalesce(F.sum(F.when(plain, F.col("total"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(plain, F.col("n"))), F.lit(0)).alias("v"), *sums).first()
        return cls(r.n, r.v, [r[f"p{j}"] for j in range(_POWERS)])

    def least(self, most_bytes: int, bits_per_pair: int = BITS_PER_PAIR) -> tuple[int, int]:
        """The least count that the filter holds, and its size in 64-bit words."""
        for j, pairs in enumerate(self.pairs):
            words = max(1, -(-pairs * bits_per_pair // 64))
            if words * 8 <= most_bytes:
                return 1 << j, words
        return 1 << _POWERS, 1


@dataclass
class Filter:
    """A Bloom filter of pairs (key, level): 64-bit words, region after region by the keys' first bits."""

    words: np.ndarray
    bits: int

    @property
    def width(self) -> int:
        return len(self.words) >> self.bits

    @staticmethod
    def places(keys: np.ndarray, step: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Word in the region and bits in the word of pairs."""
        one, low6 = np.uint64(1), np.uint64(63)
        with np.errstate(over="ignore"):
            x = mix(keys + np.uint64(step) * GOLD)
        mask = one << (x & low6)
        for i in range(1, PROBES):
            mask |= one << (x >> np.uint64(6 * i) & low6)
        return (x >> _S32) * np.uint64(width) >> _S32, mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """For each key, how many levels are there one after the other."""
        found = np.zeros(len(keys), np.int64)
        base = (keys >> np.uint64(64 - self.bits)) * np.uint64(self.width) if self.bits else np.zeros(len(keys), np.uint64)
        active, step = np.arange(len(keys)), 1
        while len(active):
            at, mask = self.places(keys, step, self.width)
            there = self.words[base + at] & mask == mask
            active, keys, base = active[there], keys[there], base[there]
            found[active] = step
            step += 1
        return found


def build(table: DataFrame, slice_bits: int, least: int, words: int) -> Filter:
    """The filter of the n-grams seen ``least`` times or more; ``words`` bounds what the driver gets."""
    bits = min(slice_bits, _MOST_REGIONS.bit_length() - 1, max(0, words.bit_length() - 4))
    width = -(-words // (1 << bits))
    rows = table.where(F.col("top") >= least).select(F.shiftright("slice", slice_bits - bits).alias("region"), "kind", "h", "c")
    if slice_bits > bits:
        rows = rows.repartition("region")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for region, kind, h, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                place = own.setdefault(region, np.zeros(width, np.uint64))
                h, c = unpacked(h, c)
                key, top = (keys([h]) if kind == 0 else h)[c >= least], level(c[c >= least])
                step = 1
                while len(key):
                    at, mask = Filter.places(key, step, width)
                    np.bitwise_or.at(place, at.astype(np.int64), mask)
                    step += 1
                    key, top = key[top >= step], top[top >= step]
        for region, place in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), pa.array([place.tobytes()], pa.binary())], names=["region", "words"])

    out = np.zeros(width << bits, np.uint64)
    for row in rows.mapInArrow(work, "region int, words binary").toLocalIterator():
        out[row.region * width : (row.region + 1) * width] |= np.frombuffer(row.words, np.uint64)
    return Filter(out, bits)


def exact(table: DataFrame) -> DataFrame:
    """(key, h, c): key of each token or n-gram and its count; h is a token's own hash, null for longer n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, h, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                h, c = unpacked(h, c)
                own = pa.array(h.view(np.int64)) if kind == 0 else pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array((keys([h]) if kind == 0 else h).view(np.int64)), own, pa.array(c)], names=["key", "h", "c"])

    return table.select("kind", "h", "c").mapInArrow(work, "key long, h long, c long")


@dataclass
class Model:
    filter: Filter
    n: int
    v: int
    order: int = ORDER
    least: int = 1

    def log10(self, t: Tokens, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 of the probability of each token after those before it in its text.

        The filter is asked once for each different n-gram. ``rare`` has sorted keys of n-grams below
        ``least`` and their counts.
        """
        found = self._levels(grams(t, 1), rare)
        p = (low(found) + 0.5) / (self.n + 0.5 * (self.v + 1))
        for k in range(2, self.order + 1):
            # a token's history is the shorter n-gram that ends in the token before
            history = np.where(t.place > 0, np.roll(found, 1), self._levels(begin(k - 1), rare))
            found = self._levels(grams(t, k), rare)
            whole = low(found)
            p = (whole + MU * p) / (np.maximum(high(history), whole) + MU)
        return np.log10(p)

    def missing(self, t: Tokens) -> list[np.ndarray]:
        """For each text, the different keys of its n-grams and histories that the filter doesn't hold."""
        first = [begin(k) for k in range(1, self.order)]
        out = [np.unique(np.concatenate([*first, *x])) for x in zip(*(each_text(grams(t, k), t.sizes) for k in range(1, self.order + 1)))]
        if not out:
            return []
        every = np.concatenate(out)
        gone = self._held(every) == 0
        return [x[g] for x, g in zip(out, each_text(gone, np.array([len(x) for x in out])))]

    def _held(self, keys: np.ndarray) -> np.ndarray:
        """Levels by the filter; fewer than those of ``least`` can only be false hits."""
        found = self.filter.levels(keys)
        return np.where(found >= level(self.least), found, 0)

    def _levels(self, keys: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        different, place = np.unique(keys, return_inverse=True)
        found = self._held(different)
        if rare is not None and len(rare[0]):
            at = np.minimum(np.searchsorted(rare[0], different), len(rare[0]) - 1)
            found = np.where((found == 0) & (rare[0][at] == different), level(rare[1][at]), found)
        return found[place]


@dataclass
class Heavy:
    """Exact counts of the words that are seen ``threshold`` times or more."""

    hashes: np.ndarray
    counts: np.ndarray
    threshold: int

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are here, and the counts of those; 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        known = self.hashes[at] == words
        return known, np.where(known, self.counts[at], 0)


def heavy_words(unigrams: DataFrame, most: int = MOST_HEAVY) -> Heavy:
    """The words with the highest counts. The threshold is a power of two that ``most`` words reach at most."""
    rows = unigrams.groupBy(F.floor(F.log2("c") + 1e-9).alias("log")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 at most
    threshold, n = 1, 0
    for r in sorted(rows, key=lambda r: -r.log):
        n += r.n
        if n > most:
            threshold = 2 << r.log
            break
    found = unigrams.where(F.col("c") >= threshold).select("h", "c").toArrow()
    h, c = (found.column(i).to_numpy() for i in (0, 1))
    h = h.view(np.uint64) if len(h) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    return Heavy(h[order], c[order] if len(c) else np.zeros(0, np.int64), threshold)


_SCORED = "struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rest:array<bigint>>"


def _scored(t: Tokens, model: Model, heavy: Heavy, rare: tuple[np.ndarray, np.ndarray] | None) -> pa.StructArray:
    words, place = np.unique(t.flat, return_inverse=True)
    known, c = heavy.of(words)
    now = known if heavy.threshold > 1 else np.ones(len(words), bool)
    base = np.where(now, np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1))), 0.0)[place]
    left = ~now[place]
    cuts = np.r_[0, np.cumsum(t.sums(left.astype(np.int64)))].astype(np.int32)
    rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(t.flat[left].view(np.int64)))
    columns = [pa.array(t.sizes), pa.array(t.sums(known[place].astype(np.int64)).astype(np.int64)), pa.array(t.sums(base)), pa.array(t.sums(model.log10(t, rare))), rest]
    return pa.StructArray.from_arrays(columns, ["n_tokens", "n_known", "base", "score", "rest"])


def _of_rare(h: pa.Array, c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts from lists of some texts."""
    keys_, at = np.unique(h.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
    return keys_, c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[at]


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = ORDER, most_bytes: int = MOST_BYTES, most_heavy: int = MOST_HEAVY) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    learned = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(text).alias("text"))
    table, slice_bits = gathered(learned, order)
    size = Size.of(table)
    least, words = size.least(most_bytes)
    unigrams = exact(table.where("kind = 0")).select("h", "c")
    heavy = heavy_words(unigrams, most_heavy)
    model = Model(build(table, slice_bits, least, words), size.n, size.v, order, least)
    sent = docs.sparkSession.sparkContext.broadcast((model, heavy))

    def asked(texts: pa.Array) -> pa.Array:
        return pa.array([x.view(np.int64) for x in sent.value[0].missing(Tokens.of(texts))], pa.list_(pa.int64()))

    def work(given: pa.Array) -> pa.Array:
        model, heavy = sent.value
        if model.least == 1:
            return _scored(Tokens.of(given), model, heavy, None)
        texts, h, c = given.flatten()
        return _scored(Tokens.of(texts), model, heavy, _of_rare(h, c))

    first = docs.select(F.col(key), held_out(key).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    given = F.col("text")
    if least > 1:
        first = written(first, "texts")  # the rows' numbers must stay
        asks = first.select("row", F.explode(arrow_column(asked, "array<bigint>", plain=True)(F.col("text"))).alias("key"))
        known = asks.join(exact(table).where(F.col("c") < least).select("key", "c"), "key")
        first = first.join(known.groupBy("row").agg(F.collect_list(F.struct("key", "c")).alias("rare")), "row", "left")
        none = F.array().cast("array<bigint>")
        given = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rare.key", none).alias("h"), F.coalesce("rare.c", none).alias("c"))
    scored = first.withColumn("s", arrow_column(work, _SCORED, plain=True)(given)).select(key, "held_out", "row", "s.*")
    whole = size.n + 0.5 * (size.v + 1)
    if heavy.threshold > 1:
        scored = written(scored, "scored")
        rest = scored.select("row", F.explode("rest").alias("h"))
        joined = rest.join(unigrams.where(F.col("c") < heavy.threshold), "h", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
        added = joined.groupBy("row").agg(F.sum(F.log10((F.col("c") + 0.5) / F.lit(whole))).alias("more"), F.count_if(F.col("c") > 0).alias("more_known"))
        scored = scored.join(added, "row", "left")
    else:
        scored = scored.withColumn("more", F.lit(0.0)).withColumn("more_known", F.lit(0))
    n_known, base = F.col("n_known") + F.coalesce("more_known", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0))
    return scored.select(key, "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(size.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
