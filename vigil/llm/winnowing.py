"""Benchmark decontamination by winnowing (operator 10).

A text's fingerprints are the least hash of its K-word grams in each run of SPAN - K + 1 grams (the
rightmost at a tie). Two texts that share SPAN words in a row share the grams in there, so the same
least hash: no shared span of that length is missed, though only about a third of the grams are kept.
Fingerprints of documents and benchmark items are joined; a hit is then extended to the SPAN-word
windows around it, which must be windows of an item as a whole. Items of fewer words are one window
each, and all grams of their length count as fingerprints.

Two ways give the same rows. While the benchmark is below ``bound`` bytes its index is sent to all
tasks; above it, both sides' fingerprints are shuffled and joined as tables.

Results for special input: a null text has no words; an item without words or without an id takes no
part; items with one id count once; rows of documents are judged one by one, repeated or not. A span that
several items share counts for each. Texts of any length are read as a whole. The struct column is added under
the given name, in place of a column of that name; all other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column, byte_codes, each_text, gram_hashes, unused, word_hashes, written

SPAN, K = 10, 5
#: Bytes of benchmark text up to which its index goes to all tasks; it takes about four times as much.
BOUND = 32 << 20
#: A word is a run of 0-9, a-z after lower-casing, and characters beyond ASCII.
_WORDS = byte_codes(i for i in range(128) if not chr(i).isalnum())
FOUND = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<string>,items_sha256:string,contaminated:boolean>"


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    return each_text(*word_hashes(texts, _WORDS))


def fingerprints(words: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps."""
    grams = gram_hashes(words, k)
    w = span - k + 1
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = grams[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = grams[i : i + n]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + i
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, grams[at]


def around(at: np.ndarray, n: int, span: int = SPAN, k: int = K) -> np.ndarray:
    """Starts of the windows that hold a gram at one of the positions, in a text of ``n`` words."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(at - (span - k), 0), 1)
    np.add.at(marks, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(marks[: max(0, n - span + 1)]) > 0)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of the words in windows of ``size`` words at ``starts``."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return np.cumsum(marks[:n]) > 0


@dataclass
class Windows:
    """Hashes of windows in order, and the items that have each."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, int]]) -> Windows:
        h = np.concatenate([np.unique(x) for x, _ in pairs])
        item = np.concatenate([np.full(len(np.unique(x)), i) for x, i in pairs])
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        unique, first = np.unique(h, return_index=True)
        return cls(unique, np.r_[first, len(h)], item)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and the items of those."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        found = np.unique(at[there])
        return there, np.unique(np.concatenate([self.items[self.first[i] : self.first[i + 1]] for i in found])) if len(found) else np.zeros(0, np.int64)


@dataclass
class Index:
    """The benchmark: fingerprints, windows of SPAN words, and whole items of fewer words by their length."""

    ids: list[str] = field(default_factory=list)
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    long: Windows | None = None
    short: dict[int, Windows] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str, str]]) -> Index:
        ids = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(ids)}
        prints, by_length = [np.zeros(0, np.uint64)], {}
        for (i, _), words in zip(items, words_of(pa.array([text for _, text in items], pa.string()))):
            if len(words):
                size = min(SPAN, len(words))
                by_length.setdefault(size, []).append((gram_hashes(words, size), number[i]))
                prints.append(fingerprints(words)[1])
        made = {n: Windows.of(pairs) for n, pairs in by_length.items()}
        return cls(ids, np.unique(np.concatenate(prints)), made.pop(SPAN, None), made)

    def match(self, words: np.ndarray) -> tuple[int, list[str]]:
        """Number of hit words, and ids of the items with windows in the text."""
        n, hit, items = len(words), np.zeros(len(words), bool), set()
        if self.long is not None and n >= SPAN:
            at, prints = fingerprints(words)
            there = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
            at = at[self.prints[there] == prints]
            if len(at):
                starts = around(at, n)
                good, found = self.long.find(gram_hashes(words, SPAN)[starts])
                if good.any():
                    hit |= covered(starts[good], SPAN, n)
                    items.update(found.tolist())
        for size, windows in self.short.items():
            if n >= size:
                good, found = windows.find(gram_hashes(words, size))
                if good.any():
                    hit |= covered(np.flatnonzero(good), size, n)
                    items.update(found.tolist())
        return int(hit.sum()), [self.ids[i] for i in sorted(items)]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _struct(rows: list[tuple]) -> pa.StructArray:
    names = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("item_text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", to: str = "leak", bound: int = BOUND) -> DataFrame:
    """Adds a struct: words, hit words, items with occurring windows, their digest, and whether any word is hit."""
    items = _items(benchmark, item, item_text)
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size > bound:
        return _joined(docs, items, text, to)
    sent = docs.sparkSession.sparkContext.broadcast(Index.of([(r.item, r.item_text) for r in items.collect()]))

    def work(texts: pa.Array) -> pa.Array:
        rows = []
        for words in words_of(texts):
            hit, found = sent.value.match(words)
            rows.append((len(words), hit, len(found), found, digest(found), hit > 0))
        return _struct(rows)

    return docs.withColumn(to, arrow_column(work, FOUND, plain=True)(F.col(text)))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


_LISTS = "struct<n_words:bigint,prints:array<bigint>,ats:array<bigint>>"
_GRAMS = "array<struct<size:int,at:bigint,h:bigint>>"


def _prints(texts: pa.Array) -> pa.Array:
    rows = []
    for words in words_of(texts):
        at, prints = fingerprints(words)
        rows.append((len(words), prints.view(np.int64).tolist(), at.tolist()))
    columns = [list(c) for c in zip(*rows)] or [[], [], []]
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.int64()))], ["n_words", "prints", "ats"])


_GRAM = pa.list_(pa.struct([("size", pa.int32()), ("at", pa.int64()), ("h", pa.int64())]))


def _grams(size: int, words: np.ndarray, starts: np.ndarray) -> list[dict]:
    h = gram_hashes(words, size).view(np.int64)
    return [{"size": size, "at": int(s), "h": int(h[s])} for s in starts]


def _item_windows(texts: pa.Array) -> pa.Array:
    out = []
    for words in words_of(texts):
        size = min(SPAN, len(words))
        out.append(_grams(size, words, np.arange(len(words) - size + 1)) if size else [])
    return pa.array(out, _GRAM)


def _joined(docs: DataFrame, items: DataFrame, text: str, to: str) -> DataFrame:
    """The same by joins of tables, for a benchmark of any size."""
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    one = keyed.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
    one = written(one.withColumn("_p", arrow_column(_prints, _LISTS, plain=True)(F.col("_text"))), "prints")
    windows = written(items.select("item", F.explode(arrow_column(_item_windows, _GRAMS, plain=True)(F.col("item_text"))).alias("g")).select("item", "g.size", "g.h").distinct(), "windows")
    own = items.select(F.explode(arrow_column(_prints, _LISTS, plain=True)(F.col("item_text"))["prints"]).alias("print")).distinct()
    seen = one.select("_key", F.explode(F.arrays_zip(F.col("_p.prints").alias("print"), F.col("_p.ats").alias("at"))).alias("x")).select("_key", "x.print", "x.at")
    hits = seen.join(own, "print", "left_semi").groupBy("_key").agg(F.collect_set("at").alias("ats"))
    sizes = [r.size for r in windows.where(F.col("size") < SPAN).select("size").distinct().collect()]  # at most SPAN - 1

    def candidates(rows: pa.Array) -> pa.Array:
        out = []
        texts, ats = rows.flatten()
        for words, at in zip(words_of(texts), ats.to_pylist()):
            found = _grams(SPAN, words, around(np.array(at, np.int64), len(words))) if at else []
            for size in sizes:
                if len(words) >= size:
                    found += _grams(size, words, np.arange(len(words) - size + 1))
            out.append(found)
        return pa.array(out, _GRAM)

    asked = one.join(hits, "_key", "left" if sizes else "inner").select("_key", F.struct(F.col("_text").alias("text"), "ats").alias("r"))
    grams = asked.select("_key", F.explode(arrow_column(candidates, _GRAMS, plain=True)(F.col("r"))).alias("g")).select("_key", "g.size", "g.at", "g.h")
    found = grams.join(windows, ["size", "h"]).groupBy("_key").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))))
    each = one.select("_key", F.col("_p.n_words").alias("n_words")).join(found.select("_key", hit.cast("long").alias("n_hit"), "items"), "_key", "left")
    each = each.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    result = F.struct("n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    kept = [c for c in docs.columns if c.lower() != to.lower()]
    return keyed.select(*kept, key).join(each.select(F.col("_key").alias(key), result.alias(to)), key).select(*kept, to)


def oracle() -> str:
    """The query in DuckDB's SQL: all windows against all windows by equality."""
    words = lambda c: rf"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
s AS (SELECT item_id, w, least({SPAN}, len(w)) AS size FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, i, size FROM dw JOIN iw USING (size, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
