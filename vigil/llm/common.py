"""What several corpus operators share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII to lower case; everything else stays.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only on a single machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/vigil/{label}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of our own that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str, *, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, which survives lost executors and cuts the lineage."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_column(f: Callable[[list], pa.Array], kind: str, *, step: int = 256, plain: bool = False, after: Callable[[], None] | None = None) -> Callable[[Column], Column]:
    """A scalar function over a text column. ``f`` gets ``step`` values at a time, so that its memory stays small.

    It gets them as a list, or as they come with ``plain``. ``after`` is called when a task ends, to drop what
    the worker, which goes on to other tasks, holds for it.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for values in batches:
                slices = [values.slice(i, step) for i in range(0, len(values), step)] or [values]
                yield pa.concat_arrays([f(x if plain else x.to_pylist()) for x in slices])
        finally:
            if after:
                after()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def text_batches(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.Array]:
    """The first column of the batches, ``step`` values at a time."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.column(0).slice(i, step)


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _MIX1
        h = (h ^ (h >> _S33)) * _MIX2
    return h ^ (h >> _S33)


#: Bytes of text whose words are hashed at once, and places of a word that have a factor at once.
_WINDOW = 1 << 17
_factors = np.zeros(0, np.uint64)


def _random(n: int, salt: int) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(salt)) * GOLD) | np.uint64(1)


def byte_codes(separators: Iterable[int]) -> np.ndarray:
    """A number for each byte, that of its lower case for A-Z, and 0 for separators."""
    codes = _random(256, 1 << 40)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    codes[list(separators)] = 0
    return codes


#: Words are what stands between U+0020 and U+0009 to U+000D.
SPACED = byte_codes(map(ord, SPACES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text begins, with the end. Null is empty."""
    column = column.fill_null("") if column.null_count else column
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _windows(data: np.ndarray, at: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the bytes of about ``_WINDOW`` bytes that no word crosses."""
    begin, n = 0, len(data)
    while begin < n:
        end = begin + _WINDOW
        while end < n:
            text = int(at[np.searchsorted(at, end, side="right") - 1])
            space = np.flatnonzero(codes[data[max(begin, end - 4096) : end]] == 0)
            cut = max(text, max(begin, end - 4096) + int(space[-1]) + 1 if len(space) else 0)
            if cut > begin:
                end = cut
                break
            end += _WINDOW
        end = min(end, n)
        yield begin, end
        begin = end


def word_hashes(column: pa.Array, codes: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text column one after the other, and each text's number of words.

    A word's hash is the sum of its bytes' codes by odd factors of their places, mixed: no word is made a
    Python object. Memory beyond the result is some 40 times ``_WINDOW``, but for longer single words.
    """
    global _factors
    data, at = utf8(column)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in _windows(data, at, codes):
        code = codes[data[begin:end]]
        there = code != 0
        first = there.copy()
        first[1:] &= ~there[:-1]
        edges = at[np.searchsorted(at, begin) : np.searchsorted(at, end)] - begin
        first[edges] = there[edges]
        start = np.flatnonzero(first)
        if not len(start):
            continue
        size = np.diff(np.r_[start, end - begin])
        if size.max() > len(_factors):
            _factors = _random(int(max(4096, 2 * size.max())), 1 << 41)
        place = np.arange(start[0], end - begin) - np.repeat(start, size)
        with np.errstate(over="ignore"):
            hashes.append(mix(np.add.reduceat(code[start[0] :] * _factors[place], start - start[0])))
        starts.append(start + begin)
        if len(_factors) > 8 * _WINDOW:
            _factors = np.zeros(0, np.uint64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), at))


def each_text(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The values of each text, given their numbers."""
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; order matters."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for i in range(1, k):
            h = (h ^ (h >> _S33)) * GOLD + words[i : i + n]
    return mix(h)


def lowered(col: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col, UPPER, LOWER)
