"""Alignment of the tokens of two tokenizers (operator 13).

Both tokenizers spell the same bytes: a space and the text. A document's tokens get byte ranges; ``pandas.merge_asof``
finds, for each token's start, the other side's token that covers it, on one key of document and byte, so that a match
never leaves its document. Both directions together are all overlaps (links), each once: of two tokens that overlap
the one that starts later, or at the same byte, starts inside the other. Bytes where tokens of both sides end cut a
document into groups.

Tokenizing is most of the work, so runs (what stands between a space after a non-space and the next one) are encoded
once for each worker while they fit its bounded store: neither tokenizer joins anything across such a space. That holds
for byte-level tokenizers with the usual pattern and for SentencePiece models without pieces that hold a space
after another character; others are refused.

Counts over the corpus: each document's different linked id pairs, with their numbers, are written down, the documents of
a pair are counted by Spark, and a join brings the counts back. The count table is broadcast while it has at most
``most_pairs`` rows, else both sides are shuffled by pair; the result is the same.

Results for special input: null and empty texts, and texts that one of the tokenizers doesn't spell back byte by byte
(U+2581 is a space to SentencePiece), have no tokens: zeros and an empty digest. Texts of any length are aligned
whole, in windows cut at group ends. A repeated row is a document of its own. Other columns may have any name;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column, unused, written

#: How byte-level tokenizers of this family split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that doesn't begin a run: one at the start of a text or after white space.
_NO_RUN = r"(^|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
_RUNS = re.compile(r"(?<=\S) ")
#: A worker's store of runs: so many at most, and so many characters.
MOST_RUNS, MOST_CHARS = 700_000, 20_000_000
#: Tokens of both sides that are aligned at once.
WINDOW = 400_000
#: Rows of the count table (16 bytes each) up to which it is broadcast.
MOST_PAIRS = 2_000_000
#: Bits of the key that hold a byte's place in its document.
_PLACE = 40

FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,times:long>>"
GROUPS = "array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
_PAIR = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


class _Side:
    """What ids spell: ``size`` bytes each."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.array([len(s) for s in spelled], np.int64)


class ByteLevel(_Side):
    """A byte-level tokenizer from its JSON file."""

    def __init__(self, file: bytes):
        import tiktoken

        spec = json.loads(file)
        vocab, special = spec["model"]["vocab"], {t["id"] for t in spec.get("added_tokens", [])}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        steps = spec.get("pre_tokenizer") or {}
        usual = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not spec.get("normalizer")
        # merging by the least id then is merging by the first rule, since each token has one rule, in order
        if not usual or any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(set(vocab.values()) - special):
            raise ValueError("a byte-level tokenizer with the usual pattern and ids in the order of its merges is needed")
        byte = {c: i for i, c in enumerate(_byte_characters())}
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = bytes(byte[c] for c in token)
        super().__init__(spelled)
        ranks = {spelled[i]: i for i in vocab.values() if i not in special}
        self._encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, runs: list[str]) -> list[list[int]]:
        return [self._encode(" " + r) for r in runs]


class Pieces(_Side):
    """A SentencePiece model from its file."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space after another character")
            plain = piece.replace("▁", " ").encode()
            spelled.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else plain)
        super().__init__(spelled)
        self._space = self.model.piece_to_id("▁")

    def encode(self, runs: list[str]) -> list[list[int]]:
        ids = self.model.encode(runs, num_threads=1)
        return [x if r else [self._space] for x, r in zip(ids, runs)]


def _byte_characters() -> str:
    """The character by which byte-level vocabularies write each byte: itself if visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in seen else next(hidden)) for b in range(256))


class _Digits:
    """Decimal numbers of ids as rows of bytes with a place for a separator, and which of these bytes count."""

    def __init__(self, n: int):
        width = len(str(n - 1))
        places = 10 ** np.arange(width - 1, -1, -1)
        ids = np.arange(n)[:, None]
        self.bytes = np.concatenate([ids // places % 10 + 48, np.zeros((n, 1), np.int64)], 1).astype(np.uint8)
        self.there = np.concatenate([(ids >= places) | (places == 1), np.ones((n, 1), bool)], 1)
        self.size = self.there.sum(1)


class Aligner:
    """Two tokenizers, and the runs that a worker has seen."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.spelled)
        self.digits = _Digits(max(len(self.a.spelled), self.width))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = array("i"), array("i")
        self.ends = array("q", [0]), array("q", [0])
        self.spelled_back = array("b")
        self.chars = 0

    def _places(self, runs: list[str]) -> np.ndarray:
        """Where the store holds each of these different runs."""
        if len(self.place) > MOST_RUNS or self.chars > MOST_CHARS:
            self.forget()
        place = self.place
        found = np.fromiter((place.get(r, -1) for r in runs), np.int64, len(runs))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            new = [runs[i] for i in unknown]
            found[unknown] = np.arange(len(place), len(place) + len(new))
            self.chars += sum(map(len, new))
            place.update(zip(new, range(len(place), len(place) + len(new))))
            ok = [True] * len(new)
            for side, ids, ends in ((self.a, self.ids[0], self.ends[0]), (self.b, self.ids[1], self.ends[1])):
                lists = side.encode(new)
                for x in lists:
                    ids.extend(x)
                    ends.append(len(ids))
                spelled = side.spelled
                ok = [was and b"".join([spelled[i] for i in x]) == b" " + r.encode() for was, x, r in zip(ok, lists, new)]
            self.spelled_back.extend(ok)
        return found

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids of both sides of all texts one after the other, and each text's numbers of both. Texts without tokens have 0."""
        texts = texts.fill_null("")
        rare = np.asarray(pc.match_substring_regex(texts, _NO_RUN))
        order = np.r_[np.flatnonzero(~rare), np.flatnonzero(rare)]
        parts = [pc.split_pattern(texts.filter(pa.array(~rare)), " ")] if not rare.all() else []
        if rare.any():
            parts.append(pa.array([_RUNS.split(t) for t in texts.filter(pa.array(rare)).to_pylist()], pa.list_(texts.type)))
        per = np.concatenate([np.asarray(p.value_lengths()) for p in parts]).astype(np.int64)
        encoded = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
        runs = self._places(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(encoded.indices)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        if rare.any():  # back in the order of the texts
            first, per = (np.cumsum(per) - per)[back], per[back]
            runs = runs[_ranges(first, per)]
        ok = np.logical_and.reduceat(np.frombuffer(self.spelled_back, np.int8)[runs] != 0, np.r_[0, np.cumsum(per)[:-1]])
        ok &= np.asarray(pc.not_equal(texts, ""))
        text = np.repeat(np.arange(len(per)), per)
        keep = ok[text]
        runs, text = runs[keep], text[keep]
        out = []
        for ids, ends in zip(self.ids, self.ends):
            ends = np.frombuffer(ends, np.int64)
            size = ends[runs + 1] - ends[runs]
            out.append((np.frombuffer(ids, np.int32)[_ranges(ends[runs], size)], np.bincount(text, size, len(per)).astype(np.int64)))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def windows(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[_Window]:
        """Parts of all tokens that begin and end where groups do."""
        if not len(a):
            return
        size_a, size_b = self.a.size[a], self.b.size[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        both = np.zeros(int(end_a[-1]) + 1, bool)
        both[end_b] = True
        cut_a = np.flatnonzero(both[end_a])
        both[:] = False
        both[end_a] = True
        cut_b = np.flatnonzero(both[end_b])
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        begins = np.r_[0, np.cumsum(np.bincount(doc_a, size_a, len(n_a)).astype(np.int64))]
        last = 0
        while last < len(cut_a):
            at_a, at_b = (cut_a[last - 1] + 1, cut_b[last - 1] + 1) if last else (0, 0)
            upto = int(np.searchsorted(cut_a + cut_b, at_a + at_b + WINDOW))
            upto = min(max(upto, last + 1), len(cut_a))
            of_a, of_b = slice(at_a, cut_a[upto - 1] + 1), slice(at_b, cut_b[upto - 1] + 1)
            yield _Window(
                a[of_a], b[of_b], doc_a[of_a], doc_b[of_b], end_a[of_a] - begins[doc_a[of_a]], end_b[of_b] - begins[doc_b[of_b]],
                size_a[of_a], size_b[of_b], cut_a[last:upto] - at_a, cut_b[last:upto] - at_b, begins,
            )
            last = upto


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first one on."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)


class _Window:
    """Tokens of both sides over the same bytes: ids, documents, ends in the document, and the last tokens of groups."""

    def __init__(self, a, b, doc_a, doc_b, end_a, end_b, size_a, size_b, cut_a, cut_b, begins):
        self.a, self.b, self.doc_a, self.doc_b, self.end_a, self.end_b = a, b, doc_a, doc_b, end_a, end_b
        self.start_a, self.start_b, self.cut_a, self.cut_b, self.begins = end_a - size_a, end_b - size_b, cut_a, cut_b, begins

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of both sides that overlap, each pair once."""
        left = pd.DataFrame({"key": (self.doc_a << _PLACE) + self.start_a, "a": np.arange(len(self.a))})
        right = pd.DataFrame({"key": (self.doc_b << _PLACE) + self.start_b, "b": np.arange(len(self.b))})
        over_a = pd.merge_asof(left, right, on="key")["b"].to_numpy()
        over_b = pd.merge_asof(right, left, on="key")["a"].to_numpy()
        later = np.flatnonzero(self.start_a[over_b] != self.start_b)
        return np.r_[left["a"].to_numpy(), over_b[later]], np.r_[over_a, later]

    def written(self, digits: _Digits) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;a3|b2,b3``, and for each group where it ends. A document's last group has no semicolon."""
        group_a = np.repeat(np.arange(len(self.cut_a)), np.diff(self.cut_a, prepend=-1))
        group_b = np.repeat(np.arange(len(self.cut_b)), np.diff(self.cut_b, prepend=-1))
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + np.r_[0, self.cut_b + 1][group_a]
        at_b = np.arange(len(self.b)) + (self.cut_a + 1)[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        ends = at_b[self.cut_b]
        mark[at_a[self.cut_a]], mark[ends] = ord("|"), ord(";")
        rows, there = digits.bytes[ids], digits.there[ids]
        rows[:, -1] = mark
        last = self.begins[self.doc_b[self.cut_b] + 1] - self.begins[self.doc_b[self.cut_b]] == self.end_b[self.cut_b]
        there[ends[last], -1] = False
        size = digits.size[ids]
        size[ends[last]] -= 1
        return rows[there].tobytes(), np.cumsum(size)[ends]


@lru_cache(maxsize=2)
def aligner(a: bytes, b: bytes) -> Aligner:
    """One for each Python worker."""
    return Aligner(a, b)


def read_file(path: str) -> bytes:
    """A tokenizer's file, one or two megabytes, which every task gets."""
    with open(path, "rb") as f:
        return f.read()


def _found(both: Aligner, texts: pa.Array) -> pa.Array:
    a, b, n_a, n_b = both.tokens(texts)
    n = len(texts)
    n_groups, n_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shas: dict[int, hashlib._Hash] = {}
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    size = len(both.a.spelled) * both.width
    for w in both.windows(a, b, n_a, n_b):
        link_a, link_b = w.links()
        key = w.doc_a[link_a] * size + w.a[link_a].astype(np.int64) * both.width + w.b[link_b]
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times, key = np.diff(np.r_[first, len(key)]), key[first]
        text, ends = w.written(both.digits)
        docs = np.arange(w.doc_a[0], w.doc_a[-1] + 1)
        doc_of_group = w.doc_b[w.cut_b]
        n_groups += np.bincount(doc_of_group, minlength=n)
        n_links += np.bincount(w.doc_a[link_a], minlength=n)
        at, to = np.searchsorted(key, docs * size), np.r_[0, ends][np.searchsorted(doc_of_group, docs, side="right")]
        begin = 0
        for doc, i, j, end in zip(docs.tolist(), at.tolist(), [*at[1:].tolist(), len(key)], to.tolist()):
            if end > begin:
                shas.setdefault(doc, hashlib.sha256()).update(text[begin:end])
                kept[doc].append((key[i:j] - doc * size, times[i:j]))
            begin = end
    pairs, counts, per = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
    for chunks in kept:
        if len(chunks) > 1:
            code, where = np.unique(np.concatenate([c for c, _ in chunks]), return_inverse=True)
            chunks = [(code, np.bincount(where, np.concatenate([t for _, t in chunks])).astype(np.int64))]
        for code, times in chunks:
            pairs.append(code)
            counts.append(times)
        per.append(len(chunks[0][0]) if chunks else 0)
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(counts))], fields=list(_PAIR))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(per), pa.int32()), items)
    digest = pa.array([shas[i].hexdigest() if i in shas else "" for i in range(n)], pa.string())
    return pa.StructArray.from_arrays([*(pa.array(x) for x in (n_a, n_b, n_groups, n_links)), digest, lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def align(docs: DataFrame, a: bytes, b: bytes, *, text: str = "text", to: str = "aligned") -> DataFrame:
    """Adds a struct column: numbers of tokens, groups and links, the groups' digest, and the linked id pairs.

    ``pair`` is the id of ``a`` times the size of the other vocabulary, plus the id of ``b``; ``times`` is how many links the document has of it.
    """
    return docs.withColumn(to, arrow_column(lambda texts: _found(aligner(a, b), texts), FOUND, step=256, plain=True)(F.col(text)))


def groups(docs: DataFrame, a: bytes, b: bytes, *, text: str = "text", to: str = "groups") -> DataFrame:
    """Adds the groups themselves: byte ranges of a space and the text, with the ids of both sides."""

    def work(texts: pa.Array) -> pa.Array:
        both = aligner(a, b)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for w in both.windows(*both.tokens(texts)):
            at_a = at_b = 0
            for i, j in zip(w.cut_a + 1, w.cut_b + 1):
                out[w.doc_a[at_a]].append({"start": int(w.start_a[at_a]), "end": int(w.end_a[i - 1]), "a": w.a[at_a:i].tolist(), "b": w.b[at_b:j].tolist()})
                at_a, at_b = i, j
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return docs.withColumn(to, arrow_column(work, GROUPS, step=64, plain=True)(F.col(text)))


def pair_counts(aligned: DataFrame, width: int, *, found: str = "aligned") -> DataFrame:
    """``pair``, the documents that hold it linked, and whether no pair of its first id has more.

    Pairs are counted before they are shuffled, so one that all documents hold costs a row for each task.
    """
    counts = written(aligned.select(F.explode(F.col(found)["pairs"]["pair"]).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "token-pairs")
    first = (F.col("pair") / width).cast("long").alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def judge(docs: DataFrame, a: bytes, b: bytes, *, text: str = "text", keep: list[str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Adds ``aligned`` (without the pairs) with ``n_best``, the links whose pair is among the most counted of its first id, and ``count_sum``.

    ``keep`` names the columns to carry along, by default all. Rows are numbered in the written table, so the numbers stay when tasks run again.
    """
    row, to = unused(docs, "row"), unused(docs, "aligned")
    width = aligner(a, b).width
    found = align(docs, a, b, text=text, to=to)
    docs = docs.select(*(docs.columns if keep is None else keep))
    found = written(found.select(*docs.columns, to).withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(found, width, found=to), "pair-counts")
    counts = F.broadcast(counts) if counts.count() <= most_pairs else counts
    links = found.select(F.col(row).alias("row"), F.explode(F.col(to)["pairs"]).alias("link")).select("row", "link.pair", "link.times")
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    sums = sums.withColumnsRenamed({"row": row, "n_best": "_n_best_", "count_sum": "_count_sum_"})
    kept = {c: f"_own{i}_" for i, c in enumerate(docs.columns)}
    own = found.select(row, F.col(to).dropFields("pairs").alias("_aligned_"), *(F.col(c).alias(k) for c, k in kept.items())).join(sums, row, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole = F.col("_aligned_").withField("n_best", zero("_n_best_")).withField("count_sum", zero("_count_sum_"))
    return own.select(*(F.col(k).alias(c) for c, k in kept.items()), whole.alias(to))
