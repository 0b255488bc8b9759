"""SentencePiece encoding and decoding (operator 3).

Encoding gives exactly the pieces that merging the best-scored adjacent pair again and again gives,
without doing these merges on the text. Two facts make that possible: a sequence of pieces is the
result of merging exactly if each two neighbours are (merged alone, they stay the same two pieces),
and a text has one such sequence. So the text is walked from the left with the longest piece that
an Aho-Corasick automaton finds at each position. A piece that doesn't stand beside its predecessor
gives way to its longest prefix that is a piece; when no prefix is left, the position is marked in
a bit field as leading nowhere and the walk goes back by one piece. Each position fails once at most.

No piece holds a space mark after another character, so a text is encoded run by run (spaces, then
other characters) and runs seen before come from a bounded table.

Results for special input: a null or empty text has the begin and end ids alone and decodes to an
empty text. Characters without a piece become byte pieces. Equal texts, repeated or not, get equal ids; ties
of scores are merged leftmost first. A text of any length is encoded as a whole, in time that grows with its
length. The struct column replaces a column of its name; all other columns stay.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import arrow_column

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
ENCODED = "struct<ids:array<int>,decoded:string>"
DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


class _Runs(dict):
    """Ids by run, worked out when first asked for. Starts anew when it is full; long runs aren't kept."""

    def __init__(self, work: Callable[[str], bytes], most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, run: str) -> bytes:
        ids = self.work(run)
        if len(run) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = ids
        return ids


class Codec:
    """Encodes and decodes with a merge-type SentencePiece model given as the bytes of its file."""

    def __init__(self, model: bytes, most_runs: int = 1_000_000, most_pairs: int = 400_000):
        pieces, plain = [], {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or trainer.get(24, 0):
                    raise ValueError("only merge-type models with spaces as prefixes are supported")
            elif number == 3:
                plain = dict(_fields(value))
        if plain.get(2) or not plain.get(3, 1) or plain.get(4, 1) or not plain.get(5, 1):
            raise ValueError("only models with identity normalisation and a space before the text are supported")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = pieces
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.begin, self.end = (next(i for i, x in enumerate(pieces) if x[0] == p) for p in ("<s>", "</s>"))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.same = {p: p for p in self.id}  # one string for each piece, so that pairs hold no copies
        #: A piece that merging its own characters doesn't give back never occurs. Of the others: the last merge.
        self.halves = {p: x for p in self.id if (x := self._halves(p))}
        valid = list(self.halves)
        self.automaton = ahocorasick.Automaton()
        for p in valid:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        known = set(valid)
        self.characters = {p for p in self.id if len(p) == 1}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in valid}
        long = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("a piece has a space mark after another character")
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in long))
        self.runs = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.most_pairs, self.seen = most_pairs, _Runs(self._run, most_runs)
        #: A line break stands alone, so lines can be split off first.
        self.lines = "\n" in alone
        self.surface = [self._surface(p, kind) for p, _, kind in pieces]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first and then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; None if merging doesn't end in the piece."""
        parts = list(piece)
        while len(parts) > 2:
            scores = [self.score.get(a + b, -inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -inf:
                return None
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[-1]) if len(parts) == 1 or piece in self.score else None

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their characters are merged.

        Merges are taken back from the latest on. The two parts that touch at some time would have been
        merged then if that merge has a better score than the one which changed a part. Where scores tie
        (runs of spaces) or a piece has a better score than its parts, all is merged anew instead.
        """
        a, b, limit, score, halves = left, right, -inf, self.score, self.halves
        while True:
            joined = score.get(a + b)
            if joined is not None and joined >= limit:
                return False if joined > limit else self.merged(left + right) == [left, right]
            formed = score[a] if len(a) > 1 else inf
            other = score[b] if len(b) > 1 else inf
            if min(formed, other) < limit or formed == other < inf:
                return self.merged(left + right) == [left, right]
            if formed < other:
                limit, a = formed, halves[a][1]
            elif other < formed:
                limit, b = other, halves[b][0]
            else:
                return True

    def _walk(self, text: str) -> list[str]:
        """The pieces of a text whose characters all have pieces."""
        n = len(text)
        longest = [1] * n
        for last, length in self.automaton.iter(text):
            start = last - length + 1
            if length > longest[start]:
                longest[start] = length
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        pairs = self.pairs
        at, piece = 0, text[: longest[0]]
        while at < n:
            end = at + len(piece)
            before = out[-1] if out else ""
            good = not before or pairs.get((before, piece))
            if good is None:
                if len(pairs) >= self.most_pairs:
                    pairs.clear()
                good = pairs[self.same[before], self.same[piece]] = self.fits(before, piece)
            if good and not failed[end >> 3] & (1 << (end & 7)):
                out.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < n else ""
            elif shorter := self.shorter[piece]:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                while not self.shorter[piece]:
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= len(piece)
                piece = self.shorter[piece]
        return out

    def _run(self, run: str) -> bytes:
        """The ids of one run as little-endian 32-bit integers."""
        ids: list[int] = []
        start = 0
        odd = set(run) - self.characters
        for i, c in enumerate(run) if odd else ():
            if c in odd:
                if i > start:
                    ids += map(self.id.__getitem__, self._walk(run[start:i]))
                ids += (self.byte_id.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass"))
                start = i + 1
        if start < len(run):
            ids += map(self.id.__getitem__, self._walk(run[start:]))
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | None) -> bytes:
        """All ids of a text, with begin and end, as little-endian 32-bit integers."""
        edge = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return edge[0] + edge[1]
        out = [edge[0]]
        run, after = self.seen.__getitem__, SPACE
        if not self.lines or "  " in text or SPACE in text or " \n" in text or " " in (text[0], text[-1]):
            out += map(run, self.runs.findall(SPACE + text.replace(" ", SPACE)))
        else:
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append(run("\n"))
                    after = ""
                words = (after + line).replace(" ", " " + SPACE).split(" ")
                out += map(run, words if words[0] else words[1:])
        out.append(edge[1])
        return b"".join(out)

    def forget(self) -> None:
        """Drops the runs seen so far, some 200 MB at most. Pairs, 60 MB at most, stay: all texts have the same."""
        self.seen.clear()

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the space put before the text is taken away."""
        shown = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
        cut = shown is not None and self.pieces[shown][2] == NORMAL and self.pieces[shown][0].startswith(SPACE)
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        return text[1:] if cut else text

    def _decode_bytes(self, ids: list[int]) -> str:
        """As above where byte pieces aren't UTF-8: each byte that is part of no character becomes U+FFFD."""
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if self.pieces[i][2] == BYTE:
                held += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """One codec for each Python worker."""
    return Codec(model)


def read_model(path: str) -> bytes:
    """The model's file, half a megabyte, which every task gets."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, *, text: str = "text", to: str = "tokens") -> DataFrame:
    """Adds a struct column: the ids with begin and end, and the text that they decode to.

    Made for pipelines: the worker drops the runs it has seen when a task ends, so that other stages have the memory.
    """

    def work(texts: list) -> pa.Array:
        c = codec(model)
        ids = [memoryview(c.packed(t)).cast("I").tolist() for t in texts]
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

    return docs.withColumn(to, arrow_column(work, ENCODED, after=lambda: codec(model).forget())(F.col(text)))


def digests(docs: DataFrame, model: bytes, *, text: str = "text", to: str = "tokens") -> DataFrame:
    """Adds a struct column: number of ids, SHA-256 of the ids and of the text that they decode to. Runs are kept from task to task."""

    def work(texts: list) -> pa.Array:
        c = codec(model)
        n, of_ids, of_text = [], [], []
        for t in texts:
            packed = c.packed(t)
            ids = memoryview(packed).cast("I").tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(packed).hexdigest())
            of_text.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(to, arrow_column(work, DIGESTS)(F.col(text)))
